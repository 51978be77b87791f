import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import bins, clean, outliers, scale
from kiln.plans.pipeline import SpecError, run_pipeline


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(1, 1.0, 2.0, 5.0), (2, None, 3.0, 5.0), (3, float("nan"), -1.0, 5.0), (4, 4.0, 0.0, 5.0),
            (5, 4.0, 10.0, 5.0), (6, 100.0, -2.0, 5.0), (7, 2.0, 1.0, 5.0)]
    from kiln.functions.nulls import nan_to_null
    return nan_to_null(spark.createDataFrame(rows, "id long, x double, y double, const double"))


def test_drop_na_variants(spark):
    df = spark.createDataFrame([(1, 2, 3, 0), (None, 2, 3, 1), (None, None, 3, 2), (None, None, None, 3)],
                               "a int, b int, c int, `Unnamed: 0` int")
    base = df.drop("Unnamed: 0")
    assert clean.drop_na(base, "all").count() == 3
    assert clean.drop_na(base, "any").count() == 1
    assert clean.drop_na(base, "thresh", 2).count() == 2
    assert clean.tidy_on_load(df).columns == ["a", "b", "c"] and clean.tidy_on_load(df).count() == 4
    with pytest.raises(KeyError):
        clean.delete_columns(base, ["nope"])


def test_impute_methods(spark, edge):
    pdf = edge.toPandas()
    mean = clean.impute(edge, "x", "mean").orderBy("id").toPandas().x
    assert np.allclose(mean, pdf.x.fillna(pdf.x.mean()))
    med = clean.impute(edge, "x", "median").orderBy("id").toPandas().x
    assert np.allclose(med, pdf.x.fillna(pdf.x.median()))
    mode = clean.impute(edge, "x", "mode").orderBy("id").toPandas().x
    assert np.allclose(mode, pdf.x.fillna(4.0))
    flag = clean.impute_columns(edge, ["x"], "flag").orderBy("id").toPandas()
    assert flag.x_missing.tolist() == [0, 1, 1, 0, 0, 0, 0]


def test_tied_mode_is_smallest(spark):
    df = spark.createDataFrame([(1, 3), (2, 1), (3, 3), (4, 1), (5, None)], "id long, v int")
    assert clean.impute(df, "v", "mode").where("id = 5").first()["v"] == 1


def test_four_zscores(spark, edge):
    pdf = edge.toPandas()
    x = pdf.x.dropna()
    keep = clean_z = outliers.outlier(edge, "x", "zscore", "remove", threshold=1.0)
    z = (x - x.mean()) / x.std()
    assert sorted(r["id"] for r in keep.collect()) == sorted(pdf.loc[z[abs(z) < 1].index, "id"])
    det = outliers.detect(edge, "x", "zscore", threshold=1.0)
    zp = (x - x.mean()) / x.std(ddof=0)
    assert sorted(r["x"] for r in det.collect()) == sorted(x[abs(zp) > 1])
    del clean_z


def test_cap_keeps_null(spark, edge):
    out = outliers.outlier(edge, "x", "iqr", "cap").orderBy("id").toPandas().x
    assert math.isnan(out[1]) and out[5] < 100


def test_dbscan_1d_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    x = np.round(np.concatenate([rng.normal(0, 1, 150), rng.uniform(-20, 20, 40)]), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    eps, ms = 0.5, 5
    deg = np.array([(np.abs(x - v) <= eps).sum() for v in x])
    core = deg >= ms
    noise = [v for v, c in zip(x, core) if not c and not any(core & (np.abs(x - v) <= eps))]
    got = sorted(r["x"] for r in outliers.detect(df, "x", "dbscan", eps=eps, min_samples=ms).collect())
    assert got == sorted(noise)


def test_scalers(spark, edge):
    pdf = edge.toPandas()
    st = scale.scale(edge, ["y", "const"], "standard").orderBy("id").toPandas()
    assert np.allclose(st.y, (pdf.y - pdf.y.mean()) / pdf.y.std(ddof=0))
    assert np.allclose(st.const, 0.0)
    mm = scale.scale(edge, ["const"], "minmax").toPandas()
    assert np.allclose(mm.const, 0.0)
    assert scale.eda_transform(edge, "const", "normalize").where(F.col("transformed").isNotNull()).count() == 0


def test_binning_pandas_semantics(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 2, 5, 10]], "x double")
    out = bins.equal_width(df, "x", 5).toPandas()
    assert out.x_binned.tolist() == [0, 0, 0, 2, 4]
    assert np.isclose(out.x_binned_lower.iloc[0], 0.991)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    c = bins.equal_width(const, "x", 2).toPandas()
    assert np.isclose(c.x_binned_lower.iloc[0], 2.997) and c.x_binned.tolist() == [0, 0]
    cust = bins.custom(df, "x", [1, 5, 10], labels=["lo", "hi"]).toPandas()
    assert cust.x_binned.isna().tolist()[0] and cust.x_binned_label.tolist()[1:] == ["lo", "lo", "lo", "hi"]
    with pytest.raises(ValueError):
        bins.equal_freq(spark.createDataFrame([(1.0,)] * 8 + [(2.0,)], "x double"), "x", 4)


def test_pipeline_validates_and_fuses(spark, edge):
    with pytest.raises(SpecError):
        run_pipeline(edge, [{"type": "impute", "params": {"column": "x", "method": "magic"}}])
    res = run_pipeline(edge, [
        {"type": "impute", "params": {"column": "x", "method": "median"}},
        {"type": "normalize", "params": {"column": "y", "method": "minmax"}},
        {"type": "scaling", "method": "robust", "columns": ["const"]},
    ])
    out = res.df.orderBy("id").toPandas()
    assert out.x.isna().sum() == 0 and abs(out.y.min()) < 1e-12 and abs(out.y.max() - 1.0) < 1e-12


def test_knn_imputation_multi_column(spark):
    from kiln.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    rng = np.random.default_rng(3)
    a = rng.normal(size=120)
    b = np.where(np.arange(120) % 6 == 0, np.nan, a * 2)
    df = spark.createDataFrame([(int(i), float(x), None if np.isnan(y) else float(y)) for i, (x, y) in enumerate(zip(a, b))],
                               "id long, a double, b double")
    out = {r["id"]: r["b"] for r in clean.impute_knn(df, "b", ["a"], 3, key=["id"]).collect()}
    donors = np.flatnonzero(~np.isnan(b))
    for i in np.flatnonzero(np.isnan(b)):
        d = np.abs(a[donors] - a[i])
        near = donors[np.lexsort((donors, d))[:3]]
        assert abs(out[i] - b[near].mean()) < 1e-12


def test_pipeline_imputes_from_other_columns(spark):
    rows = [(i, float(i), 2.0 * i + 1.0 if i % 5 else None) for i in range(1, 60)]
    df = spark.createDataFrame(rows, "id long, a double, b double")
    op = lambda method, **kw: [{"type": "impute", "params": {"column": "b", "method": method, "on": ["a"], **kw}}]
    near = {r["id"]: r["b"] for r in run_pipeline(df, op("knn", neighbors=2)).df.collect()}
    assert near[10] == 21.0 and near[11] == 23.0
    chained = {r["id"]: r["b"] for r in run_pipeline(df, op("mice")).df.collect()}
    assert abs(chained[10] - 21.0) < 1e-6

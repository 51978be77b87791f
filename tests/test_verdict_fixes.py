import math

import numpy as np
import pytest

from kiln.functions import quantile
from kiln.operators import charts, encode, rules, select
from kiln.sources.files import read_csv, write_csv


def test_chi2_and_f_over_many_classes(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 400, 4000)
    x = rng.gamma(2.0, size=4000) + 1e6 * 0 + (y % 7)
    df = spark.createDataFrame([(int(a), float(b), float(b) + 1e8, None) for a, b in zip(y, x)], "y int, x double, far double, none double")
    sums, n = np.bincount(y, x), np.bincount(y)
    keep = n > 0
    e = n[keep] / n.sum() * x.sum()
    assert abs(select.chi2_scores(df, "y", ["x"])["x"][0] - ((sums[keep] - e) ** 2 / e).sum()) < 1e-6
    k, mean = keep.sum(), x.mean()
    ssb = (n[keep] * (sums[keep] / n[keep] - mean) ** 2).sum()
    ssw = sum(((x[y == c] - x[y == c].mean()) ** 2).sum() for c in np.flatnonzero(keep))
    want = (ssb / (k - 1)) / (ssw / (len(x) - k))
    got = select.f_classif_scores(df, "y", ["x", "far"])
    assert abs(got["x"][0] - want) < 1e-9 and abs(got["far"][0] - want) < 1e-3


def test_f_counts_only_rows_with_the_feature(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", None), ("b", 5.0), ("b", 6.5), (None, 100.0)], "y string, x double")
    f = select.f_classif_scores(df, "y", ["x"])["x"][0]
    assert abs(f - (4 * (2.125 ** 2) / 1) / ((0.5 + 1.125) / 2)) < 1e-9


def test_kde_levels_without_value_do_not_count(spark):
    rng = np.random.default_rng(1)
    rows = [(h, float(v)) for h in ("a", "b") for v in rng.normal(size=200)] + [(None, float(v)) for v in rng.normal(size=400)]
    out = charts.kde(spark.createDataFrame(rows, "h string, x double"), "x", hue="h").toPandas()
    total = sum(np.trapezoid(p.sort_values("i").density, p.sort_values("i").x) for _, p in out.groupby("h"))
    assert sorted(out["h"].unique()) == ["a", "b"] and abs(total - 1) < 0.01


def test_kde_of_many_levels(spark):
    df = spark.range(3000).selectExpr("id % 300 AS h", "double(id * 7919 % 1009) AS x")
    assert charts.kde(df, "x", hue="h", gridsize=10).select("h").distinct().count() == 300


def test_chart_points_are_all_rows(spark):
    df = spark.range(7000).selectExpr("double(id) AS a", "double(id % 10) AS b", "id")
    assert charts.scatter(df, "a", "b").count() == 7000
    assert charts.scatter(df, "a", "b", key=["id"], cap=10).count() == 10
    assert charts.pairplot(df, ["a", "b"])["scatter"][("a", "b")].count() == 7000
    assert charts.qq(df, "a", ["id"])[1].count() == 7000


def test_acf_default_lags():
    assert charts.default_nlags(20) == 10 and charts.default_nlags(1000) == 30 and charts.default_nlags(1) == 0


def test_bootstrap_is_repeatable(spark):
    df = spark.range(600).selectExpr("id % 2 AS g", "double(id % 50) AS y", "id")
    a = charts.bar_bootstrap(df, "g", "y", ["id"], replicates=300).orderBy("g").collect()
    assert a == charts.bar_bootstrap(df.repartition(5), "g", "y", ["id"], replicates=300).orderBy("g").collect()
    half = 1.96 * np.std([i % 50 for i in range(0, 600, 2)]) / math.sqrt(300)
    assert abs((a[0]["ci_high"] - a[0]["ci_low"]) / 2 - half) < 0.25 * half


def test_rules_with_commas_in_items(spark):
    rows = [("x,b_y", None, "z")] * 3 + [("x", "y", "z")] * 3 + [("x", "q", "w")] * 4
    out = rules.association_rules(rules.frequent_itemsets(spark.createDataFrame(rows, "a string, b string, c string"), ["a", "b", "c"], 0.1), 0.1)
    got = [(r["antecedent_support"], r["support"]) for r in out.where("antecedents = 'a_x,b_y' AND consequents = 'c_z'").collect()]
    assert sorted((round(a, 6), round(s, 6)) for a, s in got) == [(0.3, 0.3), (0.3, 0.3)]


def test_dummies_of_many_categories(spark):
    df = spark.range(1200).selectExpr("concat('c', id) AS c")
    assert len(encode.onehot(df, "c", drop=None).columns) == 1200
    with pytest.raises(ValueError):
        encode.onehot(df, "c", cap=100)


def test_csv_without_schema(spark, tmp_path):
    (tmp_path / "t.csv").write_text('n,x,t,b,e\n1,1.5,"say ""hi"", ok",True,\nNA,NA,"two\nlines",False,\n3,2,plain,NA,NA\n')
    df = read_csv(spark, str(tmp_path / "t.csv"))
    assert dict(df.dtypes) == {"n": "bigint", "x": "double", "t": "string", "b": "boolean", "e": "string"}
    assert [tuple(r) for r in df.collect()] == [(1, 1.5, 'say "hi", ok', True, None), (None, None, "two\nlines", False, None), (3, 2.0, "plain", None, None)]
    write_csv(df, str(tmp_path / "out"))
    assert sorted(map(str, read_csv(spark, str(tmp_path / "out")).collect())) == sorted(map(str, df.collect()))
    assert '""hi""' in "".join(p.read_text() for p in (tmp_path / "out").glob("*.csv"))
    typed = read_csv(spark, str(tmp_path / "t.csv"), "n int, x string, t string, b boolean, e double")
    assert [r["n"] for r in typed.collect()] == [1, None, 3] and dict(typed.dtypes)["e"] == "double"


def test_grouped_quantiles_join_targets_by_group(spark, monkeypatch):
    rng = np.random.default_rng(2)
    g, x = rng.integers(0, 40, 6000), rng.normal(size=6000)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, x)], "g int, x double")
    got = quantile.grouped_quantiles(df, {"x": [0.25, 0.5]}, ["g"], max_collect=20, buckets=16)
    for k in range(40):
        assert np.allclose(got[(k,)]["x"], np.quantile(x[g == k], [0.25, 0.5]))


def test_spelling_by_text_and_in_other_scripts(spark):
    from kiln.operators.spell import correct_spelling
    good = ["straße wunderschönerweise", "été internationalization"] * 4
    df = spark.createDataFrame([(t,) for t in good + ["strase wundershönerweise!", "étee internationalizatoin", None, ""]], "t string")
    out = sorted(str(r["t"]) for r in correct_spelling(df.repartition(3), "t").collect())
    assert out == sorted(["straße wunderschönerweise"] * 4 + ["été internationalization"] * 5 + ["straße wunderschönerweise!", "None", ""])


def test_prefix_deletions_find_all_pairs_within_two_edits(spark):
    import random
    from pyspark.sql import functions as F
    from kiln.operators.spell import correction_table
    rnd = random.Random(1)
    words = {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 16))) for _ in range(120)}
    rows = [(w, 5 if i % 2 else 1) for i, w in enumerate(sorted(words))]
    df = spark.createDataFrame(rows, "word string, n long")
    got = {r["word"] for r in correction_table(df, 3).collect()}
    pairs = df.where("n < 3").select("word").crossJoin(df.where("n >= 3").select(F.col("word").alias("c")))
    assert got == {r["word"] for r in pairs.where(F.levenshtein("word", "c") <= 2).collect()}

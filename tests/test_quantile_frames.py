import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from kiln.functions.frames import keep_first, lookup, prefix_sum, with_global_index
from kiln.functions.quantile import grouped_quantiles, order_statistics, quantiles


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=700), np.full(200, 3.0), rng.integers(0, 5, 100).astype(float)])
    rows = [(i, float(v) if i % 17 else None, int(i % 3)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "id long, x double, g int"), x


@pytest.mark.parametrize("max_collect,buckets", [(1_000_000, 2048), (50, 8), (10, 4)])
def test_exact_quantiles_match_pandas(values, max_collect, buckets):
    df, _ = values
    pdf = df.toPandas()
    probs = [0, 0.05, 0.25, 0.5, 0.75, 0.95, 1]
    got = quantiles(df, {"x": probs}, max_collect=max_collect, buckets=buckets)["x"]
    assert np.allclose(got, [pdf.x.quantile(p) for p in probs])


def test_grouped_quantiles_narrowing(values):
    df, _ = values
    pdf = df.toPandas()
    got = grouped_quantiles(df, {"x": [0.25, 0.5]}, ["g"], max_collect=20, buckets=4)
    for (g,), v in got.items():
        ref = pdf[pdf.g == g].x
        assert np.allclose(v["x"], [ref.quantile(0.25), ref.quantile(0.5)])


def test_order_statistics(values):
    df, _ = values
    vals = np.sort(df.toPandas().x.dropna().to_numpy())
    got = order_statistics(df, "x", [0, 10, 500, len(vals) - 1], max_collect=30, buckets=8)
    assert got == [vals[0], vals[10], vals[500], vals[-1]]


@pytest.mark.parametrize("parts", [1, 7])
def test_global_index_equals_row_number(spark, values, parts):
    df, _ = values
    df = df.repartition(parts)
    a = with_global_index(df, ["x", "id"], "rn", num_partitions=parts)
    b = df.withColumn("rn2", F.row_number().over(Window.orderBy(F.col("x").asc_nulls_first(), "id")) - 1)
    j = a.join(b, "id")
    assert j.where("rn != rn2").count() == 0 and j.count() == df.count()


def test_prefix_sum(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(200)], "k long, w double")
    out = {r["k"]: r["c"] for r in prefix_sum(df, ["k"], "w", "c", num_partitions=5).collect()}
    acc = 0.0
    for i in range(200):
        acc += i % 5
        assert out[i] == acc


def test_keep_first_and_lookup_without_broadcast(spark):
    df = spark.createDataFrame([(1, "a", 5), (2, "a", 3), (3, None, 1), (4, None, 2)], "id long, k string, o int")
    got = sorted((r["id"], r["k"]) for r in keep_first(df, ["k"], ["o"]).collect())
    assert got == [(2, "a"), (3, None)]
    stats = spark.createDataFrame([("a", 10.0)], "k string, v double")
    out = lookup(df, stats, ["k"], "left", max_broadcast_bytes=0)
    assert sorted((r["id"], r["v"]) for r in out.collect()) == [(1, 10.0), (2, 10.0), (3, None), (4, None)]

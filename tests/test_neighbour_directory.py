"""Cells that are cut again by trees of their own."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kiln.operators import neighbours, profile


@pytest.mark.parametrize("dims", [1, 3])
def test_search_through_the_directory(spark, monkeypatch, dims):
    for name, v in (("MAX_CELLS", 4), ("CELL_ROWS", 20), ("SPLIT_ROWS", 60), ("BLOCK_ROWS", 25), ("PLACE_ROWS", 50)):
        monkeypatch.setattr(neighbours, name, v)
    rng = np.random.default_rng(dims)
    x = rng.normal(size=(900, dims))
    x[:300] = 0.25  # a third of all points alike
    y = rng.normal(size=900)
    q = np.concatenate([rng.normal(size=(80, dims)), np.full((40, dims), 0.25), rng.normal(size=(6, dims)) * 40])
    train = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y))], "tid long, x array<double>, label double")
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, x array<double>")
    tree = neighbours.build_tree(train, "tid", "x", 8)
    cells = train.withColumn("cell", F.lit(0))
    assert tree.n_cells <= 4 and neighbours._directory(cells, 8).count() == 1
    found = neighbours.nearest(train, query, 5).collect()
    for i, p in enumerate(q):
        d = np.sqrt(((x - p) ** 2).sum(1))
        want = np.lexsort((np.arange(900), d))[:5]
        got = sorted((r["d"], r["tid"]) for r in found if r["qid"] == i)
        assert [t for _, t in got] == want.tolist() and np.allclose([v for v, _ in got], d[want])


def test_equal_places_are_searched_once(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PLACE_ROWS", 50)
    rng = np.random.default_rng(8)
    x, q = rng.integers(0, 4, size=(3000, 2)).astype(float), rng.integers(0, 5, size=(700, 2)).astype(float)
    train = spark.createDataFrame([(i, v.tolist(), i / 3) for i, v in enumerate(x)], "tid long, x array<double>, label double").repartition(5)
    query = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, x array<double>")
    seen, search = [], neighbours._nearest
    monkeypatch.setattr(neighbours, "_nearest", lambda t, a, k: seen.append((t.count(), a.count())) or search(t, a, k))
    found = neighbours.nearest(train, query, 5).collect()
    assert seen == [(16 * 5, 25)]  # five points of each of 16 places, 25 places that are asked for
    by = {}
    for r in found:
        by.setdefault(r["qid"], []).append((r["d"], r["tid"], r["label"]))
    for i, p in enumerate(q):
        d = np.sqrt(((x - p) ** 2).sum(1))
        want = np.lexsort((np.arange(3000), d))[:5]
        assert [t for _, t, _ in sorted(by[i])] == want.tolist() and np.allclose([v for v, _, _ in sorted(by[i])], d[want])


def test_distinct_counts_of_all_columns(spark):
    rows = [(0.0, "a", [1], None), (-0.0, "a", [1, 2], b"x"), (float("nan"), None, None, b"x"), (float("nan"), "b", [1], b"")]
    df = spark.createDataFrame(rows, "d double, s string, l array<int>, b binary")
    got = {r["column"]: (r["unique_count"], r["null_count"]) for r in profile.column_stats(df).collect()}
    assert got == {"d": (2, 0), "s": (2, 1), "l": (2, 1), "b": (2, 1)}
    assert {r["unique_count"] for r in profile.column_stats(df.limit(0)).collect()} == {0}

"""DBSCAN where a third of all points crowd within eps of each other."""

import numpy as np
import pytest

from kiln.operators import cluster, neighbours
from tests.test_cluster import brute


@pytest.mark.parametrize("dims,hot", [(1, 20), (2, 20), (2, 7), (3, 15)])
def test_crowded_cells_equal_brute_force(spark, monkeypatch, dims, hot):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 20)
    monkeypatch.setattr(cluster, "HOT_ROWS", hot)
    rng = np.random.default_rng(10 * dims + hot)
    crowd = np.concatenate([rng.uniform(0, 0.45, (200, dims)), rng.normal(0.2, 0.02, (60, dims)), rng.uniform(1.1, 1.5, (80, dims))])
    spread = rng.uniform(-4, 4, (230, dims))
    edge = np.concatenate([rng.uniform(-0.9, 1.6, (60, dims)), np.full((1, dims), 1.0)])
    x = np.round(np.concatenate([crowd, spread, edge]), 4)
    names = [f"c{i}" for i in range(dims)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)], ", ".join(["id long", *(f"{n} double" for n in names)]))
    for eps, least in ((0.5, 6), (0.25, 4)):
        got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, names, eps, least).collect()}
        assert [got[i] for i in range(len(x))] == brute(x, eps, least).tolist()


def test_two_crowds_at_the_distance(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HOT_ROWS", 10)
    rng = np.random.default_rng(3)
    a, b = rng.uniform(0, 0.1, (60, 2)), rng.uniform(0, 0.1, (60, 2))
    for gap, clusters in ((0.45, 1), (0.62, 2)):
        x = np.concatenate([a, b + [gap, 0]])
        df = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x)], "id long, a double, b double")
        got = {r["id"]: r["cluster"] for r in cluster.dbscan(df, ["a", "b"], 0.5, 5).collect()}
        assert len(set(got.values())) == clusters and [got[i] for i in range(120)] == brute(x, 0.5, 5).tolist()


def test_no_task_gets_the_crowd(spark, monkeypatch):
    monkeypatch.setattr(cluster, "HOT_ROWS", 50)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.uniform(0, 0.3, (600, 2)), rng.uniform(5, 30, (1200, 2))])
    pts = spark.createDataFrame([(i, r.tolist(), 1.0) for i, r in enumerate(x)], "id long, x array<double>, w double")
    hot = cluster.HotCells.of(pts, 2, 0.5, 5)
    assert hot.points.count() >= 500 and hot.others.count() + hot.points.count() == 1800
    assert cluster.HotCells.of(pts.where("id >= 600"), 2, 0.5, 5) is None

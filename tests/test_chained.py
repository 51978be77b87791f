"""Chained equations against a row-by-row numpy version; the bootstrap of bars against its normal interval."""

import numpy as np
import pytest

from kiln.operators import charts, clean


def plain_ridge(x, y):
    xm, ym = x.mean(axis=0), y.mean()
    a, b = x - xm, y - ym
    u, s, vt = np.linalg.svd(a, full_matrices=False)
    noise, width, old = 1 / (y.var() + np.finfo(float).eps), 1.0, None

    def solve():
        return vt.T @ (vt @ (a.T @ b) / (s ** 2 + width / noise))

    for _ in range(300):
        beta = solve()
        rss = ((b - a @ beta) ** 2).sum()
        used = (noise * s ** 2 / (width + noise * s ** 2)).sum()
        width = (used + 2e-6) / ((beta ** 2).sum() + 2e-6)
        noise = (len(y) - used + 2e-6) / (rss + 2e-6)
        if old is not None and np.abs(beta - old).sum() < 1e-3:
            break
        old = beta
    beta = solve()
    return beta, ym - xm @ beta


def plain_chain(data, max_iter=10, tol=1e-3):
    mask = np.isnan(data)
    x = np.where(mask, np.nanmean(data, axis=0), data)
    limit = tol * np.nanmax(np.abs(data))
    order = [c for c in np.argsort(mask.sum(axis=0), kind="stable") if mask[:, c].any()]
    for _ in range(max_iter):
        old = x.copy()
        for c in order:
            rest = [j for j in range(x.shape[1]) if j != c]
            beta, base = plain_ridge(x[~mask[:, c]][:, rest], x[~mask[:, c], c])
            x[mask[:, c], c] = x[mask[:, c]][:, rest] @ beta + base
        if np.abs(x - old).sum(axis=1).max() < limit:
            break
    return x


@pytest.mark.parametrize("rounds,patterns", [(1, 4096), (10, 4096), (10, 2)])
def test_chain_equals_numpy(spark, monkeypatch, rounds, patterns):
    monkeypatch.setattr(clean, "MAX_PATTERNS", patterns)
    rng = np.random.default_rng(2)
    z = rng.normal(size=(400, 2))
    full = np.column_stack([z[:, 0] * 3 + 50, z[:, 1], z.sum(axis=1) * 2 + rng.normal(size=400), z[:, 0] - z[:, 1] + 0.3 * rng.normal(size=400)])
    data = np.where(rng.random(full.shape) < [0.1, 0.3, 0.2, 0.0], np.nan, full)
    data[0, :3] = np.nan  # a row with one value
    rows = [(i, *[None if np.isnan(v) else float(v) for v in r], "x") for i, r in enumerate(data)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double, d double, p string").repartition(5)
    out = clean.impute_iterative(df, ["a", "b", "c", "d"], max_iter=rounds)
    assert out.columns == df.columns and out.count() == 400
    got = out.orderBy("id").select("a", "b", "c", "d").toPandas().to_numpy()
    assert np.allclose(got, plain_chain(data, rounds), atol=1e-6)


def test_chain_of_one_empty_and_whole_columns(spark):
    df = spark.createDataFrame([(1, 1.0, None, 2.0), (2, None, None, 4.0), (3, 3.0, None, 6.0)], "id int, a double, b double, c double")
    out = {r["id"]: r for r in clean.impute_iterative(df, ["a", "b"]).collect()}
    assert out[2]["a"] == 2.0 and out[1]["b"] is None
    same = clean.impute_iterative(df, ["c"])
    assert [r["c"] for r in same.orderBy("id").collect()] == [2.0, 4.0, 6.0]
    assert clean.impute_iterative(df.limit(0), ["a", "c"]).count() == 0


def test_bootstrap_by_values(spark):
    rng = np.random.default_rng(0)
    rows = [(i, "g" if i % 2 else "h", float(rng.integers(0, 50)) if i % 2 else float(rng.normal())) for i in range(4000)]
    df = spark.createDataFrame(rows, "id long, g string, y double")
    a = {r["g"]: r for r in charts.bar_bootstrap(df, "g", "y", ["id"]).collect()}
    normal = {r["g"]: r for r in charts.bar(df, "g", "y").collect()}
    for g in ("g", "h"):
        width = normal[g]["ci_high"] - normal[g]["ci_low"]
        assert abs(a[g]["ci_low"] - normal[g]["ci_low"]) < 0.1 * width and abs(a[g]["ci_high"] - normal[g]["ci_high"]) < 0.1 * width
    again = charts.bar_bootstrap(df.repartition(7), "g", "y", ["id"]).collect()
    assert all(abs(r["ci_low"] - a[r["g"]]["ci_low"]) < 1e-9 for r in again)

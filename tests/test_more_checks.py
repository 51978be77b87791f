"""Numpy checks of operators that have no SQL."""
from statistics import NormalDist

import numpy as np

from kiln.operators import charts, models, reduce


def test_pacf_is_yule_walker(spark):
    rng = np.random.default_rng(0)
    x = np.zeros(400)
    for i in range(2, 400):
        x[i] = 0.6 * x[i - 1] - 0.3 * x[i - 2] + rng.normal()
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double").repartition(3)
    got = [r["pacf"] for r in charts.pacf(df, "x", ["i"], 6).orderBy("lag").collect()]
    d = x - x.mean()
    r = np.array([(d[:len(d) - k] * d[k:]).sum() for k in range(7)]) / (d * d).sum()
    want = [1.0] + [np.linalg.solve(np.array([[r[abs(a - b)] for a in range(k)] for b in range(k)]), r[1:k + 1])[-1] for k in range(1, 7)]
    assert np.allclose(got, want, atol=1e-9)


def test_qq_points_and_fit(spark):
    rng = np.random.default_rng(1)
    x = rng.gamma(2.0, size=501)
    fit, pts = charts.qq(spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i long, x double"), "x", ["i"])
    n = len(x)
    m = (np.arange(1, n + 1) - 0.3175) / (n + 0.365)
    m[-1] = 0.5 ** (1 / n)
    m[0] = 1 - m[-1]
    q = np.array([NormalDist().inv_cdf(p) for p in m])
    got = np.array(sorted((r["osm"], r["osr"]) for r in pts.collect()))
    assert np.allclose(got[:, 0], q, atol=1e-6) and np.allclose(got[:, 1], np.sort(x))
    slope, intercept = np.polyfit(q, np.sort(x), 1)
    row = fit.first()
    assert abs(row["slope"] - slope) < 1e-6 and abs(row["intercept"] - intercept) < 1e-6 and row["n"] == n


def test_rfe_keeps_the_informative_features(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 4))
    y = (2.5 * x[:, 1] - 2 * x[:, 3] + 0.1 * rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), "yes" if t else "no") for r, t in zip(x, y)], "a double, b double, c double, d double, y string")
    out, m = models.rfe(df, "y", 2)
    assert m["selected_features"] == ["b", "d"] and out.columns == ["b", "d", "y"] and sorted(m["ranking"].values()) == [1, 1, 2, 3]


def test_pca_equals_eigenvectors(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(250, 6)) @ rng.normal(size=(6, 6)) + 40
    names = [f"c{i}" for i in range(6)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"{n} double" for n in names))
    out, m = reduce.pca_explore(df, names, 3)
    xc = x - x.mean(0)
    values, vectors = np.linalg.eigh(np.cov(xc.T))
    v = vectors[:, ::-1][:, :3]
    v = v * np.sign(v[np.abs(v).argmax(0), range(3)])
    assert np.allclose(np.sort(out.toPandas().to_numpy(), axis=0), np.sort(xc @ v, axis=0), atol=1e-8)
    assert np.allclose(list(m["explained_variance"].values()), values[::-1][:3] / values.sum())


def test_violin_density_and_pairplot_histograms(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("ab"[i % 2], float(v), float(v) ** 2) for i, v in enumerate(rng.normal(size=300))], "g string, x double, z double")
    v = charts.violin(df, "x", "g")
    for g, p in v["density"].toPandas().groupby("g"):
        p = p.sort_values("i")
        assert abs(np.trapezoid(p.density, p.x) - 0.5) < 0.01
    hist = charts.pairplot(df, ["x", "z"])["hist"]
    assert all(h.agg({"count": "sum"}).first()[0] == 300 for h in hist.values())

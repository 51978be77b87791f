import itertools
import math

import numpy as np
import pandas as pd

from kiln.functions.special import r_p_value
from kiln.operators import charts, correlate, rules
from kiln.operators.fuzzy import deduplicate_fuzzy, indel_ratio, lcs_length


def test_pearson_p_value(spark):
    df = spark.createDataFrame([(float(i), float(i * i % 7)) for i in range(30)], "a double, b double")
    r = correlate.pearson(df, "a", "b").first()
    x = np.arange(30.0)
    y = x * x % 7
    assert math.isclose(r["correlation"], np.corrcoef(x, y)[0, 1], rel_tol=1e-9)
    assert math.isclose(r["p_value"], r_p_value(r["correlation"], 30))


def test_spearman_average_ranks(spark):
    a = [1, 2, 2, 3, 5, 5, 5, 9]
    b = [3, 1, 4, 1, 5, 9, 2, 6]
    df = spark.createDataFrame(list(zip(map(float, a), map(float, b))), "a double, b double")
    ref = pd.Series(a).rank().corr(pd.Series(b).rank())
    assert math.isclose(correlate.spearman(df, "a", "b").first()["correlation"], ref, rel_tol=1e-12)


def test_cramers_v_yates_2x2(spark):
    rows = [("x", "p")] * 10 + [("x", "q")] * 3 + [("y", "q")] * 7
    df = spark.createDataFrame(rows, "a string, b string")
    obs = np.array([[10, 3], [0, 7]], dtype=float)
    e = obs.sum(1, keepdims=True) * obs.sum(0, keepdims=True) / obs.sum()
    adj = obs + np.minimum(0.5, np.abs(e - obs)) * np.sign(e - obs)
    chi2 = ((adj - e) ** 2 / e).sum()
    got = correlate.cramersv(df, "a", "b").first()["correlation"]
    assert math.isclose(got, math.sqrt(chi2 / 20), rel_tol=1e-12)


def test_itemsets_and_rules_brute_force(spark):
    rows = [("a", "x", "p"), ("a", "x", None), ("b", "x", "p"), ("a", "y", "p"), ("a", "x", "p")]
    df = spark.createDataFrame(rows, "c1 string, c2 string, c3 string")
    fi = {r["itemset"]: r["support"] for r in rules.frequent_itemsets(df, ["c1", "c2", "c3"], 0.4).collect()}
    baskets = [{f"c{i + 1}_{v}" for i, v in enumerate(r) if v is not None} for r in rows]
    items = sorted(set().union(*baskets))
    brute = {}
    for k in range(1, 4):
        for combo in itertools.combinations(items, k):
            s = sum(set(combo) <= b for b in baskets) / len(rows)
            if s >= 0.4:
                brute[",".join(sorted(combo))] = s
    assert fi == brute
    ru = rules.association_rules(rules.frequent_itemsets(df, ["c1", "c2", "c3"], 0.4), 0.5).collect()
    assert any("," in r["consequents"] for r in ru)


def test_histogram_matches_numpy(spark):
    x = np.random.default_rng(1).gamma(2.0, 3.0, 500)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    h = charts.histogram(df, "x").orderBy("bin").toPandas()
    counts, edges = np.histogram(x, bins="auto")
    assert h["count"].tolist() == counts.tolist()
    assert np.allclose(h.lower.tolist() + [h.upper.iloc[-1]], edges)


def test_acf_and_seasonal(spark):
    t = np.arange(60)
    x = np.sin(2 * np.pi * t / 12) * 5 + t * 0.1 + (t % 5)
    df = spark.createDataFrame([(int(i), float(v)) for i, v in zip(t, x)], "t long, x double")
    a = charts.acf(df.repartition(3), "x", ["t"], 5, block_rows=7).orderBy("lag").toPandas().acf
    d = x - x.mean()
    ref = [1.0] + [(d[:-k] * d[k:]).sum() / (d * d).sum() for k in range(1, 6)]
    assert np.allclose(a, ref)
    s = charts.seasonal_decompose(df.repartition(4), "x", ["t"], 12, block_rows=10).orderBy("position").toPandas()
    w = np.r_[0.5, np.ones(11), 0.5] / 12
    trend = np.convolve(x, w, mode="valid")
    assert np.allclose(s.trend[6:-6], trend) and s.trend[:6].isna().all()


def test_fuzzy_dedup_equals_greedy(spark):
    import random
    random.seed(5)
    words = ["kitten", "sitten", "sitting", "mitten", "kitchen", "smitten", "bitten"]
    rows = [(i, random.choice(words)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = sorted(r["id"] for r in deduplicate_fuzzy(df, "t", ["id"], 70).collect())
    kept = []
    for i, t in rows:
        if not any(indel_ratio(t, rows[k][1]) > 70 for k in kept):
            kept.append(i)
    assert got == kept
    assert lcs_length("AGGTAB", "GXTXAYB") == 4


def test_mutual_info_matches_brute_force(spark):
    from kiln.operators.mutual_info import _digamma, mutual_info_feature
    rng = np.random.default_rng(0)
    n = 240
    y = rng.integers(0, 3, n)
    x = rng.normal(size=n) + y * 0.8
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, y)], "x double, y int")
    xs = x / x.std()
    radius, kall, lc = np.empty(n), np.empty(n), np.empty(n)
    for lab in np.unique(y):
        msk = y == lab
        c = xs[msk]
        k = min(3, msk.sum() - 1)
        d = np.sort(np.abs(c[:, None] - c[None, :]), axis=1)
        radius[msk], kall[msk], lc[msk] = np.nextafter(d[:, k], 0), k, msk.sum()
    m = np.array([(np.abs(xs - xs[i]) <= radius[i]).sum() for i in range(n)])
    dg = np.vectorize(_digamma)
    ref = max(0, _digamma(n) + dg(kall).mean() - dg(lc).mean() - dg(m).mean())
    assert abs(mutual_info_feature(df, "x", "y") - ref) < 1e-6


def test_mutual_info_over_many_slices(spark):
    """Neighbours and balls across slices, ties without a radius, classes of two rows and of one, missing values."""
    from kiln.operators import mutual_info as M
    rng = np.random.default_rng(3)
    n = 700
    y = ["abc"[k] for k in rng.integers(0, 3, n)] + ["rare"] * 2 + ["once"]
    x = np.append(rng.normal(size=n) + np.array([ord(c) for c in y[:n]]) * 0.7, [60.0, 75.0, 68.0])
    x[:60] = 68.0  # ties, up to the noise
    rows = [(float(a), b) for a, b in zip(x, y)]
    df = spark.createDataFrame(rows + [(None, "a"), (float("nan"), "a"), (1.0, None)], "x double, y string")
    got = {M.mutual_info_feature(df.coalesce(1), "x", "y", block_rows=k) for k in (40, 1 << 20)}
    assert max(got) - min(got) < 1e-9
    keep = np.array([c != "once" for c in y])
    xs, lab = x[keep] / x.std(), np.array(y)[keep]
    xs = xs + rng.normal(size=len(xs)) * 1e-10 * max(1.0, np.abs(x).mean() / x.std())
    d = np.abs(xs[:, None] - xs[None, :])
    parts = []
    for i in range(len(xs)):
        own = np.sort(d[i][lab == lab[i]])
        k = min(3, len(own) - 1)
        parts.append(M._digamma(k) - M._digamma(len(own)) - M._digamma((d[i] < own[k] * (1 - 1e-12)).sum()))
    assert abs(got.pop() - max(0.0, M._digamma(len(xs)) + np.mean(parts))) < 0.02  # other noise among the ties


def test_mutual_info_holds_points_once(spark, monkeypatch):
    """No step of the estimate holds rows of several events for each point: what is checkpointed beside the packed slices is small."""
    from pyspark.sql.classic.dataframe import DataFrame as Held

    from kiln.operators.mutual_info import mutual_info_feature
    held, checkpoint = [], Held.checkpoint

    def counted(self, *a, **k):
        out = checkpoint(self, *a, **k)
        held.append(out.count())
        return out

    df = spark.range(30_000).selectExpr("cast(hash(id) as double) as x", "id % 3 as y")
    monkeypatch.setattr(Held, "checkpoint", counted)
    mutual_info_feature(df, "x", "y", block_rows=4_000)
    assert sum(held) < 3_000


def test_noise_is_that_of_the_whole_expression(spark):
    from pyspark.sql import functions as F

    from kiln.functions.special import norm_noise, norm_ppf_col
    df = spark.range(5_000).coalesce(1)
    u = (F.abs(F.xxhash64("id", F.monotonically_increasing_id())) % F.lit(1 << 30) + 0.5) / F.lit(float(1 << 30))
    want = df.select("id", norm_ppf_col(u).alias("z")).collect()
    assert want == norm_noise(df, u, "z").collect()

"""Mutual information between a continuous feature and class labels (N5),
by the nearest-neighbour estimator of Ross (2014) with 3 neighbours.

Per feature (scaled by its population std, jittered by 1e-10 noise as the
reference's library does, here from a per-row hash so that it is
repeatable):

* The points are dealt once, by ranges of their values, into slices of a
  bounded number of rows; a slice is kept as arrays in value order.
* r_i: distance to the k-th nearest point of the same class.  In one
  dimension those neighbours are among the k preceding and k following
  points of the class; a slice gets from the others the k last points of
  each class before it and the k first after it.
* m_i: points of any class strictly closer than r_i, the difference of the
  points below x + r and those up to x - r.  A bound inside the point's
  own slice is counted there, one between slices by the slices' totals,
  and only those inside another slice go to it.
* MI = psi(N) + <psi(k)> - <psi(N_class)> - <psi(m)>, clipped at 0.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.frames import lookup
from kiln.functions.special import norm_noise

K = 3
NOISE = 1.0
PROBES_EACH = 1 << 18  # probes from other slices that a slice answers in one row
PACKED = "slice int, n long, lo double, hi double, xs binary, cs binary, ids binary"
PACKED_ARROW = pa.schema([("slice", pa.int32()), ("n", pa.int64()), ("lo", pa.float64()), ("hi", pa.float64()),
                          ("xs", pa.binary()), ("cs", pa.binary()), ("ids", pa.binary())])


def digamma_col(x: Column) -> Column:
    """psi(x) for x >= 1: recurrence up to x + 6, then the asymptotic series."""
    shifted = x + 6
    inv = 1.0 / shifted
    inv2 = inv * inv
    series = (F.log(shifted) - 0.5 * inv - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252))))
    for j in range(6):
        series = series - 1.0 / (x + j)
    return series


def _digammas(x: np.ndarray) -> np.ndarray:
    """``digamma_col`` of an array."""
    shifted = x + 6
    inv = 1.0 / shifted
    inv2 = inv * inv
    series = np.log(shifted) - 0.5 * inv - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 * (1.0 / 252)))
    for j in range(6):
        series = series - 1.0 / (x + j)
    return series


def _packed(points: DataFrame, slices: int) -> DataFrame:
    """points(x, c) in slices of adjoining values, a row each: the values in order, and which of the slice's classes each has."""
    def pack(batches):
        parts = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not parts:
            return
        x, c = (np.concatenate(p) for p in zip(*parts))
        order = np.argsort(x, kind="stable")
        x, (ids, code) = x[order], np.unique(c[order], return_inverse=True)
        yield pa.RecordBatch.from_pylist([{
            "slice": TaskContext.get().partitionId(), "n": len(x), "lo": float(x[0]), "hi": float(x[-1]), "xs": x.tobytes(),
            "cs": code.astype(np.int32).tobytes(), "ids": ids.astype(np.int64).tobytes()}], PACKED_ARROW)

    return points.repartitionByRange(slices, "x").select("x", "c").mapInArrow(pack, PACKED).checkpoint(eager=True)


def _class_ends(packed: DataFrame) -> DataFrame:
    """(slice, c, head, tail): the first and the last K values of each class in each slice."""
    def ends(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, code, ids = np.frombuffer(r.xs), np.frombuffer(r.cs, np.int32), np.frombuffer(r.ids, np.int64)
                by = x[np.argsort(code, kind="stable")]
                at = np.append(0, np.cumsum(np.bincount(code, minlength=len(ids))))
                yield pd.DataFrame({"slice": r.slice, "c": ids,
                                    "head": [by[a:min(a + K, b)].tolist() for a, b in zip(at[:-1], at[1:])],
                                    "tail": [by[max(b - K, a):b].tolist() for a, b in zip(at[:-1], at[1:])]})

    return packed.select("slice", "xs", "cs", "ids").mapInPandas(ends, "slice int, c long, head array<double>, tail array<double>")


def _radii(x: np.ndarray, code: np.ndarray, ids: np.ndarray, halo) -> np.ndarray:
    """Distance of each point of a slice to the k-th nearest of its class; c % 4 is the k of class c."""
    near = {int(h["c"]): h for h in halo} if halo is not None else {}
    before = [(i, v) for i, c in enumerate(ids.tolist()) if c in near for v in list(near[c]["before"])[-K:]]
    after = [(i, v) for i, c in enumerate(ids.tolist()) if c in near for v in list(near[c]["after"])[:K]]
    cc = np.concatenate([np.array([i for i, _ in before], np.int64), code, np.array([i for i, _ in after], np.int64)])
    xx = np.concatenate([np.array([v for _, v in before], float), x, np.array([v for _, v in after], float)])
    order = np.argsort(cc, kind="stable")  # values stay in order inside a class
    cc, xx = cc[order], xx[order]
    d = np.full((2 * K, len(xx)), np.inf)
    for j in range(1, min(K, len(xx) - 1) + 1):
        gap = np.where(cc[j:] == cc[:-j], xx[j:] - xx[:-j], np.inf)
        d[j - 1, j:] = gap
        d[K + j - 1, :-j] = gap
    d.sort(axis=0)
    r = np.empty(len(xx))
    r[order] = d[(ids % 4)[cc] - 1, np.arange(len(xx))]
    return r[len(before):len(before) + len(x)]


def _ball_counts(packed: DataFrame, halo: DataFrame, bounds: list) -> tuple[float, int]:
    """(sum of psi(m), points) over all points, m being the points of any class in the open ball of a point's radius."""
    slices = np.array([b["slice"] for b in bounds], np.int64)
    lo, hi, n = (np.array([b[c] for b in bounds]) for c in ("lo", "hi", "n"))
    below = np.append(0, np.cumsum(n))

    def counted(v, strict, x, own):
        """Points below v (up to v, unless strict), and the place of the slice that v lies in if that is not ``own`` (else -1)."""
        t = np.searchsorted(lo, v, "right") - 1
        out = np.where(t < 0, 0, below[t + 1])  # past the end of slice t
        inside = (t >= 0) & (v <= hi[t])
        at = np.where(strict, np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")) + below[own]
        return np.where(inside & (t == own), at, out), np.where(inside & (t != own), t, -1)

    def balls(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, code, ids = np.frombuffer(r.xs), np.frombuffer(r.cs, np.int32), np.frombuffer(r.ids, np.int64)
                own = int(np.searchsorted(slices, r.slice))
                # the k-th neighbour itself sits at distance r and must stay outside the
                # open ball; x +- r is rounded, so the radius is pulled in by 1e-12
                rad = _radii(x, code, ids, r.halo) * (1 - 1e-12)
                open_ = rad > 0
                upper, up_in = counted(x + rad, open_, x, own)
                lower, low_in = counted(x - rad, ~open_, x, own)
                done = (up_in < 0) & (low_in < 0)
                yield pd.DataFrame({"pid": [-1], "t": [-1], "v": [0.0], "strict": [False], "sign": [0],
                                    "m": [int(done.sum())], "psi": [float(_digammas((upper - lower)[done].astype(float)).sum())]})
                for to, v, strict, sign, other, other_in in ((up_in, x + rad, open_, 1, -lower, low_in), (low_in, x - rad, ~open_, -1, upper, up_in)):
                    i = np.flatnonzero(to >= 0)  # the other side's count goes along where it is known
                    yield pd.DataFrame({"pid": (np.int64(own) << 32) + i, "t": slices[to[i]], "v": v[i], "strict": strict[i], "sign": sign,
                                        "m": np.where(other_in[i] < 0, other[i], 0), "psi": 0.0})

    def answered(batches):
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                x, own = np.frombuffer(r.xs), int(np.searchsorted(slices, r.slice))
                v, strict, sign = np.array(r.v, float), np.array(r.strict, bool), np.array(r.sign, np.int64)
                at = np.where(strict, np.searchsorted(x, v, "left"), np.searchsorted(x, v, "right")) + below[own]
                yield pd.DataFrame({"pid": np.array(r.pid, np.int64), "m": np.array(r.m, np.int64) + sign * at})

    out = lookup(packed.select("slice", "xs", "cs", "ids"), halo, ["slice"]).mapInPandas(
        balls, "pid long, t int, v double, strict boolean, sign int, m long, psi double").checkpoint(eager=True)
    total = out.where("t < 0").agg(F.sum("m").alias("n"), F.sum("psi").alias("psi")).first()
    probes = out.where("t >= 0")
    counts = probes.groupBy("t").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBES_EACH)).alias("parts"))
    asked = (lookup(probes, counts, ["t"]).groupBy(F.col("t").alias("slice"), F.pmod(F.xxhash64("pid"), F.col("parts")).alias("part"))
             .agg(F.collect_list(F.struct("pid", "v", "strict", "sign", "m")).alias("_q"))
             .select("slice", *[F.col(f"_q.{c}").alias(c) for c in ("pid", "v", "strict", "sign", "m")]))
    far = lookup(packed.select("slice", "xs"), asked, ["slice"], "inner").mapInPandas(answered, "pid long, m long")
    rest = (far.groupBy("pid").agg(F.sum("m").alias("m"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(digamma_col(F.col("m").cast("double"))).alias("psi")).first())
    return (total["psi"] or 0.0) + (rest["psi"] or 0.0), (total["n"] or 0) + rest["n"]


def mutual_info_feature(df: DataFrame, feature: str, target: str, seed: int = 0,
                        block_rows: int = 1 << 18) -> float:
    from kiln.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    data = df.select(F.col(feature).cast("double").alias("x0"), F.col(target).alias("y")).na.drop()
    st = data.agg(F.stddev_pop("x0").alias("sd"), F.avg(F.abs("x0")).alias("ma")).collect()[0]
    sd = st["sd"] or 1.0
    if not math.isfinite(sd):
        raise ValueError(f"Input {feature} contains infinity")
    scale_mean = (st["ma"] or 0.0) / sd
    noise_amp = 1e-10 * max(1.0, scale_mean) * NOISE
    uid = F.monotonically_increasing_id()
    u = (F.abs(F.xxhash64(F.col("x0"), F.col("y"), uid, F.lit(seed))) % F.lit(1 << 30) + 0.5) / F.lit(float(1 << 30))
    data = norm_noise(data, u, "z").select("y", (F.col("x0") / F.lit(sd) + F.lit(noise_amp) * F.col("z")).alias("x"))
    k = F.least(F.lit(K), F.col("ny") - 1)
    counts = (data.groupBy("y").agg(F.count(F.lit(1)).alias("ny")).where(F.col("ny") > 1)
              .withColumn("c", F.monotonically_increasing_id() * 4 + k).checkpoint(eager=True))
    tot = counts.agg(
        F.sum("ny").alias("n"), F.sum(F.col("ny") * digamma_col(k.cast("double"))).alias("pk"),
        F.sum(F.col("ny") * digamma_col(F.col("ny").cast("double"))).alias("py")).first()
    n = tot["n"]
    if not n:
        return 0.0
    conf = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    points = lookup(data, counts.select("y", "c"), ["y"], "inner").select("x", "c")
    packed = _packed(points, max(-(-n // block_rows), min(conf, -(-n // 20_000))))
    w = Window.partitionBy("c").orderBy("slice")  # a row per slice at most
    halo = (_class_ends(packed).select(
        "slice", F.struct("c", F.flatten(F.collect_list("tail").over(w.rowsBetween(-K, -1))).alias("before"),
                          F.flatten(F.collect_list("head").over(w.rowsBetween(1, K))).alias("after")).alias("h"))
            .groupBy("slice").agg(F.collect_list("h").alias("halo")))
    psi, seen = _ball_counts(packed, halo, packed.select("slice", "n", "lo", "hi").orderBy("slice").collect())
    assert seen == n, (seen, n)
    return max(0.0, _digamma(float(n)) + (tot["pk"] - tot["py"] - psi) / n)


def _digamma(x: float) -> float:
    acc = 0.0
    while x < 6:
        acc -= 1.0 / x
        x += 1
    inv2 = 1.0 / (x * x)
    return acc + math.log(x) - 0.5 / x - inv2 * (1.0 / 12 - inv2 * (1.0 / 120 - inv2 / 252))


def mutual_info_scores(df: DataFrame, target: str, features: list[str], seed: int = 0) -> dict[str, float]:
    return {c: mutual_info_feature(df, c, target, seed) for c in features}

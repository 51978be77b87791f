"""Exact quantiles without collecting a column into one task.

pandas ``quantile`` (and DuckDB ``quantile_cont``, Spark ``percentile``)
interpolate linearly between the order statistics at ranks
``floor((n-1)p)`` and ``ceil((n-1)p)``.  Spark's exact ``percentile``
merges a value->count map of the whole column into one task, which does
not survive a 100 TB column.  We therefore select order statistics by
narrowing:

1. one aggregate gives ``count/min/max`` per column (and group);
2. while an interval holds more than ``max_collect`` values, one pass
   counts values per equal-width bucket of the interval (``groupBy`` of
   at most targets x buckets keys, partially aggregated map-side) and the
   interval shrinks to the bucket holding the wanted rank;
3. a last pass sorts the at most ``max_collect`` values left in each
   interval and picks the rank.

Bucket assignment is monotone in the value, so each bucket's actual
min/max bound exactly the values in it, and the result is exact.  When
every group holds at most ``max_collect`` values, each group's values are
sorted once in one aggregate (already bounded) and the ranks read directly.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_COLLECT = 1_000_000
BUCKETS = 2048
MAX_ROUNDS = 64


@dataclass
class _Target:
    tid: int
    column: str
    gkey: str
    rank: int          # 0-based rank among non-null values of the group
    lo: float
    hi: float
    below: int = 0     # values strictly below ``lo`` in the group
    count: int = 0     # values inside [lo, hi]
    value: float | None = None


def _gkey(group_cols: list[str]) -> Column:
    if not group_cols:
        return F.lit("")
    # a NULL group is a group of its own; the key only has to be unique
    return F.concat_ws("\u0001", *[F.coalesce(F.col(g).cast("string"), F.lit("\u0000"))
                                   for g in group_cols])


def _interp(v_lo: float, v_hi: float, frac: float) -> float:
    if frac == 0.0 or v_lo == v_hi:
        return float(v_lo)
    return float(v_lo + (v_hi - v_lo) * frac)


def _ranks(n: int, p: float) -> tuple[int, int, float]:
    h = (n - 1) * p
    lo = math.floor(h)
    return lo, math.ceil(h), h - lo


def quantiles(df: DataFrame, requests: dict[str, list[float]],
              max_collect: int = MAX_COLLECT, buckets: int = BUCKETS,
              base: dict[str, tuple[int, float, float]] | None = None) -> dict[str, list[float | None]]:
    """Exact linear-interpolation quantiles for several columns at once.

    ``base`` may carry ``(count, min, max)`` per column already computed by
    a fused fit, saving one pass.
    """
    out = grouped_quantiles(df, requests, [], max_collect=max_collect,
                            buckets=buckets, base=base)
    return {c: out.get(("",), {}).get(c, [None] * len(ps)) for c, ps in requests.items()}


def grouped_quantiles(df: DataFrame, requests: dict[str, list[float]], group_cols: list[str],
                      max_collect: int = MAX_COLLECT, buckets: int = BUCKETS,
                      base: dict[str, tuple[int, float, float]] | None = None,
                      max_groups: int | None = None):
    """Exact quantiles per group.

    Returns ``{group_tuple: {column: [q for p in probs]}}``; ungrouped
    calls use the key ``("",)``.  The answer holds a few numbers per group
    on the driver; ``max_groups`` makes more of them an error.
    """
    cols = list(requests)
    key = _gkey(group_cols).alias("_g")
    if base is not None and not group_cols and all(c in base for c in cols):
        stats = {("",): {c: base[c] for c in cols}}
        gvals = {("",): ()}
    else:
        aggs = []
        for i, c in enumerate(cols):
            aggs += [F.count(c).alias(f"n{i}"), F.min(c).cast("double").alias(f"a{i}"),
                     F.max(c).cast("double").alias(f"b{i}")]
        g = df.groupBy(key, *group_cols).agg(*aggs)
        rows = (g if max_groups is None else g.limit(max_groups + 1)).collect()
        if max_groups is not None and len(rows) > max_groups:
            raise ValueError(f"more than {max_groups} groups for a grouped quantile")
        stats, gvals = {}, {}
        for r in rows:
            stats[(r["_g"],)] = {c: (r[f"n{i}"], r[f"a{i}"], r[f"b{i}"]) for i, c in enumerate(cols)}
            gvals[(r["_g"],)] = tuple(r[gc] for gc in group_cols)

    biggest = max((s[c][0] for s in stats.values() for c in cols), default=0)
    result: dict = {}
    if biggest <= max_collect:
        # every group is bounded: sort its values once (one task per group
        # holds at most max_collect values) and read the two ranks around
        # each quantile, interpolating in the same projection
        aggs = [F.sort_array(F.collect_list(F.col(c).cast("double"))).alias(f"v{i}") for i, c in enumerate(cols)]
        sel = []
        for i, c in enumerate(cols):
            arr = F.col(f"v{i}")
            n = F.size(arr)
            for j, p in enumerate(requests[c]):
                h = (n - 1).cast("double") * F.lit(float(p))
                lo, hi = F.floor(h), F.ceil(h)
                a = F.element_at(arr, (lo + 1).cast("int"))
                b = F.element_at(arr, (hi + 1).cast("int"))
                sel.append(F.when(n > 0, F.when(lo == hi, a).otherwise(a + (b - a) * (h - lo))).alias(f"q{i}_{j}"))
        for r in df.groupBy(key).agg(*aggs).select("_g", *sel).collect():
            result[(r["_g"],)] = {c: [r[f"q{i}_{j}"] for j in range(len(requests[c]))] for i, c in enumerate(cols)}
        return _regroup(result, gvals, group_cols)

    targets: list[_Target] = []
    plan = {}
    for gk, s in stats.items():
        for c in cols:
            n, a, b = s[c]
            for p in requests[c]:
                if not n:
                    plan[(gk, c, p)] = None
                    continue
                lo, hi, frac = _ranks(n, p)
                ids = []
                for r in (lo, hi):
                    t = _Target(len(targets), c, gk[0], r, a, b, 0, n)
                    targets.append(t)
                    ids.append(t.tid)
                plan[(gk, c, p)] = (ids[0], ids[1], frac)

    for _ in range(MAX_ROUNDS):
        active = [t for t in targets if t.value is None and t.count > max_collect and t.lo < t.hi]
        if not active:
            break
        hist = _histogram(df, active, group_cols, buckets)
        for t in active:
            cum = t.below
            for idx, cnt, mn, mx in hist.get(t.tid, []):
                if cum + cnt > t.rank:
                    t.lo, t.hi, t.below, t.count = mn, mx, cum, cnt
                    break
                cum += cnt
    for t in targets:
        if t.value is None and t.lo == t.hi:
            t.value = t.lo
    pending = [t for t in targets if t.value is None]
    if pending:
        picked = _pick(df, pending, group_cols)
        for t in pending:
            t.value = picked[t.tid]

    for (gk, c, p), ref in plan.items():
        vals = result.setdefault(gk, {}).setdefault(c, [])
        if ref is None:
            vals.append(None)
        else:
            i, j, frac = ref
            vals.append(_interp(targets[i].value, targets[j].value, frac))
    return _regroup(result, gvals, group_cols)


def _regroup(result, gvals, group_cols):
    if not group_cols:
        return result
    return {gvals[k]: v for k, v in result.items()}


def _with_targets(df: DataFrame, ts: list[_Target], group_cols: list[str]) -> DataFrame:
    """Each row with the targets of its own group only: (tid, x, lo, hi, k).  Targets reach rows by a join on the group (a
    literal where there are no groups), never all targets for every row."""
    spark = df.sparkSession
    cols = list(dict.fromkeys(t.column for t in ts))
    if not group_cols:
        structs = [F.struct(F.lit(t.tid).alias("tid"), F.col(t.column).cast("double").alias("x"), F.lit(float(t.lo)).alias("lo"),
                            F.lit(float(t.hi)).alias("hi"), F.lit(int(t.rank - t.below + 1)).alias("k")) for t in ts]
        rows = df.select(F.explode(F.array(*structs)).alias("t")).select("t.*")
    else:
        from kiln.functions.frames import lookup
        own: dict[str, list] = {}
        for t in ts:
            own.setdefault(t.gkey, []).append((t.tid, cols.index(t.column), float(t.lo), float(t.hi), int(t.rank - t.below + 1)))
        table = spark.createDataFrame(list(own.items()), "_g string, _t array<struct<tid:int,c:int,lo:double,hi:double,k:bigint>>")
        data = df.select(_gkey(group_cols).alias("_g"), F.array(*[F.col(c).cast("double") for c in cols]).alias("_x"))
        rows = lookup(data, table, ["_g"], "inner").select("_x", F.explode("_t").alias("t")).select(
            "t.tid", F.get("_x", F.col("t.c")).alias("x"), "t.lo", "t.hi", "t.k")
    return rows.where(F.col("x").between(F.col("lo"), F.col("hi")))


def _histogram(df: DataFrame, ts: list[_Target], group_cols: list[str], buckets: int):
    rows = (_with_targets(df, ts, group_cols)
            .select("tid", "x", F.least(F.floor((F.col("x") - F.col("lo")) / ((F.col("hi") - F.col("lo")) / F.lit(float(buckets)))),
                                        F.lit(buckets - 1)).alias("idx"))
            .groupBy("tid", "idx")
            .agg(F.count("*").alias("cnt"), F.min("x").alias("mn"), F.max("x").alias("mx"))
            .collect())
    hist: dict[int, list] = {}
    for r in rows:
        hist.setdefault(r["tid"], []).append((r["idx"], r["cnt"], r["mn"], r["mx"]))
    for v in hist.values():
        v.sort()
    return hist


def _pick(df: DataFrame, ts: list[_Target], group_cols: list[str]) -> dict[int, float]:
    rows = (_with_targets(df, ts, group_cols).groupBy("tid", "k")
            # at most max_collect values per target, by construction
            .agg(F.sort_array(F.collect_list("x")).alias("v"))
            .select("tid", F.element_at("v", F.col("k").cast("int")).alias("val"))
            .collect())
    return {r["tid"]: r["val"] for r in rows}


def order_statistics(df: DataFrame, column: str, ranks: list[int], max_collect: int = MAX_COLLECT,
                     buckets: int = BUCKETS) -> list[float | None]:
    """Exact values at 0-based ``ranks`` among the non-null values of
    ``column`` (ascending), by the same bounded narrowing as ``quantiles``."""
    st = df.agg(F.count(column).alias("n"), F.min(F.col(column).cast("double")).alias("a"),
                F.max(F.col(column).cast("double")).alias("b")).collect()[0]
    n, a, b = st["n"], st["a"], st["b"]
    targets = [_Target(i, column, "", int(r), a, b, 0, n) for i, r in enumerate(ranks) if n and 0 <= r < n]
    for _ in range(MAX_ROUNDS):
        active = [t for t in targets if t.count > max_collect and t.lo < t.hi]
        if not active:
            break
        hist = _histogram(df, active, [], buckets)
        for t in active:
            cum = t.below
            for idx, cnt, mn, mx in hist.get(t.tid, []):
                if cum + cnt > t.rank:
                    t.lo, t.hi, t.below, t.count = mn, mx, cum, cnt
                    break
                cum += cnt
    for t in targets:
        if t.lo == t.hi:
            t.value = t.lo
    pending = [t for t in targets if t.value is None]
    if pending:
        picked = _pick(df, pending, [])
        for t in pending:
            t.value = picked[t.tid]
    by_rank = {t.rank: t.value for t in targets}
    return [by_rank.get(int(r)) for r in ranks]

"""Isolation Forest (Liu, Ting & Zhou, 2008) for O5 and O9.

* Fit: a bounded pre-sample (about 2 x trees x max_samples rows, whatever
  the table size), from which every tree draws its own ~max_samples rows
  by a per-(row, tree) hash; ``groupBy(tree).applyInPandas`` grows the
  trees in parallel (each task sees at most ``max_samples`` rows).
* The forest (``trees`` x at most ``2 * max_samples`` nodes) is small; it
  is broadcast inside a vectorised Arrow UDF that scores every row.
* The threshold is the exact (1 - contamination) quantile of the scores,
  as the reference's library sets its offset on the training scores.
"""

from __future__ import annotations

import json
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.quantile import quantiles

EULER = 0.5772156649015329


def c_factor(n: float) -> float:
    """Average path length of an unsuccessful BST search over n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + EULER) - 2.0 * (n - 1.0) / n


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
    feat, thr, left, right, size = [], [], [], [], []

    def node(idx: np.ndarray, depth: int) -> int:
        me = len(feat)
        feat.append(-1)
        thr.append(0.0)
        left.append(-1)
        right.append(-1)
        size.append(int(len(idx)))
        if depth >= limit or len(idx) <= 1:
            return me
        sub = x[idx]
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.flatnonzero(hi > lo)
        if len(cand) == 0:
            return me
        f = int(rng.choice(cand))
        t = float(rng.uniform(lo[f], hi[f]))
        mask = sub[:, f] < t
        feat[me], thr[me] = f, t
        left[me] = node(idx[mask], depth + 1)
        right[me] = node(idx[~mask], depth + 1)
        return me

    node(np.arange(len(x)), 0)
    return {"feature": feat, "threshold": thr, "left": left, "right": right, "size": size}


def fit_forest(df: DataFrame, columns: list[str], trees: int = 100, max_samples: int = 256,
               seed: int = 0) -> tuple[list[dict], int]:
    data = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).na.drop()
    n = data.count()
    psi = min(max_samples, n)
    # each tree needs its own sample of ~psi rows (rows may serve several
    # trees): a bounded pre-sample of ~2 * trees * psi rows, then every kept
    # row joins each tree independently with probability psi / (rows kept)
    frac = min(1.0, 2.0 * trees * psi / max(n, 1))
    sample = data.sample(False, frac, seed=seed) if frac < 1.0 else data
    q = min(1.0, psi / max(n * frac, 1.0))
    rid = F.monotonically_increasing_id()
    per_tree = sample.select(*columns, rid.alias("_rid"),
                             F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("_tree"))
    u = (F.abs(F.xxhash64("_rid", "_tree", F.lit(seed))) % F.lit(1 << 30)) / F.lit(float(1 << 30))
    dealt = per_tree.where(u < F.lit(q)).drop("_rid").withColumn("_tree", F.col("_tree").cast("int"))
    limit = int(math.ceil(math.log2(max(psi, 2))))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        rng = np.random.default_rng(seed * 100003 + tree)
        x = pdf[columns].to_numpy(dtype=float)
        if len(x) > psi:
            x = x[rng.choice(len(x), psi, replace=False)]
        return pd.DataFrame({"_tree": [tree], "spec": [json.dumps(_grow(x, rng, limit))]})

    rows = dealt.groupBy("_tree").applyInPandas(grow, "_tree int, spec string").collect()
    return [json.loads(r["spec"]) for r in rows], psi


def _leaf_steps(t: dict) -> tuple[np.ndarray, np.ndarray]:
    """For a one-feature tree: sorted split points and the path length
    (depth + c(leaf size)) on each interval between them."""
    bounds, values = [], []

    def walk(node: int, depth: int) -> None:
        if t["feature"][node] < 0:
            values.append(depth + c_factor(t["size"][node]))
            return
        walk(t["left"][node], depth + 1)
        bounds.append(t["threshold"][node])
        walk(t["right"][node], depth + 1)

    walk(0, 0)
    return np.asarray(bounds, dtype=float), np.asarray(values, dtype=float)


def score_column(forest: list[dict], psi: int, columns: list[str]):
    """An Arrow UDF giving the anomaly score 2^(-E[h(x)] / c(psi)).

    With one feature every tree is a step function of x, so the forest's
    mean path length is one merged step function: each row costs a single
    binary search.  Several features traverse the trees vectorised."""
    denom = c_factor(psi)
    if len(columns) == 1:
        steps = [_leaf_steps(t) for t in forest]
        merged = np.unique(np.concatenate([b for b, _ in steps])) if steps else np.array([])
        probe = np.concatenate([[-np.inf], merged])
        total = np.zeros(len(probe))
        for b, v in steps:
            total += v[np.searchsorted(b, probe, side="right")]
        level = np.power(2.0, -(total / max(len(forest), 1)) / denom)

        @F.pandas_udf(T.DoubleType())
        def _score1(x: pd.Series) -> pd.Series:
            return pd.Series(level[np.searchsorted(merged, x.to_numpy(dtype=float), side="right")])

        return _score1(F.col(columns[0]).cast("double"))

    arrays = [{**{k: np.asarray(v) for k, v in t.items()},
               "leaf_c": np.array([c_factor(n) for n in t["size"]])} for t in forest]

    @F.pandas_udf(T.DoubleType())
    def _score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        total = np.zeros(len(x))
        for t in arrays:
            node = np.zeros(len(x), dtype=int)
            depth = np.zeros(len(x))
            active = t["feature"][node] >= 0
            while active.any():
                idx = np.flatnonzero(active)
                f = t["feature"][node[idx]]
                go_left = x[idx, f] < t["threshold"][node[idx]]
                node[idx] = np.where(go_left, t["left"][node[idx]], t["right"][node[idx]])
                depth[idx] += 1
                active = t["feature"][node] >= 0
            total += depth + t["leaf_c"][node]
        return pd.Series(np.power(2.0, -(total / len(arrays)) / denom))

    return _score(*[F.col(c).cast("double") for c in columns])


def isolation_scores(df: DataFrame, columns: list[str], contamination: float = 0.1, trees: int = 100,
                     max_samples: int = 256, seed: int = 0) -> tuple[DataFrame, float]:
    forest, psi = fit_forest(df, columns, trees, max_samples, seed)
    complete = F.lit(True)
    for c in columns:
        complete = complete & F.col(c).isNotNull()
    scored = df.withColumn("anomaly_score", F.when(complete, score_column(forest, psi, columns)))
    # the quantile reads the scores several times: keep them, and only them, once
    from kiln.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    scores = scored.select("anomaly_score").checkpoint(eager=True)
    thr = quantiles(scores, {"anomaly_score": [1.0 - contamination]})["anomaly_score"][0]
    return scored, thr


def detect_isolation_forest(df: DataFrame, column: str, contamination: float = 0.05, seed: int = 0) -> DataFrame:
    """The flagged values (score above the contamination quantile)."""
    data = df.select(column).where(F.col(column).isNotNull())
    scored, thr = isolation_scores(data, [column], contamination, seed=seed)
    return scored.where(F.col("anomaly_score") > F.lit(thr)).select(column)


def isolation_forest_clean(df: DataFrame, column: str, action: str = "remove", contamination: float = 0.1,
                           seed: int = 0) -> DataFrame:
    """Remove flagged rows, or set their value missing."""
    scored, thr = isolation_scores(df, [column], contamination, seed=seed)
    flagged = F.col("anomaly_score") > F.lit(thr)
    if action == "remove":
        return scored.where(~flagged | F.col("anomaly_score").isNull()).drop("anomaly_score")
    return scored.withColumn(column, F.when(flagged, F.lit(None)).otherwise(F.col(column))).drop("anomaly_score")

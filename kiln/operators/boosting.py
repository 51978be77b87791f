"""Gradient boosting (M6) on binned histograms, one tree per class and stage.

Trees look at bin numbers only, so rows of equal bins have equal scores
whatever the stage: they are one point with its class counts (or rows, mean
and squared deviations).  Points are kept as blocks with their scores.  A level of a
stage is one pass: tasks compute the gradients of all classes from the
scores (softmax, logistic or squared loss), add up (rows, gradients,
curvatures) per class, node, feature and bin, and Spark adds those over
the tasks and picks each feature's best cut.  Leaf values are Newton steps
from the same sums.  The trees of the last ``KEEP`` stages are applied on
the fly; then the scores are written anew to the shared checkpoint folder.
"""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.operators.trees import LEAF, best_binned_cut, clean, midpoint, route
from kiln.session import ensure_checkpoint_dir

BINS = 255            # cuts per feature at most
EDGE_SAMPLE = 50_000  # rows that the cuts are taken from (all rows, if fewer)
KEEP = 10             # stages between two writes of the scores
BLOCK_ROWS = 1 << 16  # points of a block
LEAST_CELLS = 1 << 18 # points x features of a task, until all cores have one
TASK_CELLS = 1 << 23  # points x features of a task at most
CODE_BITS = 12        # cuts of a tree that is applied by one lookup


# ------------------------------------------------------------- losses

def start_scores(classes: int, share: np.ndarray, mean: float) -> np.ndarray:
    """Scores before the first stage: log shares of the classes, the log odds, or the mean."""
    if classes > 2:
        return np.log(np.maximum(share, 1e-300))
    return np.array([np.log(share[1] / share[0]) if 0 < share[1] < 1 else (20.0 if share[1] else -20.0)]) if classes == 2 else np.array([mean])


def gradients(classes: int, y: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(negative gradients, curvatures, loss) of rows x trees."""
    if classes > 2:
        z = scores - scores.max(axis=1, keepdims=True)
        e = np.exp(z)
        p = e / e.sum(axis=1, keepdims=True)
        mine = np.zeros_like(p)
        mine[np.arange(len(y)), y.astype(int)] = 1.0
        loss = float((np.log(e.sum(axis=1)) - z[np.arange(len(y)), y.astype(int)]).sum())
        return mine - p, p * (1 - p), loss
    if classes == 2:
        f = scores[:, 0]
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        return (y - p)[:, None], (p * (1 - p))[:, None], float(np.logaddexp(0, np.where(y > 0, -f, f)).sum())
    r = y - scores[:, 0]
    return r[:, None], np.ones((len(y), 1)), float((r ** 2).sum() / 2)


def point_gradients(classes: int, sums: np.ndarray, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """``gradients`` added up over the rows of each point; ``sums`` (points x numbers) as ``_points`` has them."""
    if classes:
        rows = sums.sum(axis=1)
        if classes > 2:
            z = scores - scores.max(axis=1, keepdims=True)
            e = np.exp(z)
            p = e / e.sum(axis=1, keepdims=True)
            loss = float((rows * np.log(e.sum(axis=1))).sum() - (sums * z).sum())
            return sums - rows[:, None] * p, rows[:, None] * (p * (1 - p)), loss
        f = scores[:, 0]
        p = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        loss = float((sums[:, 1] * np.logaddexp(0, -f) + sums[:, 0] * np.logaddexp(0, f)).sum())
        return (sums[:, 1] - rows * p)[:, None], (rows * (p * (1 - p)))[:, None], loss
    rows, mean, squares = sums.T
    r = mean - scores[:, 0]
    return (rows * r)[:, None], rows[:, None], float((squares + rows * r ** 2).sum() / 2)


def step_size(classes: int, gradient: float, curvature: float) -> float:
    """The Newton step of a leaf."""
    if abs(curvature) < 1e-150:
        return 0.0
    return gradient / curvature * ((classes - 1) / classes if classes > 2 else 1.0)


# ------------------------------------------------------------- bins

def cut_points(data: DataFrame, rows: int) -> list[np.ndarray]:
    """At most ``BINS`` cuts per feature of ``data(x array)``: between all neighbouring values, or between quantiles of a sample."""
    share = min(1.0, EDGE_SAMPLE / max(rows, 1))
    picked = data if share == 1.0 else data.where(F.abs(F.xxhash64(F.col("x"), F.col("rid"), F.lit(7))) % 1_000_000 < int(share * 1_000_000))

    def cuts(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.unique(clean(pdf["v"].to_numpy(float)))
        if len(v) - 1 > BINS:
            v = np.unique(np.quantile(clean(pdf["v"].to_numpy(float)), np.linspace(0, 1, BINS + 1), method="inverted_cdf"))
        return pd.DataFrame({"f": [int(pdf["f"].iloc[0])], "cuts": [midpoint(v[:-1], v[1:]).tolist()]})

    rows_ = picked.select(F.posexplode("x").alias("f", "v")).groupBy("f").applyInPandas(cuts, "f int, cuts array<double>").collect()
    found = {r["f"]: np.asarray(r["cuts"], dtype=float) for r in rows_}
    return [found[f] for f in range(len(found))]


def _points(data: DataFrame, cuts: list[np.ndarray], classes: int) -> DataFrame:
    """(bins, s0, s1, ..): a row for each combination of bins that occurs, with the rows of each class, or their number, the mean
    target and its squared deviations."""
    d = len(cuts)

    def binned(batches):
        for batch in batches:
            n = batch.num_rows
            if n:
                x = clean(batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, d))
                b = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)], axis=1).astype(np.uint8)
                bins = pa.FixedSizeBinaryArray.from_buffers(pa.binary(d), n, [None, pa.py_buffer(b.tobytes())]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([bins, batch.column(1)], ["bins", "y"])

    y = F.col("y")
    numbers = [F.count_if(y == k) for k in range(classes)] if classes else [F.count(y), F.avg(y), F.var_pop(y) * F.count(y)]
    return data.select("x", "y").mapInArrow(binned, "bins binary, y double").groupBy("bins").agg(
        *[v.cast("double").alias(f"s{j}") for j, v in enumerate(numbers)])


def _blocks(points: DataFrame, d: int, start: np.ndarray) -> DataFrame:
    """(n, bins, sums, scores): blocks of points as binary columns, feature by feature, number by number and tree by tree."""
    def pack(batches):
        held, rows = [], 0

        def block():
            b, v = (np.concatenate(p) for p in zip(*held))
            return pd.DataFrame({"n": [len(v)], "bins": [np.ascontiguousarray(b.T).tobytes()], "sums": [np.ascontiguousarray(v.T).tobytes()],
                                 "scores": [np.repeat(start, len(v)).tobytes()]})

        for pdf in batches:
            if len(pdf):
                held.append((np.frombuffer(b"".join(pdf["bins"]), np.uint8).reshape(-1, d), pdf.drop(columns="bins").to_numpy(float)))
                rows += len(pdf)
                if rows >= BLOCK_ROWS:
                    yield block()
                    held, rows = [], 0
        if held:
            yield block()

    return points.mapInPandas(pack, "n long, bins binary, sums binary, scores binary")


def _unpack(r, d: int, trees: int):
    """The block's bins (features x points), numbers (points x numbers) and scores (trees x points)."""
    return np.frombuffer(r.bins, np.uint8).reshape(d, -1), np.frombuffer(r.sums, float).reshape(-1, r.n).T, np.frombuffer(r.scores, float).reshape(trees, -1).copy()


def paths(tree: dict, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, code): the leaf (or open node) of every row of ``bins`` (features x rows) is ``nodes[code]``.

    A code holds a bit for each cut, one comparison of a whole column; ``nodes`` has the end of each combination of bits."""
    cuts = np.flatnonzero(tree["feature"] >= 0)  # parents come before their children
    if len(cuts) > CODE_BITS:
        return np.arange(len(tree["feature"])), route({**tree, "threshold": tree["bin"]}, bins.T)
    code = np.zeros(bins.shape[1], dtype=np.uint8 if len(cuts) <= 8 else np.uint16)
    nodes, combination = np.zeros(1 << len(cuts), dtype=np.int64), np.arange(1 << len(cuts))
    for bit, i in enumerate(cuts):
        code |= (bins[tree["feature"][i]] > tree["bin"][i]).astype(code.dtype) << code.dtype.type(bit)
        here = nodes == i
        nodes[here] = np.where(combination[here] >> bit & 1, tree["right"][i], tree["left"][i])
    return nodes, code


def _add_trees(scores: np.ndarray, bins: np.ndarray, recent: list, rate: float) -> None:
    for stage in recent:
        for k, tree in enumerate(stage):
            nodes, code = paths(tree, bins)
            scores[k] += (rate * tree["value"][:, 0])[nodes][code]


# ------------------------------------------------------------- fit

def fit_boosting(data: DataFrame, classes: int, stages: int = 100, learning_rate: float = 0.1, max_depth: int = 3) -> "BoostedModel":
    """Fit on ``data(scaled, label)``; ``classes`` 0 for a regression.  An empty table or a single class gives a constant."""
    ensure_checkpoint_dir(data.sparkSession)
    base = data.select(vector_to_array(F.col("scaled")).alias("x"), F.col("label").cast("double").alias("y"),
                       (F.col("rid") if "rid" in data.columns else F.lit(0).cast("long")).alias("rid"))
    total = base.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), F.max(F.size("x")).alias("d"),
                     *[F.sum((F.col("y") == k).cast("double")).alias(f"c{k}") for k in range(classes)]).first()
    n, d = int(total["n"]), int(total["d"] or 0)
    share = np.array([total[f"c{k}"] or 0.0 for k in range(classes)]) / max(n, 1)
    if not n or (classes and share.max() == 1.0):
        only = float(np.argmax(share)) if classes and n else 0.0
        return BoostedModel(inputCol="scaled", outputCol="prediction", spec=json.dumps(
            {"classes": classes, "rate": learning_rate, "start": [0.0], "stages": [], "only": only, "loss": []}))
    start = start_scores(classes, share, float(total["mean"]))
    trees = len(start)
    cuts = cut_points(base, n)
    cores = data.sparkSession.sparkContext.defaultParallelism
    points = _points(base, cuts, classes).checkpoint(eager=True)
    m = points.count()
    tasks = max(1, -(-m * d // TASK_CELLS), min(cores, -(-m * d // LEAST_CELLS)))
    # dealt evenly once, whatever partitions the points came in
    blocks = _blocks(points.coalesce(1) if tasks == 1 else points.repartition(tasks), d, start).checkpoint(eager=True)
    done, recent, losses = [], [], []
    for _ in range(stages):
        stage, loss = _fit_stage(blocks, tasks, d, trees, classes, recent, learning_rate, max_depth, cuts)
        losses.append(loss / n)
        recent.append(stage)
        done.append(stage)
        if len(recent) == KEEP:
            held = list(recent)

            def rescore(batches, held=held):
                for pdf in batches:
                    out = []
                    for r in pdf.itertuples(index=False):
                        bins, _, scores = _unpack(r, d, trees)
                        _add_trees(scores, bins, held, learning_rate)
                        out.append((r.n, r.bins, r.sums, scores.tobytes()))
                    yield pd.DataFrame(out, columns=["n", "bins", "sums", "scores"])

            blocks = blocks.mapInPandas(rescore, "n long, bins binary, sums binary, scores binary").checkpoint(eager=True)
            recent = []
    plain = [[{"feature": t["feature"].tolist(), "threshold": t["threshold"].tolist(), "left": t["left"].tolist(), "right": t["right"].tolist(),
               "value": t["value"][:, 0].tolist()} for t in stage] for stage in done]
    return BoostedModel(inputCol="scaled", outputCol="prediction", spec=json.dumps(
        {"classes": classes, "rate": learning_rate, "start": start.tolist(), "stages": plain, "only": None, "loss": losses}))


def _fit_stage(blocks: DataFrame, tasks: int, d: int, trees: int, classes: int, recent: list, rate: float, max_depth: int, cuts: list) -> tuple[list, float]:
    """The trees of one stage, level by level, and the loss before it."""
    grown = [{"feature": [LEAF], "bin": [0], "threshold": [0.0], "left": [LEAF], "right": [LEAF], "value": [0.0]} for _ in range(trees)]
    open_ = [(k, 0) for k in range(trees)]
    width = BINS + 1
    loss = 0.0
    for depth in range(max_depth):
        if not open_:
            break
        now = [{c: np.asarray(v) if c != "value" else np.asarray(v).reshape(-1, 1) for c, v in t.items()} for t in grown]
        asked = list(open_)

        def sums(batches, now=now, asked=asked, depth=depth):
            acc = np.zeros((len(asked), d, width, 3))
            lost, any_ = 0.0, False
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    any_ = True
                    bins, numbers, scores = _unpack(r, d, trees)
                    _add_trees(scores, bins, recent, rate)
                    g, h, part = point_gradients(classes, numbers, scores.T)
                    rows = numbers.sum(axis=1) if classes else numbers[:, 0]
                    lost += part
                    for k in range(trees):
                        mine = [i for i, (kk, _) in enumerate(asked) if kk == k]  # the tree's nodes, one after the other
                        if not mine:
                            continue
                        slot = np.full(len(now[k]["feature"]), -1)
                        slot[[asked[i][1] for i in mine]] = np.arange(len(mine))
                        at, of, nk, gk, hk = np.zeros(1, dtype=np.int64), bins, rows, g[:, k], h[:, k]
                        if depth:
                            nodes, code = paths(now[k], bins)
                            at = slot[nodes][code]
                            if at.min() < 0:
                                row = np.flatnonzero(at >= 0)
                                at, of, nk, gk, hk = at[row], bins[:, row], nk[row], gk[row], hk[row]
                            at = at * width
                        sums_ = acc[mine[0]:mine[-1] + 1]
                        for f in range(d):
                            cell = at + of[f]
                            for j, v in enumerate((nk, gk, hk)):
                                sums_[:, f, :, j] += np.bincount(cell, v, minlength=len(mine) * width).reshape(-1, width)
            if any_:
                yield pd.DataFrame({"i": np.arange(len(asked)), "cells": [a.tobytes() for a in acc], "loss": lost})

        def choose(pdf: pd.DataFrame) -> pd.DataFrame:
            """Each feature's best cut of one node."""
            every = np.sum([np.frombuffer(c, float) for c in pdf["cells"]], axis=0).reshape(d, width, 3)
            i, lost, out = int(pdf["i"].iloc[0]), float(pdf["loss"].sum()), []
            for f, total in enumerate(every):
                gain, at = best_binned_cut(total[:, 0], total[:, 1:2])
                out.append((i, f, gain, at, lost, total[:at + 1].sum(axis=0).tolist(), total.sum(axis=0).tolist()))
            return pd.DataFrame(out, columns=["i", "f", "gain", "bin", "loss", "left", "whole"])

        partial = blocks.mapInPandas(sums, "i int, cells binary, loss double")
        if tasks == 1:  # nothing to add up: one row per node
            rows = [row for _, part in partial.toPandas().groupby("i") for row in choose(part).to_dict("records")]
        else:
            rows = partial.groupBy("i").applyInPandas(
                choose, "i int, f int, gain double, bin int, loss double, left array<double>, whole array<double>").collect()
        if depth == 0:
            loss = next(r["loss"] for r in rows)
        open_ = []
        for i, (k, node) in enumerate(asked):
            mine = sorted((r for r in rows if r["i"] == i), key=lambda r: (-r["gain"], r["f"]))
            if not mine:
                continue
            best, t = mine[0], grown[k]
            whole = best["whole"]
            t["value"][node] = step_size(classes, whole[1], whole[2])
            if best["bin"] < 0 or best["gain"] <= 1e-12 * max(1.0, abs(whole[1])) or whole[0] < 2:
                continue
            t["feature"][node], t["bin"][node] = int(best["f"]), int(best["bin"])
            t["threshold"][node] = float(cuts[int(best["f"])][int(best["bin"])])
            t["left"][node], t["right"][node] = len(t["feature"]), len(t["feature"]) + 1
            right = [a - b for a, b in zip(whole, best["left"])]
            for side in (best["left"], right):
                open_.append((k, len(t["feature"])))
                for c, v in (("feature", LEAF), ("bin", 0), ("threshold", 0.0), ("left", LEAF), ("right", LEAF), ("value", step_size(classes, side[1], side[2]))):
                    t[c].append(v)
    out = [{c: np.asarray(v) if c != "value" else np.asarray(v).reshape(-1, 1) for c, v in t.items()} for t in grown]
    return out, loss


class BoostedModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A fitted booster: stages x classes trees of at most 2^(depth + 1) nodes, in a JSON param; scores tables and streams."""

    spec = Param(Params._dummy(), "spec", "JSON trees", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @property
    def loss(self) -> list[float]:
        """The mean training loss before each stage."""
        return json.loads(self.getOrDefault(self.spec))["loss"]

    def _transform(self, dataset):
        s = json.loads(self.getOrDefault(self.spec))
        classes, rate, start = s["classes"], s["rate"], np.asarray(s["start"])
        stages = [[{c: np.asarray(v) for c, v in t.items()} for t in stage] for stage in s["stages"]]

        @F.pandas_udf(T.DoubleType())
        def predict(v: pd.Series) -> pd.Series:
            if s["only"] is not None or not len(v):
                return pd.Series(np.full(len(v), s["only"] or 0.0))
            x = clean(np.stack(v.to_numpy()).astype(float))
            scores = np.tile(start, (len(x), 1))
            for stage in stages:
                for k, tree in enumerate(stage):
                    scores[:, k] += rate * tree["value"][route(tree, x)]
            if classes > 2:
                return pd.Series(scores.argmax(axis=1).astype(float))
            return pd.Series((scores[:, 0] > 0).astype(float) if classes == 2 else scores[:, 0])

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))

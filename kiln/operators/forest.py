"""Random forests of unlimited depth (M4).

Every row counts in every tree with a Poisson(1) weight drawn from a hash
of its key, so a tree is the same under any partitioning.  No cut parts
rows of equal features: for classes they are dealt to one task and drawn
there row by row, but from then on they are one point with its counts (of
a regression each row is a point).  Trees grow in two phases:

1. While a node has more than ``part_rows`` points it is split level by
   level: tasks route their points through the top of each tree, add up
   class counts (or sums) per node, feature and bin of cuts sampled inside
   the node, and Spark adds those over tasks and picks the best cut.  The
   tops have about trees x 2 points / part_rows nodes.
2. Points are then shuffled by (tree, node), packed per task, and each part
   is grown to purity in one task (``trees.grow``).

The forest is a table of node arrays, one row per part; it is saved with
the model.  A forest whose measured bytes allow it is broadcast for scoring
(streams too); a larger one is joined: packed rows and parts meet by (tree,
part), rows of a frequent part in blocks, and votes are summed per row.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.frames import BROADCAST_MAX_BYTES, lookup
from kiln.operators.trees import LEAF, best_binned_cut, clean, grow, midpoint, mixed, mixed_on, route, uniform
from kiln.session import ensure_checkpoint_dir

TASK_ROWS = 1 << 18       # rows of a task that deals them to the trees
PART_CELLS = 1 << 23      # numbers of a part that one task grows: points x 2 (features + classes), with their ranks and weights
SCORE_ROWS = 1 << 20      # rows of one block when scoring by join
SAMPLE = 2000             # rows of a node that its cuts are sampled from
CUTS = 64
MOST_TASKS = 2000         # tasks that parts are dealt to at most
HELD_CELLS = 1 << 23      # numbers of histograms a task holds at once (64 MB)
PART = -2                 # "feature" of a top's node that a part replaces

_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
_NODES = "tree int, part int, feature binary, threshold binary, left binary, right binary, value binary"


def weights(rid: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is drawn for a tree."""
    return drawn(mixed(seed, rid), tree)


def drawn(bits: np.ndarray, tree: int) -> np.ndarray:
    """``weights`` from the rows' mixed keys, which are the same for all trees."""
    return np.searchsorted(_POISSON, (mixed_on(bits, tree) >> np.uint64(11)).astype(float) / float(1 << 53), "right")


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """Tasks that rows are dealt to before they are worked through once per tree: enough for all cores, whatever the files' layout."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(cores, df.rdd.getNumPartitions() if rows is None else -(-rows // TASK_ROWS))


def _sums(y: np.ndarray, w: np.ndarray, classes: int) -> np.ndarray:
    if classes:
        out = np.zeros((len(y), classes))
        out[np.arange(len(y)), y.astype(int)] = w
        return out
    return np.column_stack([w * y, w * y * y])


def _leaf(total: np.ndarray, weight: float, classes: int) -> list[float]:
    return (total / weight).tolist() if classes else [float(total[0] / weight)]


def _arrays(top: dict) -> dict:
    return {k: np.asarray(top[k]) for k in ("feature", "threshold", "left", "right")}


def _batches(pdfs):
    for pdf in pdfs:
        if len(pdf):
            yield clean(np.stack(pdf["x"].to_numpy()).astype(float)), pdf["y"].to_numpy(float), pdf["rid"].to_numpy(np.int64)


BLOCK_CELLS = 1 << 20     # numbers (rows x features) of a block
_BLOCK = "x binary, code binary, y binary, rid binary"


def _dealt_points(base: DataFrame, rows: int, tasks: int, classes: int) -> tuple[DataFrame, int]:
    """Blocks of points (features, and each row's point, target and key); and how many different points there are.

    Equal rows go to one task, or to one per TASK_ROWS of them.  Rows of a regression are points of their own: cuts of equal gain
    are told apart by the rounding of sums over rows."""
    if classes:
        counts = base.groupBy("x").agg(F.count(F.lit(1)).alias("c"))
        size = counts.agg(F.count(F.lit(1)).alias("points"), F.max("c").alias("most")).first()
    keys = [F.col("x")]
    if classes and size["most"] > TASK_ROWS:
        many = counts.where(F.col("c") > TASK_ROWS).select("x", F.ceil(F.col("c") / TASK_ROWS).alias("salts"))  # at most rows / TASK_ROWS
        base = base.join(F.broadcast(many), "x", "left").withColumn("salt", F.pmod("rid", F.coalesce("salts", F.lit(1)))).drop("salts")
        keys.append(F.col("salt"))

    def pack(pdfs):
        held, cells = [], 0

        def block():
            x, y, rid = (np.concatenate(p) for p in zip(*held))
            new = np.append(True, (x[1:] != x[:-1]).any(axis=1)) if classes else np.ones(len(x), bool)
            return pd.DataFrame({"x": [x[new].tobytes()], "code": [(np.cumsum(new) - 1).astype(np.int32).tobytes()], "y": [y.tobytes()], "rid": [rid.tobytes()]})

        for b in _batches(pdfs):
            held.append(b)
            cells += b[0].size
            if cells > BLOCK_CELLS:
                yield block()
                held, cells = [], 0
        if held:
            yield block()

    dealt = base.repartition(tasks, *keys).sortWithinPartitions("x") if classes else base.repartition(tasks)
    return dealt.select("x", "y", "rid").mapInPandas(pack, _BLOCK).checkpoint(eager=True), int(size["points"]) if classes else rows


class _Points:
    """A block's points: features, a key of each (the least of its rows), and what a tree draws of them."""

    def __init__(self, r, d: int, classes: int, seed: int):
        self.x = np.frombuffer(r.x, float).reshape(-1, d)
        self.code, self.y, rid = np.frombuffer(r.code, np.int32), np.frombuffer(r.y, float), np.frombuffer(r.rid, np.int64)
        self.key = np.minimum.reduceat(rid, np.flatnonzero(np.append(True, self.code[1:] != self.code[:-1])))
        self.bits, self.classes = mixed(seed, rid), classes
        self.cell = self.code.astype(np.int64) * classes + self.y.astype(np.int64) if classes else None

    def drawn(self, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows drawn, weight, sums) of every point for a tree."""
        w, m = drawn(self.bits, tree).astype(float), len(self.x)
        rows = np.bincount(self.code, w > 0, m)
        if self.classes:
            sums = np.bincount(self.cell, w, m * self.classes).reshape(m, self.classes)
            return rows, sums.sum(axis=1), sums
        wy = w * self.y
        return rows, np.bincount(self.code, w, m), np.column_stack([np.bincount(self.code, wy, m), np.bincount(self.code, wy * self.y, m)])


def _points_of(pdfs, d: int, classes: int, seed: int):
    for pdf in pdfs:
        for r in pdf.itertuples(index=False):
            yield _Points(r, d, classes, seed)


# ------------------------------------------------------------- phase 1

def _grow_tops(base: DataFrame, trees: int, d: int, classes: int, n: int, part_rows: int, max_features: int, min_split: int, max_depth: int | None,
               seed: int) -> list[dict]:
    tops = [{"feature": [PART], "threshold": [0.0], "left": [LEAF], "right": [LEAF], "value": [None], "depth": [0]} for _ in range(trees)]
    big = [(t, 0, n) for t in range(trees)] if n > part_rows else []
    extra: dict[tuple[int, int], list] = {}
    k = classes or 2
    each = d * (CUTS + 3) * (k + 1)
    while big:
        then = []
        step = max(1, HELD_CELLS // each)
        for lo in range(0, len(big), step):
            then += _split_nodes(base, tops, big[lo:lo + step], extra, d, classes, part_rows, max_features, min_split, max_depth, seed)
        big = then
    return tops


def _split_nodes(base, tops, asked, extra, d, classes, part_rows, max_features, min_split, max_depth, seed) -> list:
    """Splits these nodes; the children (and nodes without a cut so far) that are still too large."""
    used = sorted({t for t, _, _ in asked})
    now = {t: _arrays(tops[t]) for t in used}
    slots = {t: np.full(len(tops[t]["feature"]), -1) for t in used}
    for i, (t, node, _) in enumerate(asked):
        slots[t][node] = i
    rate = np.array([SAMPLE / max(size, 1) for _, _, size in asked])

    def placed(points, t):
        _, w, s = points.drawn(t)
        at = slots[t][route(now[t], points.x)]
        row = np.flatnonzero((w > 0) & (at >= 0))
        return row, at[row], w[row], s[row]

    def sample(pdfs):
        for points in _points_of(pdfs, d, classes, seed):
            for t in used:
                row, at, _, _ = placed(points, t)
                pick = uniform(seed + 1, points.key[row], np.full(len(row), t)) < rate[at]
                if pick.any():
                    yield pd.DataFrame({"i": at[pick], "x": list(points.x[row[pick]])})

    def cuts(pdf):
        x = np.stack(pdf["x"].to_numpy())
        out = []
        for f in range(d):
            v = np.unique(x[:, f])
            if len(v) > CUTS + 1:
                v = np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1), method="inverted_cdf"))
            out.append(np.unique(midpoint(v[:-1], v[1:])).tolist())
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "cuts": [out]})

    found = {r["i"]: r["cuts"] for r in base.mapInPandas(sample, "i int, x array<double>").groupBy("i").applyInPandas(
        cuts, "i int, cuts array<array<double>>").collect()}
    edges = [[np.unique(np.append(found.get(i, [[]] * d)[f], extra.get((t, node), [[]] * d)[f])) for f in range(d)] for i, (t, node, _) in enumerate(asked)]
    k = classes or 2
    width = CUTS + 3

    def add(pdfs):
        acc = np.zeros((len(asked), d, width, k + 1))
        rows = np.zeros(len(asked))
        low, high = np.full((len(asked), d), np.inf), np.full((len(asked), d), -np.inf)
        for points in _points_of(pdfs, d, classes, seed):
            for t in used:
                row, at, w, s = placed(points, t)
                for i in np.unique(at):
                    mine = at == i
                    xs = points.x[row[mine]]
                    rows[i] += len(xs)
                    low[i], high[i] = np.minimum(low[i], xs.min(axis=0)), np.maximum(high[i], xs.max(axis=0))
                    for f in range(d):
                        b = np.searchsorted(edges[i][f], xs[:, f], "left")
                        acc[i, f, :, 0] += np.bincount(b, w[mine], minlength=width)
                        for j in range(k):
                            acc[i, f, :, j + 1] += np.bincount(b, s[mine, j], minlength=width)
        for i in np.flatnonzero(rows):
            yield pd.DataFrame({"i": i, "f": np.arange(d), "cells": [acc[i, f].tobytes() for f in range(d)], "rows": rows[i], "low": low[i], "high": high[i]})

    def choose(pdf):
        cells = np.sum([np.frombuffer(c, float) for c in pdf["cells"]], axis=0).reshape(width, k + 1)
        total = cells.sum(axis=0)
        s = cells[:, 1:] if classes else cells[:, 1:2] - cells[:, :1] * (total[1] / total[0])
        gain, at = best_binned_cut(cells[:, 0], s)
        return pd.DataFrame({"i": [int(pdf["i"].iloc[0])], "f": [int(pdf["f"].iloc[0])], "gain": [gain], "bin": [at], "rows": [float(pdf["rows"].sum())],
                             "low": [float(pdf["low"].min())], "high": [float(pdf["high"].max())], "total": [total.tolist()],
                             "left": [cells[:at + 1].sum(axis=0).tolist()]})

    rows = base.mapInPandas(add, "i int, f int, cells binary, rows double, low double, high double").groupBy("i", "f").applyInPandas(
        choose, "i int, f int, gain double, bin int, rows double, low double, high double, total array<double>, left array<double>").collect()
    then = []
    for i, (t, node, _) in enumerate(asked):
        mine = {r["f"]: r for r in rows if r["i"] == i}
        top = tops[t]
        if not mine:
            continue
        one = mine[0]
        total, size = np.array(one["total"]), int(one["rows"])
        value = _leaf(total[1:], total[0], classes)
        pure = (np.count_nonzero(total[1:]) <= 1) if classes else total[2] / total[0] - (total[1] / total[0]) ** 2 <= 1e-12 * max(1.0, total[2] / total[0])
        depth = top["depth"][node]
        if size <= part_rows:
            continue
        order = np.argsort(uniform(seed + 2, np.full(d, t), np.full(d, node), np.arange(d)), kind="stable")
        able = [f for f in order if mine[f]["low"] < mine[f]["high"]]
        if pure or size < max(min_split, 2) or not able or (max_depth is not None and depth >= max_depth):
            top["feature"][node], top["value"][node] = LEAF, value
            continue
        drawn = [f for f in order[:max_features] if f in able] or able[:1]
        best = max((mine[f] for f in drawn), key=lambda r: (r["gain"], -r["f"]))
        if best["bin"] < 0:  # all of the sample is alike: next time with a cut between the extremes
            extra[(t, node)] = [[float(midpoint(np.array(mine[f]["low"]), np.array(mine[f]["high"])))] if f in able else [] for f in range(d)]
            then.append((t, node, size))
            continue
        top["feature"][node], top["threshold"][node] = best["f"], float(edges[i][best["f"]][best["bin"]])
        top["left"][node], top["right"][node] = len(top["feature"]), len(top["feature"]) + 1
        share = best["left"][0] / total[0]
        for part in (share, 1 - share):
            if part * size > part_rows * 0.9:  # point counts of children are known by weight: near the bound they are counted again
                then.append((t, len(top["feature"]), max(1, int(part * size))))
            for c, v in (("feature", PART), ("threshold", 0.0), ("left", LEAF), ("right", LEAF), ("value", None), ("depth", depth + 1)):
                top[c].append(v)
    return then


# ------------------------------------------------------------- phase 2

def _pack(values: dict) -> list[bytes]:
    return [values["feature"].astype("<i4").tobytes(), values["threshold"].astype("<f8").tobytes(), values["left"].astype("<i4").tobytes(),
            values["right"].astype("<i4").tobytes(), values["value"].astype("<f8").tobytes()]


def _unpack(r, width: int) -> dict:
    return {"feature": np.frombuffer(r.feature, "<i4").astype(np.int64), "threshold": np.frombuffer(r.threshold, "<f8"),
            "left": np.frombuffer(r.left, "<i4").astype(np.int64), "right": np.frombuffer(r.right, "<i4").astype(np.int64),
            "value": np.frombuffer(r.value, "<f8").reshape(-1, width)}


def fit_forest(data: DataFrame, classes: int, trees: int = 100, max_depth: int | None = None, min_samples_split: int = 2, max_features: int | None = None,
               seed: int = 42, part_cells: int = PART_CELLS) -> "ForestModel":
    """Fit on ``data(scaled, label, rid)``, ``rid`` a hash of the rows' keys; ``classes`` 0 for a regression (mean squared error),
    else Gini impurity and sqrt(features) tried per node.  Leaves are pure unless ``max_depth`` or ``min_samples_split`` stops."""
    ensure_checkpoint_dir(data.sparkSession)
    base = data.select(vector_to_array(F.col("scaled")).alias("x"), F.col("label").cast("double").alias("y"), F.col("rid").cast("long").alias("rid"))
    size = base.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("d")).first()
    n, d, width = int(size["n"]), int(size["d"] or 0), max(classes, 1)
    if not n:
        raise ValueError("no rows to fit a forest on")
    base, n = _dealt_points(base, n, tasks_for(data, n), classes)
    tried = max_features or (max(1, int(math.sqrt(d))) if classes else d)
    part_rows = max(2, part_cells // (2 * (d + max(classes, 2))))
    tops = _grow_tops(base, trees, d, classes, n, part_rows, tried, min_samples_split, max_depth, seed)
    now = [_arrays(t) for t in tops]
    depths = [t["depth"] for t in tops]

    def deal(pdfs):
        for points in _points_of(pdfs, d, classes, seed):
            for t in range(trees):
                rows, w, s = points.drawn(t)
                at = np.where(w > 0, route(now[t], points.x), LEAF)
                for node in np.unique(at):
                    if node >= 0 and now[t]["feature"][node] == PART:
                        row = np.flatnonzero(at == node)
                        yield pd.DataFrame({"tree": [t], "part": [int(node)], "x": [points.x[row].tobytes()], "sums": [s[row].tobytes()],
                                            "w": [b"" if classes else w[row].tobytes()], "rows": [rows[row].astype(np.int32).tobytes()]})

    def finish(pdf):
        t, node = int(pdf["tree"].iloc[0]), int(pdf["part"].iloc[0])
        x, s = (np.concatenate([np.frombuffer(b, float) for b in pdf[c]]) for c in ("x", "sums"))
        x, s = x.reshape(-1, d), s.reshape(-1, classes or 2)
        w = s.sum(axis=1) if classes else np.concatenate([np.frombuffer(b, float) for b in pdf["w"]])
        rows = np.concatenate([np.frombuffer(b, np.int32) for b in pdf["rows"]]).astype(float)
        left = None if max_depth is None else max_depth - depths[t][node]
        tree = grow(x, s, w, classes, tried, min_samples_split, left, int(mixed(seed, t, node) >> np.uint64(1)), rows)
        return pd.DataFrame([[t, node, *_pack(tree)]], columns=["tree", "part", "feature", "threshold", "left", "right", "value"])

    # one part or so per task: sizes say little about the work, so the parts are not put together by them
    count = sum(t["feature"].count(PART) for t in tops)
    parts = base.mapInPandas(deal, "tree int, part int, x binary, sums binary, w binary, rows binary") \
        .repartition(max(1, min(4 * count, MOST_TASKS)), "tree", "part").groupBy("tree", "part").applyInPandas(finish, _NODES)
    own = []
    for t, top in enumerate(tops):
        value = np.array([v if v is not None else [0.0] * width for v in top["value"]], dtype=float).reshape(-1, width)
        own.append((t, -1, *[bytearray(b) for b in _pack({**now[t], "value": value})]))
    model = ForestModel(inputCol="scaled", outputCol="prediction", classes=classes)
    model.nodes = parts.unionByName(data.sparkSession.createDataFrame(own, _NODES)).checkpoint(eager=True)
    return model


# ------------------------------------------------------------- the model

class ForestWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.nodes.write.parquet(f"{path}/nodes")


class ForestReader(MLReader):
    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = ForestModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.nodes = self.sparkSession.read.parquet(f"{path}/nodes")
        return model


class ForestModel(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """A forest as a table of node arrays; ``prediction`` is the class of the largest mean share, or the mean."""

    classes = Param(Params._dummy(), "classes", "number of classes, 0 for a regression", typeConverter=TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, classes=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.nodes = None
        self.max_broadcast_bytes = BROADCAST_MAX_BYTES

    def write(self):
        return ForestWriter(self)

    @classmethod
    def read(cls):
        return ForestReader()

    def bytes(self) -> int:
        size = sum((F.octet_length(c) for c in ("feature", "threshold", "left", "right", "value")), F.lit(0))
        return int(self.nodes.agg(F.sum(size).alias("b")).first()["b"] or 0)

    def _transform(self, dataset):
        if self.bytes() <= self.max_broadcast_bytes:
            return self._by_broadcast(dataset)
        if dataset.isStreaming:
            raise ValueError("this forest is too large to be broadcast to a stream; score tables, for example in foreachBatch")
        return self._by_join(dataset)

    def _by_broadcast(self, dataset):
        classes = self.getOrDefault(self.classes)
        width = max(classes, 1)
        held = dataset.sparkSession.sparkContext.broadcast([(r.tree, r.part, _unpack(r, width)) for r in self.nodes.toPandas().itertuples(index=False)])

        @F.pandas_udf(T.DoubleType())
        def predict(v: pd.Series) -> pd.Series:
            if not len(v):
                return pd.Series([], dtype=float)
            x = clean(np.stack(v.to_numpy()).astype(float))
            votes = np.zeros((len(x), width))
            parts = {(t, p): tree for t, p, tree in held.value if p >= 0}
            tops = [(t, tree) for t, p, tree in held.value if p < 0]
            for t, top in tops:
                at = route(top, x)
                for node in np.unique(at):
                    row = np.flatnonzero(at == node)
                    if top["feature"][node] == PART:
                        tree = parts[(t, int(node))]
                        votes[row] += tree["value"][route(tree, x[row])]
                    else:
                        votes[row] += top["value"][node]
            return pd.Series(votes.argmax(axis=1).astype(float) if classes else votes[:, 0] / len(tops))

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))

    def _by_join(self, dataset):
        spark = dataset.sparkSession
        ensure_checkpoint_dir(spark)
        classes = self.getOrDefault(self.classes)
        width = max(classes, 1)
        # rows of equal features share their votes; the number must name the same point in both joins: fixed by writing the points once
        given = dataset.withColumn("_x", vector_to_array(self.getInputCol()))
        rows = given.select("_x").distinct().repartition(tasks_for(dataset)).withColumn("_qid", F.monotonically_increasing_id()).checkpoint(eager=True)
        tops = self.nodes.where("part < 0").toPandas()
        trees = len(tops)
        held = spark.sparkContext.broadcast([(r.tree, _unpack(r, width)) for r in tops.itertuples(index=False)])

        def deal(pdfs):
            for pdf in pdfs:
                if not len(pdf):
                    continue
                x = clean(np.stack(pdf["x"].to_numpy()).astype(float))
                qid = pdf["_qid"].to_numpy(np.int64)
                for t, top in held.value:
                    at = route(top, x)
                    for node in np.unique(at):
                        row = np.flatnonzero(at == node)
                        inner = top["feature"][node] == PART
                        value = b"" if inner else np.ascontiguousarray(top["value"][node]).tobytes()
                        yield pd.DataFrame({"tree": [t], "part": [int(node)], "n": [len(row)], "tag": [int(qid[0])], "qid": [qid[row].tobytes()],
                                            "x": [x[row].tobytes() if inner else b""], "leaf": [value]})

        packed = rows.select("_qid", F.col("_x").alias("x")).mapInPandas(
            deal, "tree int, part int, n long, tag long, qid binary, x binary, leaf binary")
        # rows of a part go to one task per SCORE_ROWS of them, each with a copy of the part
        blocks = packed.groupBy("tree", "part").agg(F.ceil(F.sum("n") / SCORE_ROWS).cast("int").alias("blocks")).checkpoint(eager=True)
        dealt = lookup(packed, blocks, ["tree", "part"]).withColumn("block", F.pmod(F.xxhash64("tag"), F.col("blocks")).cast("int"))
        parts = lookup(self.nodes.where("part >= 0"), blocks, ["tree", "part"], how="inner").withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))

        def vote(some: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
            if not len(some):
                return pd.DataFrame({"_qid": [], **{f"v{j}": [] for j in range(width)}})
            qid = np.concatenate([np.frombuffer(b, np.int64) for b in some["qid"]])
            if len(part):
                tree = _unpack(next(part.itertuples(index=False)), width)
                x = np.concatenate([np.frombuffer(b, float) for b in some["x"]]).reshape(len(qid), -1)
                value = tree["value"][route(tree, x)]
            else:
                value = np.tile(np.frombuffer(some["leaf"].iloc[0], float), (len(qid), 1))
            return pd.DataFrame({"_qid": qid, **{f"v{j}": value[:, j] for j in range(width)}})

        schema = "_qid long, " + ", ".join(f"v{j} double" for j in range(width))
        votes = dealt.groupBy("tree", "part", "block").cogroup(parts.groupBy("tree", "part", "block")).applyInPandas(vote, schema)
        summed = votes.groupBy("_qid").agg(*[F.sum(f"v{j}").alias(f"v{j}") for j in range(width)])
        if classes:
            every = [F.col(f"v{j}") for j in range(width)]
            out = F.array_position(F.array(*every), F.array_max(F.array(*every))) - 1
        else:
            out = F.col("v0") / trees
        voted = rows.join(summed.select("_qid", out.cast("double").alias(self.getOutputCol())), "_qid")
        # counted once, however often it is read
        return lookup(given, voted.select("_x", self.getOutputCol()), ["_x"]).drop("_x")

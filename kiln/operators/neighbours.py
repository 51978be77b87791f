"""Exact neighbour search on bounded blocks.

Space is cut into cells by median splits of a bounded sample of the points
(the tree has at most ``MAX_CELLS`` leaves, whatever the data's size, and
is the only thing that every task holds).  A cell of more than
``SPLIT_ROWS`` points is cut again, by a tree over a bounded sample of its
own points; these trees are a table, the directory, which points and
queries of the cell are joined with.  So cells hold about ``CELL_ROWS``
points up to ``MAX_CELLS`` squared cells.  The points of a cell are dealt
into blocks of bounded size, and so are the queries that must read it, so
no task holds an unbounded group, even if a third of all points are equal.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.functions.frames import lookup
from kiln.session import ensure_checkpoint_dir

MAX_CELLS = 4096
SAMPLE_ROWS = 65_536
CELL_ROWS = 2048      # aimed-at points of a cell while there are fewer than MAX_CELLS cells
SPLIT_ROWS = 8192     # points of a cell that is cut again
BLOCK_ROWS = 4096     # points, or queries, of one block
PLACE_ROWS = 65_536   # points, or queries, that meet one tree of the directory at once


class SpaceTree:
    """Half-open cells that cover all of space; every cell holds at least ``least`` points of the sample."""

    def __init__(self, sample: np.ndarray, cells: int, least: int):
        self.dims = sample.shape[1]
        self.axis, self.cut, self.left, self.right = [-1], [0.0], [-1], [-1]
        self.lo, self.hi = [np.full(self.dims, -np.inf)], [np.full(self.dims, np.inf)]
        self.leaf = [0]
        heap, count = [(len(sample), 0, sample)], 1
        while heap and count < cells:
            heap.sort(key=lambda x: x[0])
            n, node, pts = heap.pop()
            split = self._split(pts, least)
            if split is None:
                continue
            a, c = split
            for side, part in ((0, pts[pts[:, a] < c]), (1, pts[pts[:, a] >= c])):
                lo, hi = self.lo[node].copy(), self.hi[node].copy()
                (hi if side == 0 else lo)[a] = c
                child = len(self.axis)
                for field, v in ((self.axis, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.lo, lo), (self.hi, hi), (self.leaf, 0)):
                    field.append(v)
                (self.left if side == 0 else self.right)[node] = child
                heap.append((len(part), child, part))
            self.axis[node], self.cut[node] = a, c
            count += 1
        self.n_cells = 0
        for node in range(len(self.axis)):
            if self.axis[node] < 0:
                self.leaf[node] = self.n_cells
                self.n_cells += 1

    @staticmethod
    def _split(pts: np.ndarray, least: int):
        if len(pts) < 2 * least:
            return None
        spread = pts.max(0) - pts.min(0)
        for a in np.argsort(-spread):
            if spread[a] <= 0:
                return None
            c = float(np.median(pts[:, a]))
            below = int((pts[:, a] < c).sum())
            if below < least:  # many equal values: cut above them
                above = pts[pts[:, a] > c, a]
                if len(above) < least:
                    continue
                c = float(above.min())
                below = int((pts[:, a] < c).sum())
            if below >= least and len(pts) - below >= least:
                return int(a), c
        return None

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each point."""
        out = np.zeros(len(x), np.int32)
        stack = [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            if self.axis[node] < 0:
                out[at] = self.leaf[node]
                continue
            low = x[at, self.axis[node]] < self.cut[node]
            stack += [(self.left[node], at[low]), (self.right[node], at[~low])]
        return out

    def near(self, x: np.ndarray, r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) pairs of the cells whose region comes within ``r`` of a point."""
        points, cells, stack = [], [], [(0, np.arange(len(x)))]
        while stack:
            node, at = stack.pop()
            gap = np.maximum(np.maximum(self.lo[node] - x[at], x[at] - self.hi[node]), 0.0)
            at = at[(gap * gap).sum(1) <= (r[at] * (1 + 1e-9)) ** 2]
            if not len(at):
                continue
            if self.axis[node] < 0:
                points.append(at)
                cells.append(np.full(len(at), self.leaf[node], np.int32))
            else:
                stack += [(self.left[node], at), (self.right[node], at)]
        if not points:
            return np.empty(0, np.int64), np.empty(0, np.int32)
        return np.concatenate(points), np.concatenate(cells)


def _matrix(column, dims: int) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.empty((0, dims))


def build_tree(points: DataFrame, key: str, x: str, least: int, cells: int | None = None) -> SpaceTree:
    """A tree over a bounded sample (the first by a hash of the key)."""
    n = points.count()
    # only the rows of a low hash are put in order: each partition would send its first SAMPLE_ROWS rows to the driver otherwise
    share = (SAMPLE_ROWS + 8 * math.sqrt(SAMPLE_ROWS)) / max(n, 1)
    low = points.where(F.xxhash64(key) < F.lit(int(-(1 << 63) + share * float(1 << 64)))) if share < 1 else points
    sample = low.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(x).toPandas()[x]
    if len(sample) < min(n, SAMPLE_ROWS):  # keys that repeat may leave too few
        sample = points.orderBy(F.xxhash64(key), key).limit(SAMPLE_ROWS).select(x).toPandas()[x]
    if not len(sample):
        return SpaceTree(np.empty((0, 1)), 1, 1)
    pts = _matrix(sample, 0)
    return SpaceTree(pts, cells or max(1, min(MAX_CELLS, n // CELL_ROWS)), least)


def _directory(points: DataFrame, least: int) -> DataFrame:
    """(cell, n, tree): the tree of every cell (of ``points(tid, x, cell)``) with more than SPLIT_ROWS points, from a bounded sample of it."""
    counts = points.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > SPLIT_ROWS)  # at most MAX_CELLS rows
    picked = points.join(F.broadcast(counts), "cell").where(
        F.pmod(F.xxhash64("tid", F.lit(5)), F.lit(1 << 30)) < F.lit(float(SAMPLE_ROWS) * (1 << 30)) / F.col("n"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        tree = SpaceTree(_matrix(pdf.sort_values("tid")["x"], 0), max(1, min(MAX_CELLS, n // CELL_ROWS)), least)
        return pd.DataFrame({"cell": [int(pdf["cell"].iloc[0])], "tree": [pickle.dumps(tree)]})

    return picked.select("cell", "n", "tid", "x").groupBy("cell").applyInPandas(build, "cell int, tree binary").checkpoint(eager=True)


def _cut_again(rows: DataFrame, directory: DataFrame, key: str, x: str, reach: bool) -> DataFrame:
    """``rows`` (with a ``cell``) with cell and ``sub``, the cell inside it: where the point lies, or with ``reach`` one row for each
    that comes within ``r``.  Rows of a cell without a tree have sub 0."""
    names = directory.select("cell", F.lit(True).alias("_cut"))
    marked = rows.join(F.broadcast(names), "cell", "left")  # at most MAX_CELLS rows
    whole = marked.where(F.col("_cut").isNull()).drop("_cut").withColumn("sub", F.lit(0))
    cut = marked.where("_cut").drop("_cut")
    parts = cut.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(PLACE_ROWS)).cast("int").alias("parts"))
    cut = cut.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64(key, F.lit(9)), F.col("parts")).cast("int")).drop("parts")
    trees = directory.join(F.broadcast(parts), "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    trees = trees.select(F.col("cell").alias("tc"), F.col("part").alias("tp"), "tree")
    columns = [c for c in cut.columns if c != "part"]

    def place(tree: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({c: [] for c in [*columns, "sub"]})
        held, at = pickle.loads(tree["tree"].iloc[0]), _matrix(pdf[x], 0)
        if not reach:
            return pdf[columns].assign(sub=held.cell(at))
        row, sub = held.near(at, pdf["r"].to_numpy())
        return pdf[columns].iloc[row].assign(sub=sub)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema.fields if f.name != "part") + ", sub int"
    return whole.unionByName(trees.groupBy("tc", "tp").cogroup(cut.groupBy("cell", "part")).applyInPandas(place, schema))


def _dealt(rows: DataFrame, key: str, salt: int) -> tuple[DataFrame, DataFrame]:
    """Rows with ``cell`` and ``sub`` get a ``block`` of at most about BLOCK_ROWS rows of it; and the number of blocks of each."""
    counts = rows.groupBy("cell", "sub").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")).checkpoint(eager=True)
    out = lookup(rows, counts, ["cell", "sub"]).withColumn("block", F.pmod(F.xxhash64(key, F.lit(salt)), F.col("blocks")).cast("int")).drop("blocks")
    return out, counts


def nearest(train: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """(qid, d, tid, label) of the k nearest of ``train(tid, x, label)`` to each of ``query(qid, x)``; ties go to the smaller tid.

    Queries at one place are searched once, and of the points at one place
    only the k of smallest tid can be among anybody's nearest.  A query
    first reads one block of its own cell; its k-th distance there
    bounds the region that it must search, and it reads all blocks of the
    cells that come within that bound, each at most once.
    """
    spark = train.sparkSession
    ensure_checkpoint_dir(spark)
    asked = query.select("qid", "x").checkpoint(eager=True)
    places = asked.groupBy("x").agg(F.min("qid").alias("place")).checkpoint(eager=True)
    found = _nearest(_first_at_a_place(train, k), places.select(F.col("place").alias("qid"), "x"), k)
    if places.count() == asked.count():
        return found
    found = found.groupBy("qid").agg(F.collect_list(F.struct("d", "tid", "label")).alias("near"))  # k of each
    found = places.join(found.withColumnRenamed("qid", "place"), "place").select("x", "near")
    return lookup(asked, found, ["x"], "inner").select("qid", F.explode("near").alias("one")).select("qid", "one.d", "one.tid", "one.label")


def _first_at_a_place(train: DataFrame, k: int) -> DataFrame:
    """``train`` without the points that have k others of smaller tid at the same place; of a crowded place each partition keeps k."""
    dense = train.groupBy("x").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > k)
    if dense.isEmpty():
        return train

    def kept(batches):
        held = None
        for pdf in batches:
            held = pdf if held is None else pd.concat([held, pdf])
            if len(held) > 4 * PLACE_ROWS:
                held, out = None, cut(held)
                yield out
        if held is not None and len(held):
            yield cut(held)

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        x, tid = _matrix(pdf["x"], 0) + 0.0, pdf["tid"].to_numpy()
        order = np.lexsort([tid, *x.T])
        x = x[order]
        first = np.append(True, (x[1:] != x[:-1]).any(axis=1))
        nth = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0))
        return pdf.iloc[order[nth < k]]

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in train.select("tid", "x", "label").schema.fields)
    some = train.select("tid", "x", "label").mapInPandas(kept, schema)
    w = Window.partitionBy("x").orderBy("tid")  # at most k of a place from each batch of a task
    return some.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n").checkpoint(eager=True)


def _nearest(train: DataFrame, query: DataFrame, k: int) -> DataFrame:
    """``nearest`` for queries at different places."""
    spark = train.sparkSession
    tree = build_tree(train, "tid", "x", max(8, k))
    shared = spark.sparkContext.broadcast(tree)

    def with_cell(batches):
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=shared.value.cell(_matrix(pdf["x"], 0)))

    label = train.schema["label"].dataType.simpleString()
    pts = train.select("tid", "x", "label").mapInPandas(with_cell, f"tid long, x array<double>, label {label}, cell int")
    pts = pts.checkpoint(eager=True)
    directory = _directory(pts, max(8, k))
    some = directory.limit(1).count() > 0
    again = _cut_again if some else lambda rows, *_: rows.withColumn("sub", F.lit(0))
    pts, blocks = _dealt(again(pts, directory, "tid", "x", False), "tid", 1)
    pts = pts.checkpoint(eager=True)
    best = f"qid long, d double, tid long, label {label}"

    def top(points: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(points) or not len(queries):
            return pd.DataFrame({"qid": [], "d": [], "tid": [], "label": []}).astype({"qid": "int64", "d": "float64", "tid": "int64"})
        points = points.sort_values("tid")
        p, q, r = np.ascontiguousarray(_matrix(points["x"], 0).T), _matrix(queries["qx"], 0), queries["r"].to_numpy(float)
        tid, lab, qid = points["tid"].to_numpy(), points["label"].to_numpy(), queries["qid"].to_numpy()
        n, parts = p.shape[1], []
        m = min(k, n)
        for lo in range(0, len(q), 64):
            some = q[lo:lo + 64]
            d = np.zeros((len(some), n))
            for axis in range(len(p)):
                gap = some[:, axis:axis + 1] - p[axis]
                gap *= gap
                d += gap
            kth = np.partition(d, m - 1, axis=1)[:, m - 1:m] if m < n else np.full((len(some), 1), np.inf)
            row, at = np.nonzero(d <= kth)  # ties at the k-th distance all stay until they are put in order
            far = np.sqrt(d[row, at])
            order = np.lexsort((at, d[row, at], row))
            row, at, far = row[order], at[order], far[order]
            nth = np.arange(len(row)) - np.searchsorted(row, row)
            keep = (nth < m) & (far <= r[lo + row])  # nothing beyond the query's bound is among its nearest
            parts.append((qid[lo + row[keep]], far[keep], tid[at[keep]], lab[at[keep]]))
        return pd.DataFrame({c: np.concatenate(v) for c, v in zip(("qid", "d", "tid", "label"), zip(*parts))})

    def meet(wanted: DataFrame) -> DataFrame:
        """The k best of each (query, block) within r: ``wanted`` has qid, qx, r, cell, sub, block."""
        on = ["cell", "sub", "block"]
        sizes = wanted.groupBy(*on).agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
        q = wanted.join(sizes, on).withColumn("part", F.pmod(F.xxhash64("qid"), F.col("parts")).cast("int")).drop("parts")
        p = pts.join(sizes, on).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        p = p.select(F.col("cell").alias("pc"), F.col("sub").alias("ps"), F.col("block").alias("pb"), F.col("part").alias("pp"), "tid", "x", "label")
        return p.groupBy("pc", "ps", "pb", "pp").cogroup(q.groupBy(*on, "part")).applyInPandas(top, best)

    q = query.select("qid", "x").mapInPandas(with_cell, "qid long, x array<double>, cell int").withColumnRenamed("x", "qx")
    q = again(q, directory, "qid", "qx", False).checkpoint(eager=True)
    home = meet(q.withColumn("block", F.lit(0)).withColumn("r", F.lit(float("inf"))))
    bound = home.groupBy("qid").agg(F.max("d").alias("r"), F.count(F.lit(1)).alias("n"))
    bound = q.join(bound, "qid", "left").select("qid", "qx", F.when(F.col("n") >= k, F.col("r")).otherwise(F.lit(float("inf"))).alias("r"))

    def reach(batches):
        for pdf in batches:
            if len(pdf):
                at, cell = shared.value.near(_matrix(pdf["qx"], 0), pdf["r"].to_numpy())
                yield pd.DataFrame({"qid": pdf["qid"].to_numpy()[at], "qx": pdf["qx"].to_numpy()[at], "r": pdf["r"].to_numpy()[at], "cell": cell})

    reached = bound.mapInPandas(reach, "qid long, qx array<double>, r double, cell int")
    wanted = lookup(again(reached, directory, "qid", "qx", True), blocks, ["cell", "sub"], how="inner")
    wanted = wanted.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    found = meet(wanted.checkpoint(eager=True))
    w = Window.partitionBy("qid").orderBy("d", "tid")  # k rows per block that the query read
    return found.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def vote(found: DataFrame, weights: str, classification: bool) -> DataFrame:
    """(qid, prediction) from the neighbours: majority (ties to the smaller class) or mean, uniform or inverse-distance weights."""
    if weights == "distance":
        zero = F.max((F.col("d") == 0).cast("int")).over(Window.partitionBy("qid"))
        w = F.when(zero == 1, (F.col("d") == 0).cast("double")).otherwise(1.0 / F.nullif(F.col("d"), F.lit(0.0)))
        found = found.withColumn("w", w)
    else:
        found = found.withColumn("w", F.lit(1.0))
    if classification:
        votes = found.groupBy("qid", "label").agg(F.sum("w").alias("s"))
        best = votes.groupBy("qid").agg(F.max(F.struct("s", (-F.col("label")).alias("nl"))).alias("b"))
        return best.select("qid", (-F.col("b.nl")).alias("prediction"))
    return found.groupBy("qid").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))


def knn_predict(train: DataFrame, query: DataFrame, k: int = 5, weights: str = "uniform", classification: bool = True) -> DataFrame:
    """Prediction of exact k nearest neighbours: ``train(tid, x array<double>, label)``, ``query(qid, x)``."""
    return vote(nearest(train, query, k), weights, classification)

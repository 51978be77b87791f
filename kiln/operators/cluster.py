"""Clustering (L1-L4).

Hierarchical Ward clustering of every row is quadratic; it is re-aimed:
k-means reduces the rows to at most ``micro`` micro-clusters on the
cluster (count and mean each), Ward's criterion merges those weighted
summaries on the driver (O(micro^2)), and the micro-cluster -> cluster
map is broadcast back.  It is exact Ward when every distinct row is a
micro-cluster of its own, and an approximation of it otherwise.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import dealt_evenly, lookup, with_global_index
from kiln.functions.graph import components
from kiln.functions.nulls import numeric_columns
from kiln.operators.neighbours import build_tree
from kiln.session import ensure_checkpoint_dir


def _vectors(df: DataFrame, columns: list[str]) -> DataFrame:
    cols = [c for c in columns if c in numeric_columns(df)]
    data = df.select(*df.columns).na.drop(subset=cols)
    return VectorAssembler(inputCols=cols, outputCol="_v").transform(data)


def kmeans(df: DataFrame, columns: list[str], n_clusters: int = 3, seed: int = 0) -> DataFrame:
    """L1: k-means (k-means|| initialisation) on complete numeric rows, unscaled."""
    vec = _vectors(df, columns)
    model = KMeans(k=n_clusters, seed=seed, featuresCol="_v", predictionCol="cluster").fit(vec)
    return model.transform(vec).drop("_v")


def ward_merge(counts: np.ndarray, means: np.ndarray, k: int) -> np.ndarray:
    """Agglomerate weighted points with Ward's criterion down to k groups;
    returns the group of each point (0-based, ordered by first member)."""
    m = len(counts)
    groups = {i: [i] for i in range(m)}
    n = {i: float(counts[i]) for i in range(m)}
    mu = {i: means[i].astype(float) for i in range(m)}
    while len(groups) > k:
        keys = list(groups)
        best, pair = None, None
        for a_i, a in enumerate(keys):
            for b in keys[a_i + 1:]:
                d = n[a] * n[b] / (n[a] + n[b]) * float(((mu[a] - mu[b]) ** 2).sum())
                if best is None or d < best:
                    best, pair = d, (a, b)
        a, b = pair
        mu[a] = (n[a] * mu[a] + n[b] * mu[b]) / (n[a] + n[b])
        n[a] += n[b]
        groups[a] += groups.pop(b)
        del mu[b], n[b]
    label = np.empty(m, dtype=int)
    for g, (_, members) in enumerate(sorted(groups.items(), key=lambda kv: min(kv[1]))):
        label[members] = g
    return label


def hierarchical(df: DataFrame, columns: list[str], n_clusters: int = 3, micro: int = 500,
                 seed: int = 0) -> DataFrame:
    """L2: Ward clusters (0-based) through micro-cluster summaries."""
    vec = _vectors(df, columns)
    distinct = vec.select("_v").distinct().limit(micro + 1).count()
    m = min(micro, distinct)
    km = KMeans(k=max(m, n_clusters), seed=seed, featuresCol="_v", predictionCol="_micro", maxIter=50).fit(vec)
    assigned = km.transform(vec)
    # a summary is the mean of the rows that were assigned, not the k-means centre
    summ = assigned.groupBy("_micro").agg(F.count(F.lit(1)).alias("n"), Summarizer.mean(F.col("_v")).alias("mean")).collect()
    ids = [r["_micro"] for r in summ]
    counts = np.array([r["n"] for r in summ], dtype=float)
    means = np.array([r["mean"].toArray() for r in summ])
    labels = ward_merge(counts, means, n_clusters)
    spark = df.sparkSession
    mapping = spark.createDataFrame([(int(i), int(l)) for i, l in zip(ids, labels)], "_micro int, cluster int")
    return assigned.join(F.broadcast(mapping), "_micro").drop("_micro", "_v")


def dbscan(df: DataFrame, columns: list[str], eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """L3: density clusters in n dimensions on complete numeric rows; ``cluster`` is -1 for noise, else numbered from 0 in the
    order of each cluster's smallest point.

    A point is a core point when at least ``min_samples`` rows (itself
    included) lie within ``eps``; core points within ``eps`` of each other
    share a cluster; another point within ``eps`` of core points joins the
    one of smallest number, and the rest is noise.

    Equal rows are one weighted point.  Space is cut into cells by
    ``SpaceTree`` (a bounded tree); a task gets the points of one cell and
    copies of those within ``eps`` of it.  It counts weights, then ties its
    core points to their smallest local neighbour chain; copies tie cells
    together, and connected components over those ties are the clusters.

    Where points crowd, they do not go through tasks by area: a grid cell
    of diagonal ``eps`` with more than ``HOT_ROWS`` of them is a clique of
    core points as it is (``HotCells``).  What is left of any area of
    diameter ``eps`` is bounded by the dimension.
    """
    cols = [c for c in columns if c in numeric_columns(df)]
    if not cols:
        raise ValueError("no numeric column")
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    rows = df.na.drop(subset=cols).withColumn("_x", F.array(*[F.col(c).cast("double") + F.lit(0.0) for c in cols]))
    pts = with_global_index(rows.groupBy("_x").agg(F.count(F.lit(1)).cast("double").alias("w")), ["_x"], "id")
    every = pts.select(F.col("id").cast("long").alias("id"), F.col("_x").alias("x"), "w").checkpoint(eager=True)
    hot = HotCells.of(every, len(cols), float(eps), min_samples)
    pts = every.withColumn("near_hot", F.lit(0.0)) if hot is None else hot.others
    tree = spark.sparkContext.broadcast(build_tree(pts, "id", "x", 8))

    def spread(batches):
        for pdf in batches:
            if len(pdf):
                x = np.stack(pdf["x"].to_numpy())
                home = tree.value.cell(x)
                at, cell = tree.value.near(x, np.full(len(x), float(eps)))
                yield pdf.iloc[at].assign(cell=cell, own=home[at] == cell)

    def weights(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, own = np.stack(pdf["x"].to_numpy()), pdf["w"].to_numpy(), np.flatnonzero(pdf["own"].to_numpy())
        near, extra = Near(x, eps), pdf["near_hot"].to_numpy()
        return pd.DataFrame({"id": pdf["id"].to_numpy()[own], "core": [bool(w[near.of(i)].sum() + extra[i] >= min_samples) for i in own]})

    # the comparisons of a cell are many times its bytes
    spread_pts = dealt_evenly(pts.mapInPandas(spread, "id long, x array<double>, w double, near_hot double, cell int, own boolean"), "cell")
    core = spread_pts.groupBy("cell").applyInPandas(weights, "id long, core boolean").checkpoint(eager=True)

    def ties(pdf: pd.DataFrame) -> pd.DataFrame:
        """(id, to, kind): core points to the smallest id of their local cluster; other own points to one core point near them,
        of each local cluster."""
        pdf = pdf.sort_values("id")
        x, ids = np.stack(pdf["x"].to_numpy()), pdf["id"].to_numpy()
        is_core, own = pdf["core"].to_numpy(), pdf["own"].to_numpy()
        near = Near(x, eps)
        label = np.full(len(x), -1)
        for i in np.flatnonzero(is_core):
            if label[i] < 0:
                label[i], stack = i, [i]
                while stack:
                    j = near.of(stack.pop())
                    j = j[is_core[j] & (label[j] < 0)]
                    label[j] = i
                    stack.extend(j.tolist())
        at = np.flatnonzero(is_core)
        out = [(ids[i], ids[label[i]], True) for i in at]
        for i in np.flatnonzero(own & ~is_core):
            j = near.of(i)
            out += [(ids[i], ids[k], False) for k in np.unique(label[j[is_core[j]]])]
        return pd.DataFrame(out, columns=["id", "to", "core"])

    tied = dealt_evenly(spread_pts.join(core, "id"), "cell").groupBy("cell").applyInPandas(ties, "id long, to long, core boolean")
    tied = (tied if hot is None else tied.unionByName(hot.ties(core))).checkpoint(eager=True)
    links = tied.where("core").select(F.col("id").alias("u"), F.col("to").alias("v"))
    roots = components(links)
    alone = tied.where("core").select(F.col("id").alias("node")).distinct()
    named = alone.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    numbers = with_global_index(named.select("root").distinct(), ["root"], "cluster").select("root", F.col("cluster").cast("long").alias("cluster"))
    cores = named.join(numbers, "root").select(F.col("node").alias("id"), "cluster")
    border = tied.where(~F.col("core")).join(cores.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("cluster").alias("cluster"))
    found = every.join(cores.unionByName(border), "id", "left").select("x", F.coalesce("cluster", F.lit(-1)).alias("cluster"))
    return lookup(rows, found.withColumnRenamed("x", "_x"), ["_x"], "inner").drop("_x")


HOT_ROWS = 4096      # distinct points of a grid cell that is a clique of its own; also points of a block of it
HOT_PARTS = 256      # boxes that such a cell is cut into at most
MOST_STEPS = 20_000  # neighbouring grid cells; in more dimensions cells of diagonal ``eps`` are not looked at


class HotCells:
    """Grid cells of diagonal ``eps`` with many points: all are core points of one cluster.

    Their points are cut into boxes, and the boxes into blocks.  A point
    (or box of another cell) that is within ``eps`` of all of a box, or of
    none of it, is settled by the box's corners; only where no box settles
    it are points compared, block by block.
    """

    def __init__(self, others: DataFrame, points: DataFrame, touches: DataFrame, links: DataFrame):
        self.others, self.points, self.touches, self.links = others, points, touches, links

    def ties(self, core: DataFrame) -> DataFrame:
        """(id, to, core): the cells' points to their first ones, cells to cells, and the other points near them."""
        near = self.touches.join(core, "id").select("id", F.col("first").alias("to"), "core")
        own = self.points.select("id", F.col("first").alias("to"), F.lit(True).alias("core"))
        return own.unionByName(self.links.select(F.col("a").alias("id"), F.col("b").alias("to"), F.lit(True).alias("core"))).unionByName(near)

    @classmethod
    def of(cls, pts: DataFrame, d: int, eps: float, min_samples: int) -> HotCells | None:
        reach = math.ceil(math.sqrt(d))
        if eps <= 0 or (2 * reach + 1) ** d > MOST_STEPS:
            return None
        side = eps / math.sqrt(d) * (1 - 1e-9)
        grid = pts.withColumn("g", F.transform("x", lambda v: F.floor(v / F.lit(side))))
        cells = grid.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first")).where(F.col("n") > max(HOT_ROWS, min_samples)).checkpoint(eager=True)
        if not cells.limit(1).count():
            return None
        most = max(1, int(HOT_PARTS ** (1 / d) + 1e-9))
        cut = F.least(F.lit(most), F.ceil(F.pow(F.col("n") / F.lit(HOT_ROWS), F.lit(1.0 / d)))).cast("int")
        inside = lookup(grid, cells.withColumn("cut", cut), ["g"], "inner")
        box = F.lit(0)
        for i in range(d):
            step = F.floor((F.col("x")[i] / F.lit(side) - F.col("g")[i]) * F.col("cut"))
            box = box * F.col("cut") + F.least(F.greatest(step, F.lit(0)), F.col("cut") - 1)
        inside = inside.select("id", "x", "w", "first", box.cast("int").alias("box")).checkpoint(eager=True)
        sizes = inside.groupBy("first", "box").agg(F.ceil(F.count(F.lit(1)) / F.lit(HOT_ROWS)).cast("int").alias("blocks"))
        points = lookup(inside, sizes, ["first", "box"], "inner").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")).checkpoint(eager=True)
        corners = [F.array(*[f(F.col("x")[i]) for i in range(d)]).alias(n) for f, n in ((F.min, "lo"), (F.max, "hi"))]
        boxes = points.groupBy("first", "box").agg(*corners, F.sum("w").alias("bw"), F.max("blocks").alias("blocks")).checkpoint(eager=True)

        # the cells around, by steps from the few hot ones
        steps = F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in s]) for s in itertools.product(range(-reach, reach + 1), repeat=d) if any(s)])
        around = cells.select("first", "g", F.explode(steps).alias("s")).select("first", F.zip_with("g", "s", lambda a, b: a + b).alias("g"))
        rest = grid.join(cells.select("g"), "g", "left_anti")
        pairs = rest.join(around, "g").select("id", "x", "first").join(boxes, "first")
        least, most_ = _apart([F.col("x")[i] for i in range(d)], [F.col("x")[i] for i in range(d)], d), _across([F.col("x")[i] for i in range(d)], [F.col("x")[i] for i in range(d)], d)
        pairs = pairs.where(least <= F.lit(eps * eps * (1 + 1e-9))).withColumn("whole", most_ <= F.lit(eps * eps * (1 - 1e-9))) \
            .select("id", "x", "first", "box", "bw", "blocks", "whole").checkpoint(eager=True)
        sure = pairs.where("whole").groupBy("id", "first").agg(F.sum("bw").alias("sw")).checkpoint(eager=True)
        total = sure.groupBy("id").agg(F.sum("sw").alias("total"))
        open_ = pairs.where("NOT whole").join(sure, ["id", "first"], "left").join(total, "id", "left") \
            .where(F.col("sw").isNull() | (F.coalesce("total", F.lit(0.0)) < min_samples))
        asked = open_.select(F.col("id").alias("qid"), F.col("x").alias("qx"), F.col("first").alias("qf"), F.col("box").alias("qb"),
                             F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("qk"))

        def within(held: pd.DataFrame, wanted: pd.DataFrame) -> pd.DataFrame:
            if not len(held) or not len(wanted):
                return pd.DataFrame({"id": [], "first": [], "sw": []}).astype({"id": "int64", "first": "int64", "sw": "float64"})
            p, w, q = np.stack(held["x"].to_numpy()), held["w"].to_numpy(), np.stack(wanted["qx"].to_numpy())
            sums = np.concatenate([(((q[lo:lo + 256, None, :] - p[None, :, :]) ** 2).sum(2) <= eps * eps) @ w for lo in range(0, len(q), 256)])
            return pd.DataFrame({"id": wanted["qid"].to_numpy(), "first": wanted["qf"].to_numpy(), "sw": sums})[sums > 0]

        exact = points.groupBy("first", "box", "block").cogroup(asked.groupBy("qf", "qb", "qk")).applyInPandas(within, "id long, first long, sw double")
        near = sure.unionByName(exact.select("id", "first", "sw")).checkpoint(eager=True)
        extra = near.groupBy("id").agg(F.sum("sw").alias("near_hot"))
        others = rest.select("id", "x", "w").join(extra, "id", "left").select("id", "x", "w", F.coalesce("near_hot", F.lit(0.0)).alias("near_hot")).checkpoint(eager=True)
        return cls(others, points.select("id", "first"), near.select("id", "first").distinct(), cls._links(cells, around, boxes, points, d, eps))

    @staticmethod
    def _links(cells, around, boxes, points, d: int, eps: float) -> DataFrame:
        """(a, b): hot cells with points within ``eps`` of each other."""
        met = around.withColumnRenamed("first", "a").join(cells.select("g", F.col("first").alias("b")), "g").where("a < b").select("a", "b")
        left = boxes.select(F.col("first").alias("a"), F.col("box").alias("abox"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.col("blocks").alias("ablocks"))
        right = boxes.select(F.col("first").alias("b"), F.col("box").alias("bbox"), "lo", "hi", F.col("blocks").alias("bblocks"))
        both = met.join(left, "a").join(right, "b")  # at most HOT_PARTS squared rows per pair of cells
        lo, hi = [F.col("alo")[i] for i in range(d)], [F.col("ahi")[i] for i in range(d)]
        both = both.where(_apart(lo, hi, d) <= F.lit(eps * eps * (1 + 1e-9))).withColumn("whole", _across(lo, hi, d) <= F.lit(eps * eps * (1 - 1e-9))).checkpoint(eager=True)
        sure = both.where("whole").select("a", "b").distinct()
        open_ = both.where("NOT whole").join(sure, ["a", "b"], "left_anti")
        asked = open_.select("a", "b", "abox", "bbox", F.explode(F.sequence(F.lit(0), F.col("ablocks") - 1)).alias("ablock"), "bblocks") \
            .select("a", "b", "abox", "bbox", "ablock", F.explode(F.sequence(F.lit(0), F.col("bblocks") - 1)).alias("bblock"))
        on = ["a", "b", "abox", "bbox", "ablock", "bblock"]
        one = points.select(F.col("first").alias("a"), F.col("box").alias("abox"), F.col("block").alias("ablock"), "x").join(asked, ["a", "abox", "ablock"])
        two = points.select(F.col("first").alias("b"), F.col("box").alias("bbox"), F.col("block").alias("bblock"), "x").join(asked, ["b", "bbox", "bblock"])
        two = two.select(*[F.col(c).alias(f"{c}2") for c in on], F.col("x").alias("y"))

        def meet(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(q):
                return pd.DataFrame({"a": [], "b": []}).astype("int64")
            x, y = np.stack(p["x"].to_numpy()), np.stack(q["y"].to_numpy())
            hit = any((((x[lo:lo + 256, None, :] - y[None, :, :]) ** 2).sum(2) <= eps * eps).any() for lo in range(0, len(x), 256))
            return pd.DataFrame({"a": [int(p["a"].iloc[0])] * hit, "b": [int(p["b"].iloc[0])] * hit}).astype("int64")

        exact = one.select(*on, "x").groupBy(*on).cogroup(two.groupBy(*[f"{c}2" for c in on])).applyInPandas(meet, "a long, b long")
        return sure.unionByName(exact.distinct()).checkpoint(eager=True)


def _apart(low: list, high: list, d: int) -> F.Column:
    """The square of the least distance between the box (low, high) and that of columns lo, hi."""
    gaps = [F.greatest(F.col("lo")[i] - high[i], low[i] - F.col("hi")[i], F.lit(0.0)) for i in range(d)]
    return sum((g * g for g in gaps), F.lit(0.0))


def _across(low: list, high: list, d: int) -> F.Column:
    """The square of the largest distance between points of both boxes, at most."""
    gaps = [F.greatest(high[i] - F.col("lo")[i], F.col("hi")[i] - low[i]) for i in range(d)]
    return sum((g * g for g in gaps), F.lit(0.0))


class Near:
    """Points of one block by buckets of side ``eps``: those within ``eps`` of a point are in its own or an adjacent bucket
    (on the first three axes)."""

    def __init__(self, x: np.ndarray, eps: float):
        self.x, self.eps2 = x, eps * eps
        self.key = np.floor(x[:, :3] / eps).astype(np.int64) if eps > 0 else x[:, :3]
        self.buckets: dict = {}
        for i, k in enumerate(map(tuple, self.key.tolist())):
            self.buckets.setdefault(k, []).append(i)
        self.buckets = {k: np.array(v) for k, v in self.buckets.items()}
        self.steps = list(itertools.product((-1, 0, 1), repeat=self.key.shape[1]))

    def of(self, i: int) -> np.ndarray:
        k = self.key[i].tolist()
        got = [b for s in self.steps if (b := self.buckets.get(tuple(a + d for a, d in zip(k, s)))) is not None]
        at = np.concatenate(got)
        d = self.x[at] - self.x[i]
        return np.sort(at[(d * d).sum(1) <= self.eps2])


def cluster_summary(labelled: DataFrame, label: str = "cluster") -> DataFrame:
    """L4: number of clusters, noise (-1) excluded, and the size of each: a row for every label (noise too) with its size and the
    two totals.  Without rows, the totals stand alone."""
    ensure_checkpoint_dir(labelled.sparkSession)
    sizes = labelled.groupBy(label).agg(F.count(F.lit(1)).alias("size")).checkpoint(eager=True)
    totals = sizes.agg(F.count_if(F.col(label) != -1).alias("n_clusters"),
                       F.sum(F.when(F.col(label) == -1, F.col("size")).otherwise(0)).alias("n_noise"))
    if sizes.isEmpty():
        return totals.select("n_clusters", "n_noise", *[F.lit(None).cast(f.dataType).alias(f.name) for f in sizes.schema])
    return sizes.crossJoin(F.broadcast(totals)).select("n_clusters", "n_noise", label, "size")

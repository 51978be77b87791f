"""Forests and boosters against plain numpy."""

import json

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kiln.operators import boosting, forest, trees


def table(spark, x, y, parts=3):
    rows = [(int(i), [float(a) for a in v], float(t)) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id long, x array<double>, label double").repartition(parts, "id")
    return df.select("id", "x", array_to_vector("x").alias("scaled"), "label", F.xxhash64("id").alias("rid"))


def make(classes, n=260, seed=1):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 1)
    y = x[:, 0] * 2 + np.sin(3 * x[:, 1]) + 0.1 * rng.normal(size=n)
    return x, (np.digitize(y, [-1, 1]).astype(float) if classes else y)


def plain_tree(x, y, w, classes, min_split=2, max_depth=None):
    """The predictions of a tree grown by recursion over every cut."""
    out = np.zeros((len(x), max(classes, 1)))

    def impurity(y, w):
        if classes:
            return w.sum() - (np.bincount(y.astype(int), w) ** 2).sum() / w.sum()
        return (w * (y - (w * y).sum() / w.sum()) ** 2).sum()

    def go(ix, depth):
        yy, ww = y[ix], w[ix]
        out[ix] = np.bincount(yy.astype(int), ww, minlength=classes) / ww.sum() if classes else (ww * yy).sum() / ww.sum()
        if len(ix) < min_split or impurity(yy, ww) < 1e-10 or depth == max_depth:
            return
        cuts = [(impurity(yy[x[ix, f] <= t], ww[x[ix, f] <= t]) + impurity(yy[x[ix, f] > t], ww[x[ix, f] > t]), f, t)
                for f in range(x.shape[1]) for a, b in zip(np.unique(x[ix, f])[:-1], np.unique(x[ix, f])[1:]) for t in [a / 2 + b / 2]]
        if cuts:
            _, f, t = min(cuts)
            go(ix[x[ix, f] <= t], depth + 1)
            go(ix[x[ix, f] > t], depth + 1)

    go(np.arange(len(x)), 0)
    return out


@pytest.mark.parametrize("depth,min_split", [(None, 2), (3, 2), (None, 30), (0, 2)])
def test_one_feature_tree_equals_the_recursion(depth, min_split):
    rng = np.random.default_rng(4)
    for classes in (3, 0):
        x = np.round(rng.normal(size=(150, 1)), 2)
        y = rng.integers(0, 3, 150).astype(float) if classes else rng.normal(size=150)
        w = rng.integers(1, 4, 150).astype(float)
        t = trees.grow(x, forest._sums(y, w, classes), w, classes, 1, min_split, depth, 5)
        assert np.allclose(t["value"][trees.route(t, x)], plain_tree(x, y, w, classes, min_split, depth))


def test_trees_of_several_features():
    for classes in (3, 0):
        x, y = make(classes)
        w = np.ones(len(x))
        for depth in (1, None):
            t = trees.grow(x, forest._sums(y, w, classes), w, classes, 3, 2, depth, 5)
            assert np.allclose(t["value"][trees.route(t, x)], plain_tree(x, y, w, classes, 2, depth))
        order = np.random.default_rng(0).permutation(len(x))
        again = trees.grow(x[order], forest._sums(y[order], w, classes), w, classes, 3, 2, None, 5)
        assert all(np.array_equal(t[k], again[k]) for k in t)


def test_missing_values_and_constants():
    x = np.array([[np.nan, 1.0], [0.0, 1.0], [np.nan, 1.0], [1.0, 1.0]])
    y = np.array([1.0, 0.0, 1.0, 0.0])
    t = trees.grow(x, forest._sums(y, np.ones(4), 2), np.ones(4), 2, 1, 2, None, 1)
    assert (t["value"][trees.route(t, trees.clean(x))].argmax(axis=1) == y).all()
    same = trees.grow(np.ones((4, 2)), forest._sums(y, np.ones(4), 2), np.ones(4), 2, 1, 2, None, 1)
    assert same["feature"].tolist() == [-1] and same["value"][0].tolist() == [0.5, 0.5]


@pytest.mark.parametrize("classes", [3, 0])
def test_forest_equals_trees_grown_here(spark, classes):
    x, y = make(classes)
    df = table(spark, x, y)
    rid = np.array([r["rid"] for r in df.orderBy("id").select("rid").collect()])
    model = forest.fit_forest(df, classes, trees=5)
    votes = np.zeros((len(x), max(classes, 1)))
    for t in range(5):
        w = forest.weights(rid, t, 42).astype(float)
        k = w > 0
        tree = trees.grow(x[k], forest._sums(y[k], w[k], classes), w[k], classes, 1 if classes else 3, 2, None, int(trees.mixed(42, t, 0) >> np.uint64(1)))
        assert classes == 0 or (tree["value"][tree["feature"] < 0].max(axis=1) > 0.999).mean() > 0.9  # but for equal rows of two classes
        votes += tree["value"][trees.route(tree, x)]
    want = votes.argmax(axis=1) if classes else votes[:, 0] / 5
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert np.allclose([got[i] for i in range(len(x))], want)
    other = forest.fit_forest(table(spark, x, y, 7), classes, trees=5)
    assert sorted(map(tuple, other.nodes.collect())) == sorted(map(tuple, model.nodes.collect()))


@pytest.mark.parametrize("classes", [3, 0])
def test_large_nodes_are_split_before(spark, tmp_path, classes):
    x, y = make(classes, 900, 3)
    x[300:600] = x[300]  # a third of all rows alike
    df = table(spark, x, y)
    model = forest.fit_forest(df, classes, trees=6, part_cells=(3 + max(classes, 2)) * 120)
    parts = model.nodes.where("part >= 0").groupBy("tree").count().collect()
    assert all(r["count"] > 4 for r in parts) and len(parts) == 6
    whole = forest.fit_forest(df, classes, trees=6)

    def right(m):
        p = m.transform(df).select("label", "prediction").toPandas()
        return (p.label == p.prediction).mean() if classes else 1 - ((p.label - p.prediction) ** 2).mean() / p.label.var()

    assert right(model) > right(whole) - 0.05
    small = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    model.write().overwrite().save(str(tmp_path / "f"))
    loaded = forest.ForestModel.load(str(tmp_path / "f"))
    loaded.max_broadcast_bytes = 0  # the join
    joined = {r["id"]: r["prediction"] for r in loaded.transform(df.drop("label")).collect()}
    assert joined.keys() == small.keys() and all(abs(joined[i] - small[i]) < 1e-9 for i in small)


@pytest.mark.parametrize("classes", [3, 0])
def test_equal_rows_are_one_point_of_a_forest(spark, monkeypatch, classes):
    monkeypatch.setattr(forest, "TASK_ROWS", 64)  # equal rows of more than that are dealt to several tasks
    rng = np.random.default_rng(6)
    x = rng.integers(0, 3, size=(500, 3)).astype(float)
    x[:150] = x[0]
    y = (x.sum(axis=1) + rng.integers(0, 2, 500)) % (classes or 7)
    df = table(spark, x, y, 5)
    rid = {r["id"]: r["rid"] for r in df.collect()}
    rids = np.array([rid[i] for i in range(len(x))])
    shipped, grow = spark.sparkContext.accumulator(0), trees.grow
    monkeypatch.setattr(forest, "grow", lambda x, *a: shipped.add(len(x)) or grow(x, *a))
    model = forest.fit_forest(df, classes, trees=4)
    if classes:
        assert shipped.value <= 4 * (len(np.unique(x, axis=0)) + 9)  # points and the copies of the dealt ones, not 4 x 316 rows
    got = {(r.tree): forest._unpack(r, max(classes, 1)) for r in model.nodes.where("part >= 0").toPandas().itertuples()}
    for t in range(4):
        w = forest.weights(rids, t, 42).astype(float)
        k = w > 0
        tree = trees.grow(x[k], forest._sums(y[k], w[k], classes), w[k], classes, 1 if classes else 3, 2, None, int(trees.mixed(42, t, 0) >> np.uint64(1)))
        assert (got[t]["feature"] == tree["feature"]).all() and np.allclose(got[t]["value"], tree["value"])
    a = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    model.max_broadcast_bytes = 0
    b = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-9 for i in a)


def test_blocks_of_a_joined_part(spark, monkeypatch):
    monkeypatch.setattr(forest, "SCORE_ROWS", 40)
    x, y = make(3)
    model = forest.fit_forest(table(spark, x, y), 3, trees=3)
    df = table(spark, x, y, 9)
    a = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    model.max_broadcast_bytes = 0
    assert {r["id"]: r["prediction"] for r in model.transform(df).collect()} == a


def plain_booster(x, y, classes, stages, rate, depth):
    k_trees = classes if classes > 2 else 1
    share = np.bincount(y.astype(int)) / len(y) if classes else None
    scores = np.tile(boosting.start_scores(classes, share, y.mean()), (len(y), 1))
    losses = []
    for _ in range(stages):
        g, h, loss = boosting.gradients(classes, y, scores)
        losses.append(loss / len(y))
        step = np.zeros_like(scores)
        for k in range(k_trees):
            def go(ix, left, k=k):
                step[ix, k] = boosting.step_size(classes, g[ix, k].sum(), h[ix, k].sum())
                if not left:
                    return
                cuts = []
                for f in range(x.shape[1]):
                    v = np.unique(x[ix, f])
                    for b, t in enumerate(v[:-1] / 2 + v[1:] / 2):
                        lo = x[ix, f] <= t
                        nl, nr = lo.sum(), (~lo).sum()
                        cuts.append((-round(nl * nr / (nl + nr) * (g[ix, k][lo].mean() - g[ix, k][~lo].mean()) ** 2, 10), f, b, t))
                if cuts and -min(cuts)[0] > 1e-10:
                    _, f, _, t = min(cuts)
                    go(ix[x[ix, f] <= t], left - 1)
                    go(ix[x[ix, f] > t], left - 1)
            go(np.arange(len(x)), depth)
        scores += rate * step
    return losses, scores


@pytest.mark.parametrize("classes,cells", [(3, 1 << 20), (3, 200), (2, 1 << 20), (0, 200)])
def test_booster_equals_numpy(spark, monkeypatch, classes, cells):
    monkeypatch.setattr(boosting, "TASK_CELLS", cells)
    monkeypatch.setattr(boosting, "KEEP", 3)
    x, y = make(classes, 200)
    x = np.round(x + np.random.default_rng(8).normal(size=x.shape) * 0.3, 2)
    if classes == 2:
        y = (y > 1).astype(float)
    df = table(spark, x, y, 6)
    model = boosting.fit_boosting(df, classes, 7, 0.3, 2)
    losses, scores = plain_booster(x, y, classes, 7, 0.3, 2)
    assert np.allclose(model.loss, losses, rtol=1e-6)
    assert all(b < a for a, b in zip(model.loss, model.loss[1:]))  # the loss falls each stage
    got = {r["id"]: r["prediction"] for r in model.transform(df).collect()}
    want = scores.argmax(axis=1) if classes > 2 else (scores[:, 0] > 0).astype(float) if classes else scores[:, 0]
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-6)


@pytest.mark.parametrize("classes", [3, 2, 0])
def test_booster_passes_over_distinct_bins(spark, monkeypatch, classes):
    rng = np.random.default_rng(5)
    x = rng.integers(0, 4, size=(600, 3)).astype(float)  # at most 64 combinations
    y = (x.sum(axis=1) + rng.integers(0, 3, 600)) % (classes or 9)
    seen, pack = [], boosting._blocks
    monkeypatch.setattr(boosting, "_blocks", lambda points, *a: seen.append(points.count()) or pack(points, *a))
    model = boosting.fit_boosting(table(spark, x, y, 6), classes, 5, 0.3, 2)
    assert seen == [len(np.unique(x, axis=0))]
    losses, _ = plain_booster(x, y, classes, 5, 0.3, 2)
    assert np.allclose(model.loss, losses, rtol=1e-9)


def test_booster_of_one_class_and_many_values(spark):
    x, y = make(3, 120)
    one = boosting.fit_boosting(table(spark, x, y * 0), 3, 3)
    assert {r["prediction"] for r in one.transform(table(spark, x, y)).collect()} == {0.0}
    rng = np.random.default_rng(0)
    xs = rng.normal(size=(1500, 1))
    m = boosting.fit_boosting(table(spark, xs, 3 * xs[:, 0]), 0, 30, 0.3, 3)
    assert m.loss[-1] < 0.02 * m.loss[0] and len(json.loads(m.getOrDefault(m.spec))["stages"]) == 30


def test_rows_find_their_leaf_by_the_bits_of_the_cuts():
    rng = np.random.default_rng(3)
    bins = rng.integers(0, 40, size=(3, 500)).astype(np.uint8)
    for cuts in (0, 1, 7, 10, 20):  # none, few, a wide code, and more than a code holds
        tree = {"feature": [-1], "bin": [0], "left": [-1], "right": [-1]}
        for _ in range(cuts):
            node = int(rng.choice(np.flatnonzero(np.array(tree["feature"]) < 0)))
            tree["feature"][node], tree["bin"][node] = int(rng.integers(3)), int(rng.integers(40))
            tree["left"][node], tree["right"][node] = len(tree["feature"]), len(tree["feature"]) + 1
            for c, v in (("feature", -1), ("bin", 0), ("left", -1), ("right", -1)):
                tree[c] += [v, v]
        tree = {c: np.array(v) for c, v in tree.items()}
        nodes, code = boosting.paths(tree, bins)
        assert (nodes[code] == trees.route({**tree, "threshold": tree["bin"]}, bins.T)).all()


def test_radix_order_is_the_stable_order():
    rng = np.random.default_rng(4)
    for nodes, ranks in ((1, 5), (300, 40), (5000, 900), (1 << 20, 1 << 18)):
        node, rank = rng.integers(0, nodes, 3000), rng.integers(0, ranks, 3000)
        assert (trees.sorted_by(node, rank) == np.lexsort((rank, node))).all()


def test_trees_are_grown_in_many_tasks_whatever_the_input_files(spark):
    x, y = make(3, 400)
    model = forest.fit_forest(table(spark, x, y, 1), 3, 24)  # one partition, as a file of one row group
    tasks = model.nodes.where("part >= 0").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert tasks <= 4  # of 24 trees; they were put together by their few bytes before

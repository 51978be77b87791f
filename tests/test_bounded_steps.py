"""Steps whose driver or task load must not follow the input."""

import numpy as np
from pyspark.sql import functions as F

from kiln.operators import neighbours


def test_tree_sample_orders_few_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "SAMPLE_ROWS", 64)
    points = spark.range(20_000, numPartitions=8).select(F.col("id").alias("tid"), F.array(F.rand(3), F.rand(4)).alias("x")).cache()
    kind, ordered = type(points), []
    order = kind.orderBy
    monkeypatch.setattr(kind, "orderBy", lambda self, *by: ordered.append(self.count()) or order(self, *by))
    tree = neighbours.build_tree(points, "tid", "x", 8)
    assert len(ordered) == 1 and 64 <= ordered[0] < 400
    monkeypatch.undo()
    first = points.orderBy(F.xxhash64("tid"), "tid").limit(64).select("x").toPandas()["x"]
    assert tree.cut == neighbours.SpaceTree(np.stack(first.to_numpy()), tree.n_cells, 8).cut


def test_tree_sample_of_a_key_that_repeats(spark):
    points = spark.range(70_000).select(F.lit(1).alias("tid"), F.array(F.col("id").cast("double")).alias("x"))
    assert neighbours.build_tree(points, "tid", "x", 8).n_cells == 70_000 // neighbours.CELL_ROWS


def _kernel_rows(spark):
    from pyspark.ml.functions import array_to_vector
    from kiln.operators import models
    rng = np.random.default_rng(1)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] + x[:, 1] ** 2 + rng.normal(size=1500) * 0.7) > 1).astype(int) + ((x[:, 2] + rng.normal(size=1500)) > 1.5)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, label double")
    kernel = models.RandomFourierFeatures(inputCol="scaled", outputCol="features", spec=models.RandomFourierFeatures.make_spec(3, 1 / 3, 40))
    return models, kernel, rows.select(array_to_vector("x").alias("scaled"), "label").cache(), kernel.projection()[0](x), y


def _held(monkeypatch, spark):
    """The columns and the longest vector of everything that is persisted from now on."""
    from pyspark.sql.classic.dataframe import DataFrame
    seen, persist = [], DataFrame.persist
    monkeypatch.setattr(DataFrame, "persist", lambda self, *a: seen.append(self) or persist(self, *a))
    return lambda: max(len(v) for df in seen for v in df.first() if hasattr(v, "__len__"))


def _hinge(z, y, k, reg):
    sign, d = np.where(y == k, 1.0, -1.0), z.shape[1]

    def at(t):
        gap = 1 - sign * (z @ t[:d] + t[d])
        pull = np.where(gap > 0, -sign, 0.0) / len(y)
        return np.maximum(gap, 0).mean() + 0.5 * reg * t[:d] @ t[:d], np.append(pull @ z + reg * t[:d], pull.sum())

    return at


def test_kernel_svc_holds_no_features(spark, monkeypatch):
    import json
    models, kernel, rows, z, y = _kernel_rows(spark)
    longest, fit = _held(monkeypatch, spark), models.fit_svc
    monkeypatch.setattr(models, "fit_svc", lambda *a: fit(*a, max_iter=4))
    stages = models.fit_model(rows, "classification", "SVM", {"kernel": "rbf", "components": 40}, 3, 1500)
    assert longest() == 3
    spec = json.loads(stages[1].getOrDefault("spec"))
    z = kernel.projection()[0](np.stack([r["scaled"].toArray() for r in rows.select("scaled").collect()]))
    inverse = 1 / z.std(axis=0, ddof=1)
    for k in range(3):  # the same steps by numpy alone, in scaled weights
        value, run = _hinge(z, y, k, 1 / 1500), models._descent(np.zeros(41), 4)
        scale = np.append(inverse, 1.0)
        point = next(run)
        try:
            while True:
                v, g = value(point * scale)
                point = run.send((v, g * scale))
        except StopIteration as end:
            assert np.allclose(end.value * scale, [*spec["w"][k], spec["b"][k]], rtol=1e-6, atol=1e-9)


def test_kernel_svc_passes_over_distinct_rows(spark, monkeypatch):
    import json
    from pyspark.ml.functions import array_to_vector
    models, kernel, _, _, _ = _kernel_rows(spark)
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, size=(400, 3)).astype(float)
    y = (x[:, 0] > x[:, 1]) + rng.integers(0, 2, 400)
    rows = spark.createDataFrame([(v.tolist(), float(t)) for v, t in zip(x, y)], "x array<double>, label double")
    made, blocks = spark.sparkContext.accumulator(0), models._point_blocks

    def counted(batches, project):
        for z, c in blocks(batches, project):
            made.add(len(z))
            yield z, c

    monkeypatch.setattr(models, "_point_blocks", counted)
    m = models.fit_svc(rows.select(array_to_vector("x").alias("scaled"), "label"), "label", kernel, 0.01, max_iter=0)
    places = len(np.unique(x, axis=0))
    assert made.value == 3 * places  # two passes of moments, and one of losses
    z = kernel.projection()[0](x)
    inverse = 1 / z.std(axis=0, ddof=1)
    m = models.fit_svc(rows.select(array_to_vector("x").alias("scaled"), "label"), "label", kernel, 0.01, max_iter=3)
    spec = json.loads(m.getOrDefault("spec"))
    for k in range(3):
        value, run, scale = _hinge(z, y, k, 0.01), models._descent(np.zeros(41), 3), np.append(inverse, 1.0)
        point = next(run)
        try:
            while True:
                v, g = value(point * scale)
                point = run.send((v, g * scale))
        except StopIteration as end:
            assert np.allclose(end.value * scale, [*spec["w"][k], spec["b"][k]], rtol=1e-6, atol=1e-9)


def test_descent_goes_below_the_optimum_of_linear_svc(spark):
    from pyspark.ml.classification import LinearSVC
    models, kernel, rows, z, y = _kernel_rows(spark)
    m = LinearSVC(regParam=1 / 1500, standardization=False, maxIter=100).fit(kernel.transform(rows.withColumn("label", (F.col("label") == 0).cast("double"))))
    value, run = _hinge(z, y, 0, 1 / 1500), models._descent(np.zeros(41), 200)
    point = next(run)
    try:
        while True:
            point = run.send(value(point))
    except StopIteration as end:
        assert value(end.value)[0] <= value(np.append(m.coefficients.toArray(), m.intercept))[0] * 1.002


def test_kernel_svr_holds_no_features(spark, monkeypatch):
    import json
    models, kernel, rows, _, _ = _kernel_rows(spark)
    fit = models.fit_svr
    plain = fit(kernel.transform(rows), "features", "label", max_iter=2)
    longest = _held(monkeypatch, spark)
    monkeypatch.setattr(models, "fit_svr", lambda *a, **k: fit(*a, max_iter=2, **k))
    stages = models.fit_model(rows, "regression", "SVM", {"components": 40}, 3, 1500)
    assert longest() == 3
    assert np.allclose(json.loads(stages[1].getOrDefault("spec"))["w"], json.loads(plain.getOrDefault("spec"))["w"], atol=1e-9)


def test_workbooks_are_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    from kiln.sources import xlsx
    monkeypatch.setattr(xlsx, "BOOK_ROWS", 100)
    monkeypatch.setattr(xlsx, "BATCH_ROWS", 7)
    df = spark.range(250, numPartitions=1).select("id", F.when(F.col("id") % 7 != 0, F.col("id") / 4).alias("v"), F.concat(F.lit(" <&"), "id").alias("s"))
    assert xlsx.write_xlsx(df, str(tmp_path)) == 250
    assert len(list(tmp_path.glob("*.xlsx"))) == 3
    back = xlsx.read_xlsx(spark, str(tmp_path), df.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert xlsx.write_xlsx(df.limit(0), str(tmp_path)) == 0

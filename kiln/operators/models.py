"""Model preparation, training, tuning, evaluation and persistence
(M1-M15, I8, N6, S6) on ``pyspark.ml``.

Parameter mappings that differ from Spark ML defaults on purpose:
logistic / SVM ``C`` becomes ``regParam = 1 / (C * n)`` without
standardization (the same objective as the reference's solver); ridge
``alpha`` becomes ``regParam = alpha * std_pop(y) / n``; lasso ``alpha``
is ``regParam`` with ``elasticNetParam = 1``.  Forests and boosters are the
library's own (``forest``, ``boosting``): trees of any depth.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
import pyarrow as pa

from pyspark import keyword_only
from pyspark.ml import Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest
from pyspark.ml.feature import (Imputer, IndexToString, SQLTransformer, StandardScaler, StringIndexer,
                                StringIndexerModel, VectorAssembler)
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.regression import LinearRegression
from pyspark.ml.util import (DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter, MLReadable,
                             MLReader, MLWritable, MLWriter)
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.quantile import order_statistics
from kiln.operators.boosting import fit_boosting
from kiln.operators.forest import fit_forest
from kiln.session import ensure_checkpoint_dir

MAX_CATEGORIES = 10   # text features with more distinct values are dropped
SPLIT_SEED = 42

# The model registry and hyper-parameter grids of the reference.
MODELS = {
    "classification": {
        "Random Forest": {"n_estimators": [100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5]},
        "Logistic Regression": {"C": [0.1, 1, 10], "penalty": ["l2"]},
        "Gradient Boosting": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]},
        "SVM": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"]},
        "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    },
    "regression": {
        "Random Forest": {"n_estimators": [100, 200], "max_depth": [None, 10, 20], "min_samples_split": [2, 5]},
        "Linear Regression": {},
        "Ridge Regression": {"alpha": [0.1, 1, 10]},
        "Lasso Regression": {"alpha": [0.1, 1, 10]},
        "Gradient Boosting": {"n_estimators": [50, 100], "learning_rate": [0.01, 0.1], "max_depth": [3, 5]},
        "SVM": {"C": [0.1, 1, 10], "kernel": ["linear", "rbf"]},
        "K-Nearest Neighbors": {"n_neighbors": [3, 5, 7], "weights": ["uniform", "distance"]},
    },
}


# ---------------------------------------------------------------- M1 prepare

@dataclass
class Prepared:
    stages: list
    features: list[str]
    dropped: list[str]


def prepare(df: DataFrame, features: list[str], preprocess: bool = True) -> Prepared:
    """M1: text features with more than 10 distinct values are dropped, the
    others become dummies with the first sorted category dropped (E3).  All
    of it is expressed as pipeline stages, so a saved model accepts raw
    rows."""
    text = [c for c in features if isinstance(df.schema[c].dataType, T.StringType)]
    stages, feats, dropped = [], [c for c in features if c not in text], []
    if preprocess and text:
        d = df.agg(*[F.count_distinct(c).alias(c) for c in text]).collect()[0]
        dummies = []
        for c in text:
            if d[c] > MAX_CATEGORIES:
                dropped.append(c)
                continue
            cats = sorted(r[0] for r in df.select(c).where(F.col(c).isNotNull()).distinct().collect())
            for v in cats[1:]:
                name = f"{c}_{v}"
                lit = str(v).replace("'", "''")
                dummies.append(f"CASE WHEN `{c}` = '{lit}' THEN 1.0 ELSE 0.0 END AS `{name}`")
                feats.append(name)
        if dummies:
            stages.append(SQLTransformer(statement=f"SELECT *, {', '.join(dummies)} FROM __THIS__"))
    elif text:
        dropped += text
    return Prepared(stages, feats, dropped)


def class_names(df: DataFrame, target: str) -> list[str]:
    """The classes of a target in sorted order (numbers by value), as text.  A model holds one output per class, so
    they are on the driver with it."""
    rows = df.select(target).where(F.col(target).isNotNull()).distinct().collect()
    if isinstance(df.schema[target].dataType, T.StringType):
        return sorted(r[0] for r in rows)
    spark = df.sparkSession
    values = spark.createDataFrame([(i, r[0]) for i, r in enumerate(sorted(rows, key=lambda r: r[0]))],
                                   T.StructType([T.StructField("i", T.IntegerType()), df.schema[target]]))
    return [r["s"] for r in values.orderBy("i").select(F.col(target).cast("string").alias("s")).collect()] if rows else []


def with_label(df: DataFrame, target: str, classes: list[str] | None) -> DataFrame:
    """Training rows with a ``label``: the class number, or the target as a double.  Rows without a target are left out.
    This is no part of a saved model, which therefore scores rows that have no target."""
    rows = df.where(F.col(target).isNotNull())
    if classes is None:
        return rows.withColumn("label", F.col(target).cast("double"))
    indexer = StringIndexerModel.from_labels(classes, inputCol="_target", outputCol="label", handleInvalid="skip")
    return indexer.transform(rows.withColumn("_target", F.col(target).cast("string"))).drop("_target")


# ---------------------------------------------------------------- M2 split

def split_hash(key: list[str], seed: int = SPLIT_SEED) -> F.Column:
    """A uniform 52-bit number from md5(key | seed): stable under any
    partitioning, and the same value DuckDB computes."""
    s = F.concat_ws("|", *[F.col(k).cast("string") for k in key], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(s), 1, 13), 16, 10).cast("long")


def train_test_split(df: DataFrame, key: list[str], test_size: float = 0.2,
                     seed: int = SPLIT_SEED) -> tuple[DataFrame, DataFrame]:
    """M2: the test set is the ``ceil(test_size * n)`` rows with the
    smallest hash.  The cut is an exact order statistic of the hash
    (bounded selection, no sort of the table)."""
    h = df.withColumn("_split", split_hash(key, seed).cast("double"))
    n = df.count()
    k = int(math.ceil(test_size * n))
    if k <= 0:
        return h.drop("_split"), h.where(F.lit(False)).drop("_split")
    cut = order_statistics(h, "_split", [k - 1])[0]
    test = h.where(F.col("_split") <= F.lit(cut)).drop("_split")
    train = h.where(F.col("_split") > F.lit(cut)).drop("_split")
    return train, test


def row_hash(key: list[str]) -> F.Column:
    """A hash of the rows' keys, ``rid``: draws that follow from it are the same under any partitioning."""
    return F.xxhash64(*[F.col(k) for k in key], F.lit(SPLIT_SEED)).alias("rid")


# ---------------------------------------------------------------- M3-M12 estimators

def _estimator(problem_type: str, name: str, n_train: int, y_std: float, params: dict | None = None):
    p = params or {}
    cls = problem_type == "classification"
    if name == "Logistic Regression":
        c = float(p.get("C", 1.0))
        return LogisticRegression(featuresCol="features", labelCol="label", regParam=1.0 / (c * n_train),
                                  elasticNetParam=0.0, standardization=False, maxIter=100, family="multinomial")
    if name == "SVM" and cls:
        c = float(p.get("C", 1.0))
        svc = LinearSVC(featuresCol="features", labelCol="label", regParam=1.0 / (c * n_train),
                        standardization=False, maxIter=100)
        return OneVsRest(classifier=svc, featuresCol="features", labelCol="label")
    if name == "Linear Regression":
        return LinearRegression(featuresCol="features", labelCol="label", regParam=0.0, solver="normal")
    if name == "Ridge Regression":
        a = float(p.get("alpha", 1.0))
        return LinearRegression(featuresCol="features", labelCol="label", regParam=a * y_std / n_train,
                                elasticNetParam=0.0, standardization=False, solver="normal")
    if name == "Lasso Regression":
        a = float(p.get("alpha", 1.0))
        return LinearRegression(featuresCol="features", labelCol="label", regParam=a,
                                elasticNetParam=1.0, standardization=False)
    raise ValueError(f"model {name!r} is not available for {problem_type}")


@dataclass
class Trained:
    model: PipelineModel
    metrics: dict
    features: list[str]
    classes: list[str] | None
    best_params: dict
    predictions: DataFrame
    grid: list[tuple[dict, float]] | None = None  # every setting with its mean score over the folds


def featurizer(prep: Prepared, preprocess: bool = True) -> Pipeline:
    """M3: imputer and scaler over the prepared features (or the bare features), from raw rows to ``scaled``."""
    feats = prep.features
    cast = SQLTransformer(statement="SELECT *, " + ", ".join(f"CAST(`{c}` AS DOUBLE) AS `{c}__d`" for c in feats) + " FROM __THIS__")
    dcols = [f"{c}__d" for c in feats]
    if not preprocess:
        return Pipeline(stages=prep.stages + [cast, VectorAssembler(inputCols=dcols, outputCol="scaled", handleInvalid="keep")])
    return Pipeline(stages=prep.stages + [
        cast, Imputer(inputCols=dcols, outputCols=[f"{c}__i" for c in feats], strategy="mean"),
        VectorAssembler(inputCols=[f"{c}__i" for c in feats], outputCol="raw", handleInvalid="keep"),
        StandardScaler(inputCol="raw", outputCol="scaled", withMean=True, withStd=True)])


class Copy(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """A column under another name."""

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        return dataset.withColumn(self.getOutputCol(), F.col(self.getInputCol()))


def reads_rows_often(problem_type: str, name: str, params: dict) -> bool:
    """Whether a fit scans its rows many times.  Spark's iterative estimators keep them in blocks of their own: there a second
    copy of the features only drives those blocks out of memory."""
    linear = name == "SVM" and problem_type == "classification" and params.get("kernel", "rbf") == "linear"
    return not linear and name not in ("Logistic Regression", "Lasso Regression")


def fit_model(data: DataFrame, problem_type: str, name: str, params: dict, n_features: int, n_rows: int) -> list:
    """Stages fitted on ``data(scaled, label, rid)`` (``rid``: a hash of the rows' keys) that turn ``scaled`` into ``prediction``; penalties follow from ``n_rows``."""
    cls = problem_type == "classification"
    if name == "K-Nearest Neighbors":
        return [fit_knn(data, int(params.get("n_neighbors", 5)), params.get("weights", "uniform"), cls)]
    if name in ("Random Forest", "Gradient Boosting"):
        classes = int(data.agg(F.max("label")).first()[0] or 0) + 1 if cls else 0
        depth = params.get("max_depth", None if name == "Random Forest" else 3)
        depth, count = None if depth is None else int(depth), int(params.get("n_estimators", 100))
        if name == "Random Forest":
            return [fit_forest(data, classes, count, depth, int(params.get("min_samples_split", 2)), seed=SPLIT_SEED)]
        return [fit_boosting(data, classes, count, float(params.get("learning_rate", 0.1)), depth)]
    if name == "SVM" and params.get("kernel", "rbf") == "rbf":
        spec = RandomFourierFeatures.make_spec(n_features, 1.0 / max(n_features, 1), int(params.get("components", 200)))
        kernel = RandomFourierFeatures(inputCol="scaled", outputCol="features", spec=spec)
        if cls:
            return [kernel, fit_svc(data, "label", kernel, 1.0 / (float(params.get("C", 1.0)) * n_rows))]
        return [kernel, fit_svr(data, "features", "label", float(params.get("C", 1.0)), float(params.get("epsilon", 0.1)), kernel=kernel)]
    kernel = Copy(inputCol="scaled", outputCol="features")
    data = kernel.transform(data)
    if name == "SVM" and not cls:
        return [kernel, fit_svr(data, "features", "label", float(params.get("C", 1.0)), float(params.get("epsilon", 0.1)))]
    y_std = 0.0
    if name == "Ridge Regression":
        y_std = data.agg(F.stddev_pop("label")).first()[0] or 0.0
    estimator = _estimator(problem_type, name, n_rows, y_std, params)
    if ROWS in data.columns:
        estimator.setWeightCol(ROWS)
    return [kernel, estimator.fit(data)]


ROWS = "_rows"  # how many rows a row of ``counted`` stands for


def counted(data: DataFrame) -> DataFrame:
    """``data(scaled, label)`` with equal rows as one, and their number: all that a weighted fit and counts of predictions need."""
    return data.groupBy("scaled", "label").agg(F.count(F.lit(1)).cast("double").alias(ROWS))


def settings(problem_type: str, name: str) -> list[dict]:
    """Every combination of the model's grid."""
    grid = MODELS[problem_type][name]
    return [dict(zip(grid, values)) for values in product(*grid.values())]


def with_folds(rows: DataFrame, key: list[str], folds: int, stratified: bool) -> DataFrame:
    """A ``fold`` per row: within each class (or overall) the rows in hash order are dealt in turn, so every fold has its share.

    Positions are ranks within bounded buckets of the hash, continued by the bucket counts before: no class is sorted in one task."""
    groups = ["label"] if stratified else []
    h = F.xxhash64(*[F.col(k) for k in key], F.lit(SPLIT_SEED))
    rows = rows.withColumn("_h", h).withColumn("_b", F.shiftright("_h", 54))  # 1024 buckets
    counts = rows.groupBy(*groups, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_off", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_b")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy(*groups, "_b").orderBy("_h", *key)) - 1
    out = rows.withColumn("_i", local).join(F.broadcast(before), [*groups, "_b"])  # classes x 1024 rows
    return out.withColumn("fold", ((F.col("_i") + F.col("_off")) % folds).cast("int")).drop("_h", "_b", "_i", "_off")


def grid_search(rows: DataFrame, prep: Prepared, problem_type: str, name: str, key: list[str], preprocess: bool = True,
                folds: int = 5, parallelism: int = 4, base: dict | None = None) -> list[tuple[dict, float]]:
    """The mean score (accuracy or R^2) of every setting over stratified folds; imputer, scaler and penalty come from each
    fold's own training rows."""
    cls = problem_type == "classification"
    dealt = with_folds(rows, key, folds, cls).persist()
    choices = settings(problem_type, name)
    scores: list[list[float]] = [[] for _ in choices]
    try:
        for f in range(folds):
            part = dealt.where(F.col("fold") != f).drop("fold")
            prepared = featurizer(prep, preprocess).fit(part)
            train = prepared.transform(part).select("scaled", "label", row_hash(key))
            valid = prepared.transform(dealt.where(F.col("fold") == f).drop("fold")).select("scaled", "label")
            often = any(reads_rows_often(problem_type, name, {**(base or {}), **c}) for c in choices)
            if name == "Logistic Regression":  # every setting passes over its rows many times: over the different ones
                train, valid = counted(train), counted(valid)
            held = often or name == "Logistic Regression"
            if held:
                train.persist()
                valid.persist()
            n = train.count() if often else part.count()

            def run(choice: dict) -> float:
                stages = fit_model(train, problem_type, name, {**(base or {}), **choice}, len(prep.features), n)
                pred = PipelineModel(stages=stages).transform(valid)
                m = classification_metrics(pred, rows=ROWS if ROWS in pred.columns else None) if cls else regression_metrics(pred)
                return m["accuracy"] if cls else m["r2"]

            with ThreadPool(min(parallelism, len(choices))) as pool:
                for so_far, value in zip(scores, pool.map(run, choices)):
                    so_far.append(float("nan") if value is None else float(value))
            if held:
                train.unpersist()
                valid.unpersist()
    finally:
        dealt.unpersist()
    return [(c, sum(s) / len(s)) for c, s in zip(choices, scores)]


def train(df: DataFrame, target: str, features: list[str], model: str, problem_type: str,
          key: list[str], use_grid_search: bool = False, preprocess: bool = True,
          parallelism: int = 4, params: dict | None = None) -> Trained:
    """Prepare, split, fit imputer -> scaler -> model (training rows
    only), optionally a 5-fold grid search over the model's grid, evaluate
    on the test rows.  The result scores raw rows without the target; for
    a classification it also names the class."""
    if model not in MODELS[problem_type]:
        raise ValueError(f"model {model!r} is not available for {problem_type}")
    cls = problem_type == "classification"
    prep = prepare(df, features, preprocess)
    names = class_names(df, target) if cls else None
    used = [c for c in dict.fromkeys([*key, *features, target])]
    # the split and the iterative fitters scan these rows many times: keep them once
    base = with_label(df.select(*used), target, names).persist()
    train_df, test_df = train_test_split(base, key)
    try:
        chosen, tried = dict(params or {}), None
        if use_grid_search and len(settings(problem_type, model)) > 1:
            tried = grid_search(train_df, prep, problem_type, model, key, preprocess, parallelism=parallelism, base=params)
            chosen.update(max(tried, key=lambda x: (x[1] == x[1], x[1]))[0])
        prepared = featurizer(prep, preprocess).fit(train_df)
        data = prepared.transform(train_df).select("scaled", "label", row_hash(key))
        often = reads_rows_often(problem_type, model, chosen)
        if tried and model == "Logistic Regression":
            data = counted(data)
        held = often or ROWS in data.columns
        if held:
            data.persist()
        stages = fit_model(data, problem_type, model, chosen, len(prep.features), data.count() if often else train_df.count())
        if cls:
            stages = [*stages, IndexToString(inputCol="prediction", outputCol="predicted_class", labels=names)]
        fitted = PipelineModel(stages=prepared.stages + stages)
        pred = fitted.transform(test_df)
        metrics = classification_metrics(pred) if cls else regression_metrics(pred)
        if held:
            data.unpersist()
    finally:
        base.unpersist()
    return Trained(fitted, metrics, prep.features, names, chosen if tried or params else {}, pred, tried)


# ---------------------------------------------------------------- M14-M15 metrics

def classification_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> dict:
    """Accuracy and support-weighted F1, one aggregate over a
    (label, prediction) confusion table."""
    return metrics_frame_classification(pred, label, prediction, rows).collect()[0].asDict()


def metrics_frame_classification(pred: DataFrame, label: str = "label", prediction: str = "prediction", rows: str | None = None) -> DataFrame:
    """``rows``: a column with the number of rows that each row stands for."""
    many = F.sum(rows).cast("long") if rows else F.count(F.lit(1))
    cm = pred.groupBy(F.col(label).alias("y"), F.col(prediction).alias("p")).agg(many.alias("c"))
    # no filter under the counts: both reads of the table are one exchange, and the rows are scored once
    sup = cm.groupBy(F.col("y").alias("k")).agg(F.sum("c").alias("support"), F.sum(F.when(F.col("y") == F.col("p"), F.col("c"))).alias("tp"))
    npred = cm.groupBy(F.col("p").alias("k")).agg(F.sum("c").alias("npred"))
    per = sup.join(npred, "k", "full").fillna(0, ["tp", "support", "npred"])
    f1 = F.when(F.col("support") + F.col("npred") > 0, 2 * F.col("tp") / (F.col("support") + F.col("npred"))).otherwise(0.0)
    return per.agg((F.sum("tp") / F.sum("support")).alias("accuracy"),
                   (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1_weighted"),
                   F.sum("support").alias("n"))


def regression_metrics(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> dict:
    """RMSE and R^2."""
    return metrics_frame_regression(pred, label, prediction).collect()[0].asDict()


def metrics_frame_regression(pred: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    return pred.agg(F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
                    (1 - F.sum((y - p) * (y - p)) / (F.count(y) * F.var_pop(y))).alias("r2"),
                    F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- S6, M16, E8

def save_model(trained: Trained, path: str) -> None:
    """The fitted pipeline; feature names and class names live in its stages."""
    trained.model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Score a whole table (or a streaming DataFrame) of raw rows, with or without the target: ``prediction``, and
    ``predicted_class`` for a classification (E8).  Columns that the model makes on the way are left out."""
    out = model.transform(df)
    return out.select(*df.columns, *[c for c in ("prediction", "predicted_class") if c in out.columns])


# ---------------------------------------------------------------- N6 RFE

def rfe(df: DataFrame, target: str, k: int = 5, step: int = 1) -> tuple[DataFrame, dict]:
    """Recursive feature elimination with logistic regression: drop the
    feature with the smallest summed squared coefficient until k remain."""
    from kiln.functions.nulls import numeric_columns
    feats = [c for c in numeric_columns(df) if c != target]
    data = df.select(*[F.col(c).cast("double").alias(c) for c in feats],
                     F.col(target).alias(target)).na.drop()
    idx = StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc").fit(data) \
        if isinstance(df.schema[target].dataType, T.StringType) else None
    data = idx.transform(data) if idx else data.withColumn("label", F.col(target).cast("double"))
    data = VectorAssembler(inputCols=feats, outputCol="all").transform(data).select("all", "label").cache()
    n = data.count()
    remaining = list(range(len(feats)))
    ranking = {}
    rank_next = len(feats) - k + 1
    try:
        from pyspark.ml.feature import VectorSlicer
        while len(remaining) > k:
            sl = VectorSlicer(inputCol="all", outputCol="features", indices=remaining).transform(data)
            lr = LogisticRegression(regParam=1.0 / n, elasticNetParam=0.0, standardization=False,
                                    maxIter=1000, family="multinomial").fit(sl)
            coef = lr.coefficientMatrix.toArray()
            imp = (coef ** 2).sum(axis=0)
            order = sorted(range(len(remaining)), key=lambda j: imp[j])
            for j in order[:min(step, len(remaining) - k)]:
                ranking[feats[remaining[j]]] = rank_next
            drop = {remaining[j] for j in order[:min(step, len(remaining) - k)]}
            remaining = [r for r in remaining if r not in drop]
            rank_next -= 1
    finally:
        data.unpersist()
    for r in remaining:
        ranking[feats[r]] = 1
    keep = [feats[r] for r in remaining]
    return df.select(*keep, target), {"selected_features": keep, "ranking": ranking}


# ---------------------------------------------------------------- M7 rbf kernel

class RandomFourierFeatures(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features (Rahimi & Recht, 2007) approximating the RBF
    kernel exp(-gamma |x - y|^2): z(x) = sqrt(2 / D) cos(W x + b).  The
    projection is a plain column expression (codegen), and the weights are
    a param, so the stage saves and loads with the pipeline."""

    spec = Param(Params._dummy(), "spec", "JSON weights and offsets", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    @staticmethod
    def make_spec(dim: int, gamma: float, components: int = 200, seed: int = SPLIT_SEED) -> str:
        import json
        import numpy as np
        rng = np.random.default_rng(seed)
        w = rng.normal(scale=math.sqrt(2.0 * gamma), size=(components, dim))
        b = rng.uniform(0, 2 * math.pi, size=components)
        return json.dumps({"w": w.tolist(), "b": b.tolist()})

    def projection(self):
        """The features of a matrix of rows, as a function that tasks can run; and how many there are."""
        import json
        s = json.loads(self.getOrDefault(self.spec))
        w, b = np.asarray(s["w"]), np.asarray(s["b"])
        scale = math.sqrt(2.0 / len(b))
        return (lambda x: np.cos(x @ w.T + b) * scale), len(b)

    def _transform(self, dataset):
        features, _ = self.projection()

        @F.pandas_udf(T.ArrayType(T.DoubleType()))
        def project(v: pd.Series) -> pd.Series:
            return pd.Series(list(features(np.stack(v.to_numpy()))))

        return dataset.withColumn(self.getOutputCol(),
                                  array_to_vector(project(vector_to_array(F.col(self.getInputCol())))))


# ---------------------------------------------------------------- M8 SVR

def _lbfgs(fg, x0: np.ndarray, max_iter: int = 100, m: int = 10, tol: float = 1e-6) -> np.ndarray:
    """Limited-memory BFGS with a backtracking (Armijo) line search; ``fg``
    returns (value, gradient).  Each evaluation is one distributed pass."""
    x = x0.copy()
    f, g = fg(x)
    s_hist, y_hist = [], []
    for _ in range(max_iter):
        if np.linalg.norm(g) <= tol * max(1.0, abs(f)):
            break
        q = g.copy()
        alphas = []
        for s, y in reversed(list(zip(s_hist, y_hist))):
            a = s.dot(q) / y.dot(s)
            alphas.append(a)
            q -= a * y
        if s_hist:
            q *= s_hist[-1].dot(y_hist[-1]) / y_hist[-1].dot(y_hist[-1])
        for (s, y), a in zip(zip(s_hist, y_hist), reversed(alphas)):
            q += s * (a - y.dot(q) / y.dot(s))
        d = -q
        step = 1.0
        while True:
            xn = x + step * d
            fn, gn = fg(xn)
            if fn <= f + 1e-4 * step * g.dot(d) or step < 1e-12:
                break
            step *= 0.5
        s, y = xn - x, gn - g
        if s.dot(y) > 1e-12:
            s_hist.append(s)
            y_hist.append(y)
            if len(s_hist) > m:
                s_hist.pop(0)
                y_hist.pop(0)
        x, f, g = xn, fn, gn
    return x


PASS_ROWS = 2048      # rows whose features a task holds at once
TASK_POINTS = 1 << 17  # points of a task once all cores have one


def _blocks(batches, project=None):
    """(features, label) of the rows of Arrow batches ``(x, y)``, PASS_ROWS at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x, y = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1), batch.column(1).to_numpy(zero_copy_only=False)
        for lo in range(0, n, PASS_ROWS):
            part = x[lo:lo + PASS_ROWS]
            yield project(part) if project else part, y[lo:lo + PASS_ROWS]


def _point_blocks(batches, project):
    """(features, rows of each class) of the points of Arrow batches ``(x, c0, c1, ..)``, PASS_ROWS at a time."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        c = np.stack([v.to_numpy(zero_copy_only=False) for v in batch.columns[1:]], axis=1)
        for lo in range(0, n, PASS_ROWS):
            yield project(x[lo:lo + PASS_ROWS]), c[lo:lo + PASS_ROWS]


def _numbers(acc: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(acc), dtype=np.int32)), pa.array(acc)], names=["i", "v"])


def _added(parts: DataFrame, size: int) -> np.ndarray:
    """The tasks' numbers ``(i, v)`` added up per position."""
    out = np.zeros(size)
    for r in parts.groupBy("i").agg(F.sum("v").alias("v")).collect():
        out[r["i"]] = r["v"]
    return out


class SVRModel(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted linear predictor w.x + b over a feature vector (JSON weights)."""

    spec = Param(Params._dummy(), "spec", "JSON weights and intercept", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        import json
        s = json.loads(self.getOrDefault(self.spec))
        w, b = np.asarray(s["w"]), float(s["b"])

        @F.pandas_udf(T.DoubleType())
        def predict(v: pd.Series) -> pd.Series:
            return pd.Series(np.stack(v.to_numpy()) @ w + b)

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))


def fit_svr(data: DataFrame, features_col: str, label_col: str, c: float = 1.0, epsilon: float = 0.1,
            max_iter: int = 60, tol: float = 1e-4, kernel: RandomFourierFeatures | None = None) -> SVRModel:
    """M8: support vector regression in the primal,
    0.5 |w|^2 + C sum max(0, |y - w.x - b| - eps).

    The corner of the loss is rounded over a width that shrinks tenfold
    per stage (each stage starts at the last solution) until the rounding
    changes the objective by less than ``tol`` of it.  Each loss and
    gradient evaluation is one pass: tasks reduce their rows to d + 2
    numbers with numpy, and Spark adds those up per position.  With a
    ``kernel`` only its input is held; every pass makes the features anew."""
    import json
    project, _ = kernel.projection() if kernel else (None, 0)
    base = data.select(vector_to_array(F.col(kernel.getInputCol() if kernel else features_col)).alias("x"), F.col(label_col).cast("double").alias("y"))
    base = base.persist()
    try:
        first = base.first()
        d = 0 if not first else kernel.projection()[1] if kernel else len(first["x"])
        stat = base.agg(F.avg("y").alias("m"), F.stddev_pop("y").alias("s")).first()
        scale = float(stat["s"] or 1.0)

        def total(theta: np.ndarray, width: float) -> np.ndarray:
            w, b = theta[:d], theta[d]

            def part(batches):
                acc = np.zeros(d + 2)
                for x, y in _blocks(batches, project):
                    r = y - x @ w - b
                    e = np.maximum(np.abs(r) - epsilon, 0.0)
                    acc[0] += np.where(e < width, e * e / (2 * width), e - width / 2).sum()
                    g = -np.sign(r) * np.minimum(e / width, 1.0)
                    acc[1:d + 1] += g @ x
                    acc[d + 1] += g.sum()
                yield _numbers(acc)

            return _added(base.mapInArrow(part, "i int, v double"), d + 2)

        theta = np.zeros(d + 1)
        theta[d] = float(stat["m"] or 0.0)
        width, last = scale, None
        for _ in range(6):
            def fg(t, width=width):
                tot = total(t, width)
                return 0.5 * t[:d].dot(t[:d]) + c * tot[0], np.concatenate([t[:d] + c * tot[1:d + 1], [c * tot[d + 1]]])

            theta = _lbfgs(fg, theta, max_iter=max_iter)
            value = 0.5 * theta[:d].dot(theta[:d]) + c * total(theta, 1e-9 * scale)[0]
            if last is not None and abs(last - value) <= tol * max(abs(value), 1e-12):
                break
            last, width = value, width / 10
    finally:
        base.unpersist()
    return SVRModel(inputCol=features_col, outputCol="prediction",
                    spec=json.dumps({"w": theta[:d].tolist(), "b": float(theta[d])}))


# ---------------------------------------------------------------- M7 kernel SVM classes

def _descent(x: np.ndarray, max_iter: int, tol: float = 1e-6, m: int = 10):
    """Limited-memory BFGS with a bisecting search for the weak Wolfe conditions, which suits corners (Lewis & Overton, 2013), as a
    generator: it yields points, is sent their (value, gradient), and returns the last point."""
    f, g = yield x
    start, seen, steps, it = f, [math.inf], [], 0
    while it < max_iter and np.linalg.norm(g) > max(tol * f, 1e-8) and not (len(seen) > 1 and abs(f - max(seen)) <= tol * start):
        d, alphas = -g, []
        for s, y in reversed(steps):
            alphas.append(s.dot(d) / s.dot(y))
            d = d - alphas[-1] * y
        if steps:
            d = d * (steps[-1][0].dot(steps[-1][1]) / steps[-1][1].dot(steps[-1][1]))
        for (s, y), a in zip(steps, reversed(alphas)):
            d = d + s * (a - y.dot(d) / s.dot(y))
        slope, low, high, found = g.dot(d), 0.0, math.inf, False
        step = 1.0 if steps else 0.5 / np.linalg.norm(g)
        for _ in range(21):
            xn = x + step * d
            fn, gn = yield xn
            if fn > f + 1e-4 * step * slope:
                high = step
            elif gn.dot(d) < 0.9 * slope:
                low = step
            else:
                found = True
                break
            step = (low + high) / 2 if high < math.inf else 2 * low
        if not found:
            if not steps:
                break
            steps = []  # once more without the curvature so far
            continue
        steps = [*steps, (xn - x, gn - g)][-m:]
        x, f, g, it = xn, fn, gn, it + 1
        seen = [*seen, f][-20:]
    return x


class LinearClasses(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """The class of the largest w.x + b over a feature vector (JSON weights, one row per class)."""

    spec = Param(Params._dummy(), "spec", "JSON weights and intercepts", typeConverter=TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, spec=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, dataset):
        import json
        s = json.loads(self.getOrDefault(self.spec))
        w, b = np.asarray(s["w"]), np.asarray(s["b"])

        @F.pandas_udf(T.DoubleType())
        def predict(v: pd.Series) -> pd.Series:
            return pd.Series((np.stack(v.to_numpy()) @ w.T + b).argmax(axis=1).astype(float))

        return dataset.withColumn(self.getOutputCol(), predict(vector_to_array(F.col(self.getInputCol()))))


def fit_svc(data: DataFrame, label_col: str, kernel: RandomFourierFeatures, reg: float, max_iter: int = 200) -> LinearClasses:
    """M7: one machine per class against the others, mean hinge loss + 0.5 reg |w|^2 on the kernel's features.

    The objective is that of Spark's LinearSVC under OneVsRest, which hold every row's features twice; here only the different
    inputs of the kernel are held with their rows of each class, each pass makes the features anew, and all machines share the passes."""
    import json
    project, d = kernel.projection()
    rows = data.select(vector_to_array(F.col(kernel.getInputCol())).alias("x"), F.col(label_col).cast("double").alias("y"))
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("y").alias("c")).first()
    n, classes = int(size["n"]), int(size["c"] or 0) + 1
    # rows at one place have the same features: one point with its rows of each class
    points = rows.groupBy("x").agg(*[F.count_if(F.col("y") == k).cast("double").alias(f"c{k}") for k in range(classes)]).persist()
    m = points.count()
    cores = data.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(cores, m // PASS_ROWS), m // TASK_POINTS)
    base = points.repartition(tasks).persist()  # dealt evenly: making features is many times the work of reading the few bytes
    try:
        base.count()
        points.unpersist()

        def added(run, size: int) -> np.ndarray:
            def summed(batches):
                yield _numbers(run(batches))

            parts = base.mapInArrow(summed, "i int, v double")
            if tasks > 64:
                return _added(parts, size)
            out = np.zeros(size)
            for r in parts.collect():  # few tasks: added up here, without a shuffle
                out[r["i"]] += r["v"]
            return out

        def moments(center):
            def run(batches):
                acc = np.zeros(d)
                for x, c in _point_blocks(batches, project):
                    acc += c.sum(axis=1) @ (x if center is None else (x - center) ** 2)
                return acc

            return added(run, d)

        mean = moments(None) / max(n, 1)
        std = np.sqrt(moments(mean) / max(n - 1, 1))
        inverse = np.divide(1.0, std, out=np.zeros(d), where=std > 0)

        def losses(asked: dict) -> dict:
            """(value, gradient) of each class' machine at its point, by one pass."""
            order = list(asked)
            w = np.stack([asked[k][:d] * inverse for k in order], axis=1)
            b = np.array([asked[k][d] for k in order])

            def run(batches):
                acc = np.zeros((len(order), d + 2))
                for x, c in _point_blocks(batches, project):
                    own = c[:, order]
                    others = c.sum(axis=1)[:, None] - own
                    f = x @ w + b
                    pull = others * (f > -1.0) - own * (f < 1.0)
                    acc[:, 0] += (own * np.maximum(1.0 - f, 0.0) + others * np.maximum(1.0 + f, 0.0)).sum(axis=0)
                    acc[:, 1:d + 1] += pull.T @ x
                    acc[:, d + 1] += pull.sum(axis=0)
                return acc.ravel()

            tot = added(run, len(order) * (d + 2)).reshape(len(order), d + 2) / max(n, 1)
            out = {}
            for k, t in zip(order, tot):
                u = asked[k][:d] * inverse * inverse
                out[k] = (t[0] + 0.5 * reg * float(asked[k][:d].dot(u)), np.append(t[1:d + 1] * inverse + reg * u, t[d + 1]))
            return out

        runs = {k: _descent(np.zeros(d + 1), max_iter) for k in range(classes)}
        asked, done = {k: next(r) for k, r in runs.items()}, {}
        while asked:
            answers, then = losses(asked), {}
            for k, answer in answers.items():
                try:
                    then[k] = runs[k].send(answer)
                except StopIteration as end:
                    done[k] = end.value
            asked = then
    finally:
        base.unpersist()
    return LinearClasses(inputCol="features", outputCol="prediction",
                         spec=json.dumps({"w": [(done[k][:d] * inverse).tolist() for k in range(classes)], "b": [float(done[k][d]) for k in range(classes)]}))


# ---------------------------------------------------------------- M9 kNN

class KNNWriter(MLWriter):
    def __init__(self, instance):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path):  # noqa: N802
        DefaultParamsWriter.saveMetadata(self.instance, path, self.sparkSession)
        self.instance.points.write.parquet(f"{path}/points")


class KNNReader(MLReader):
    def load(self, path):
        meta = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        model = KNNModel()
        model._resetUid(meta["uid"])
        DefaultParamsReader.getAndSetParams(model, meta)
        model.points = self.sparkSession.read.parquet(f"{path}/points")
        return model


class KNNModel(Transformer, HasInputCol, HasOutputCol, MLReadable, MLWritable):
    """k nearest neighbours: the model is its training points, saved with it as a table.

    Scoring joins rows to points, so it takes whole tables, not streams.
    """

    n_neighbors = Param(Params._dummy(), "n_neighbors", "neighbours per row", typeConverter=TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", typeConverter=TypeConverters.toString)
    classes = Param(Params._dummy(), "classes", "vote (true) or mean", typeConverter=TypeConverters.toBoolean)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, n_neighbors=None, weights=None, classes=None):
        super().__init__()
        self._set(**self._input_kwargs)
        self.points = None

    def write(self):
        return KNNWriter(self)

    @classmethod
    def read(cls):
        return KNNReader()

    def _transform(self, dataset):
        from kiln.operators.neighbours import knn_predict
        ensure_checkpoint_dir(dataset.sparkSession)
        # the id must name the same row in both joins: fixed by writing the rows once
        rows = dataset.withColumn("_qid", F.monotonically_increasing_id()).checkpoint(eager=True)
        pred = knn_predict(self.points, rows.select(F.col("_qid").alias("qid"), vector_to_array(self.getInputCol()).alias("x")),
                           self.getOrDefault(self.n_neighbors), self.getOrDefault(self.weights), self.getOrDefault(self.classes))
        pred = pred.select(F.col("qid").alias("_qid"), F.col("prediction").alias(self.getOutputCol()))
        return rows.join(pred, "_qid", "left").drop("_qid")


def fit_knn(data: DataFrame, n_neighbors: int, weights: str, classification: bool) -> KNNModel:
    """M9: keep the training points, numbered in the order of their values (ties between equal distances go to the smaller number)."""
    from kiln.functions.frames import with_global_index
    pts = data.select(vector_to_array("scaled").alias("x"), "label")
    model = KNNModel(inputCol="scaled", outputCol="prediction", n_neighbors=n_neighbors, weights=weights, classes=classification)
    model.points = with_global_index(pts, ["x", "label"], "tid").select(F.col("tid").cast("long").alias("tid"), "x", "label")
    return model

"""Workloads for dimensionality reduction, clustering, feature
elimination, model training/tuning/scoring and their metrics."""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from kiln.operators import cluster, models, reduce
from kiln.plans.catalog import register, rounded, table
from kiln.session import ensure_checkpoint_dir

NUM4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LI_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


def _emb_cols(spark, sf, dims: int = 64):
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(dims)])


@register("pca_feature")
def pca_feature(spark, sf):
    li = table(spark, sf, "lineitem").select(*NUM4, "l_returnflag")
    out, m = reduce.pca_feature(li, 2, "l_returnflag")
    return out


@register("pca_explore")
def pca_explore(spark, sf):
    out, m = reduce.pca_explore(_emb_cols(spark, sf), [f"e{i}" for i in range(64)], 3)
    return out


@register("pca_explained_variance")
def pca_explained_variance(spark, sf):
    _, m = reduce.pca_explore(_emb_cols(spark, sf), [f"e{i}" for i in range(64)], 5)
    return spark.createDataFrame(list(m["explained_variance"].items()), "component string, ratio double")


@register("cluster_kmeans")
def cluster_kmeans(spark, sf):
    return cluster.kmeans(_emb_cols(spark, sf), [f"e{i}" for i in range(64)], 10).select("vec_id", "label", "cluster")


@register("cluster_hierarchical")
def cluster_hierarchical(spark, sf):
    li = table(spark, sf, "lineitem").select(*LI_KEY[:4], "l_quantity", "l_discount")
    return cluster.hierarchical(li, ["l_quantity", "l_discount"], 3)


@register("cluster_dbscan", """WITH p AS (SELECT s_suppkey, s_suppkey / 50.0 AS x, s_nationkey::DOUBLE AS y FROM supplier),
c AS (SELECT a.s_suppkey AS k, a.x, a.y FROM p a JOIN p b ON (a.x - b.x) ** 2 + (a.y - b.y) ** 2 <= 1.44 GROUP BY ALL HAVING count(*) >= 4)
SELECT s_suppkey, EXISTS (SELECT 1 FROM c WHERE (c.x - p.x) ** 2 + (c.y - p.y) ** 2 <= 1.44) AS clustered FROM p""")
def cluster_dbscan(spark, sf):
    sup = table(spark, sf, "supplier").select("s_suppkey", (F.col("s_suppkey") / 50.0).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return cluster.dbscan(sup, ["x", "y"], 1.2, 4).select("s_suppkey", (F.col("cluster") >= 0).alias("clustered"))


@register("cluster_dbscan_labels")
def cluster_dbscan_labels(spark, sf):
    return cluster.dbscan(table(spark, sf, "customer").select("c_custkey", "c_nationkey", (F.col("c_acctbal") / 100).alias("bal")),
                          ["c_nationkey", "bal"], 1.0, 5).select("c_custkey", "cluster")


@register("cluster_summary")
def cluster_summary(spark, sf):
    return cluster.cluster_summary(cluster.dbscan(table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", (F.col("c_acctbal") / 100).alias("bal")), ["c_nationkey", "bal"], 1.0, 5))


@register("feature_rfe")
def feature_rfe(spark, sf):
    li = table(spark, sf, "lineitem").select(*NUM4, "l_returnflag")
    _, m = models.rfe(li, "l_returnflag", 2)
    return spark.createDataFrame(sorted(m["ranking"].items()), "feature string, ranking int")


@register("train_test_split", """WITH h AS (SELECT o_orderkey FROM orders
  ORDER BY md5(concat_ws('|', CAST(o_orderkey AS VARCHAR), '42')) LIMIT CAST(ceil(0.2 * (SELECT count(*) FROM orders)) AS BIGINT))
SELECT o_orderkey FROM h""")
def train_test_split(spark, sf):
    _, test = models.train_test_split(table(spark, sf, "orders"), ["o_orderkey"], 0.2)
    return test.select("o_orderkey")


# the rows that the split trains on, in SQL
TRAIN_SQL = """h AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST({key} AS VARCHAR), '42'))) AS pos,
                          count(*) OVER () AS n FROM {table}),
train AS (SELECT * FROM h WHERE pos > ceil(0.2 * n))"""


@register("linreg_one_feature", f"""WITH {TRAIN_SQL.format(key='o_orderkey', table='orders')},
fit AS (SELECT regr_slope(o_totalprice, o_custkey) AS slope, regr_intercept(o_totalprice, o_custkey) AS intercept FROM train)
SELECT o_orderkey, round(intercept + slope * o_custkey, 2) AS prediction FROM orders, fit""")
def linreg_one_feature(spark, sf):
    """Train on the training part, then score all rows, the target left out."""
    orders = table(spark, sf, "orders")
    tr = models.train(orders, "o_totalprice", ["o_custkey"], "Linear Regression", "regression", ["o_orderkey"])
    return models.score(tr.model, orders.drop("o_totalprice")).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("metrics_classification", """WITH t AS (SELECT l_returnflag y,
    CASE WHEN l_linestatus = 'O' THEN 'N' WHEN l_discount > 0.05 THEN 'R' ELSE 'A' END p FROM lineitem),
k AS (SELECT y AS k FROM t UNION SELECT p FROM t),
per AS (SELECT k.k, (SELECT count(*) FROM t WHERE y = k.k AND p = k.k) tp, (SELECT count(*) FROM t WHERE y = k.k) sup,
               (SELECT count(*) FROM t WHERE p = k.k) np FROM k)
SELECT round(sum(tp) / sum(sup), 6) AS accuracy,
       round(sum(CASE WHEN sup + np > 0 THEN 2.0 * tp / (sup + np) ELSE 0 END * sup) / sum(sup), 6) AS f1_weighted,
       sum(sup) AS n FROM per""")
def metrics_classification(spark, sf):
    li = table(spark, sf, "lineitem")
    t = li.select(F.col("l_returnflag").alias("label"),
                  F.when(F.col("l_linestatus") == "O", "N").when(F.col("l_discount") > 0.05, "R").otherwise("A")
                  .alias("prediction"))
    return rounded(models.metrics_frame_classification(t).withColumn("n", F.col("n").cast("bigint")))


@register("metrics_regression", """SELECT round(sqrt(avg((l_extendedprice - (l_quantity * 950.0 + 25.0)) ^ 2)), 6) AS rmse,
       round(1 - sum((l_extendedprice - (l_quantity * 950.0 + 25.0)) ^ 2) / (count(*) * var_pop(l_extendedprice)), 6) AS r2,
       count(*) AS n FROM lineitem""")
def metrics_regression(spark, sf):
    li = table(spark, sf, "lineitem")
    t = li.select(F.col("l_extendedprice").alias("label"), (F.col("l_quantity") * 950.0 + 25.0).alias("prediction"))
    return rounded(models.metrics_frame_regression(t))


def _li_model_frame(spark, sf):
    li = table(spark, sf, "lineitem")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    return li.join(part, li.l_partkey == part.p_partkey, "left").drop("p_partkey")


def _metrics_df(spark, tr):
    items = sorted((k, float(v)) for k, v in tr.metrics.items())
    return spark.createDataFrame(items, "metric string, value double")


def _cls(spark, sf, model, grid=False, params=None):
    df = _li_model_frame(spark, sf)
    tr = models.train(df, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linestatus", "p_size"],
                      model, "classification", LI_KEY, use_grid_search=grid, params=params)
    return _metrics_df(spark, tr)


def _reg(spark, sf, model, grid=False, params=None):
    df = _li_model_frame(spark, sf)
    tr = models.train(df, "l_extendedprice", ["l_quantity", "p_retailprice", "l_discount", "l_returnflag"],
                      model, "regression", LI_KEY, use_grid_search=grid, params=params)
    return _metrics_df(spark, tr)


register("train_logistic")(lambda spark, sf: _cls(spark, sf, "Logistic Regression"))
# default settings of the reference's models (no depth limit, 100 stages)
_RF = {"n_estimators": 100, "max_depth": None, "min_samples_split": 2}
_GB = {"n_estimators": 100, "learning_rate": 0.1, "max_depth": 3}
register("train_random_forest_cls")(lambda spark, sf: _cls(spark, sf, "Random Forest", params=_RF))
register("train_gradient_boosting_cls")(lambda spark, sf: _cls(spark, sf, "Gradient Boosting", params=_GB))
register("train_svm_linear")(lambda spark, sf: _cls(spark, sf, "SVM", params={"kernel": "linear"}))
register("train_svm_rbf")(lambda spark, sf: _cls(spark, sf, "SVM", params={"kernel": "rbf"}))
register("train_linear")(lambda spark, sf: _reg(spark, sf, "Linear Regression"))
register("train_ridge")(lambda spark, sf: _reg(spark, sf, "Ridge Regression"))
register("train_lasso")(lambda spark, sf: _reg(spark, sf, "Lasso Regression"))
register("train_random_forest_reg")(lambda spark, sf: _reg(spark, sf, "Random Forest", params=_RF))
register("train_gradient_boosting_reg")(lambda spark, sf: _reg(spark, sf, "Gradient Boosting", params=_GB))
register("train_svr")(lambda spark, sf: _reg(spark, sf, "SVM"))
register("train_knn_cls")(lambda spark, sf: _cls(spark, sf, "K-Nearest Neighbors"))
register("train_knn_reg")(lambda spark, sf: _reg(spark, sf, "K-Nearest Neighbors", params={"weights": "distance"}))
register("grid_search_logistic")(lambda spark, sf: _cls(spark, sf, "Logistic Regression", grid=True))
register("grid_search_ridge")(lambda spark, sf: _reg(spark, sf, "Ridge Regression", grid=True))


@register("forest_invariants", """SELECT ceil(0.2 * count(*))::BIGINT AS test_rows, 100 AS trees, true AS known_classes, true AS above_guessing,
true AS leaves_are_shares FROM lineitem""")
def forest_invariants(spark, sf):
    """The default forest: every test row gets a class, every leaf holds class shares, and accuracy is that of guessing or better."""
    tr = models.train(_li_model_frame(spark, sf), "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linestatus", "p_size"],
                      "Random Forest", "classification", LI_KEY, params=_RF)
    nodes = next(s for s in tr.model.stages if hasattr(s, "nodes")).nodes

    def shares(pdfs):
        for pdf in pdfs:
            for r in pdf.itertuples(index=False):
                v, f = np.frombuffer(r.value, float).reshape(-1, 3), np.frombuffer(r.feature, np.int32)
                yield pd.DataFrame({"tree": [r.tree], "ok": [bool(r.part < 0 or np.allclose(v[f < 0].sum(axis=1), 1))]})

    trees = nodes.mapInPandas(shares, "tree int, ok boolean").agg(F.count_distinct("tree").cast("int").alias("trees"), F.min("ok").alias("leaves_are_shares"))
    seen = tr.predictions.agg(F.count(F.lit(1)).alias("test_rows"), F.min(F.col("predicted_class").isin("A", "N", "R")).alias("known_classes"))
    return seen.crossJoin(trees).withColumn("above_guessing", F.lit(bool(tr.metrics["accuracy"] > 0.3)))  # one row each


@register("boosting_stump", """WITH v AS (SELECT l_quantity AS q, count(*) AS n, sum(l_extendedprice) AS s FROM lineitem GROUP BY l_quantity),
c AS (SELECT q, sum(n) OVER (ORDER BY q) AS nl, sum(s) OVER (ORDER BY q) AS sl, sum(n) OVER () AS n, sum(s) OVER () AS s FROM v),
g AS (SELECT q, nl, n - nl AS nr, nl * (n - nl) / n * (sl / nl - (s - sl) / (n - nl)) ^ 2 AS gain FROM c WHERE nl < n),
b AS (SELECT q FROM g ORDER BY gain DESC, q LIMIT 1)
SELECT l_quantity <= (SELECT q FROM b) AS low_side, count(*) AS n, max(l_quantity)::DOUBLE AS top, round(avg(l_extendedprice), 4) AS prediction
FROM lineitem GROUP BY ALL""")
def boosting_stump(spark, sf):
    """One stage of depth 1 at rate 1: the means on both sides of the cut that lowers the squared error most."""
    from kiln.operators.boosting import fit_boosting
    data = table(spark, sf, "lineitem").select(array_to_vector(F.array(F.col("l_quantity").cast("double"))).alias("scaled"),
                                               F.col("l_extendedprice").cast("double").alias("label"), models.row_hash(LI_KEY), "l_quantity")
    out = fit_boosting(data, 0, stages=1, learning_rate=1.0, max_depth=1).transform(data)
    sides = out.groupBy(F.round("prediction", 4).alias("prediction")).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("l_quantity").cast("double")).alias("top"))
    low = sides.agg(F.min("top").alias("least"))
    return sides.crossJoin(low).select((F.col("top") == F.col("least")).alias("low_side"), "n", "top", "prediction")  # two rows and one


def _saved(spark, tr):
    path = f"{ensure_checkpoint_dir(spark)}/kiln-models/{uuid.uuid4().hex}"
    models.save_model(tr, path)
    return models.load_model(path)


@register("score_saved_model")
def score_saved_model(spark, sf):
    """A text-class model, saved, loaded, and applied to rows that have no target."""
    df = _li_model_frame(spark, sf)
    tr = models.train(df, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linestatus", "p_size"],
                      "Logistic Regression", "classification", LI_KEY)
    return models.score(_saved(spark, tr), df.drop("l_returnflag")).select(*LI_KEY, "predicted_class")


@register("score_saved_ridge", f"""WITH {TRAIN_SQL.format(key='o_orderkey', table='orders')},
m AS (SELECT avg(o_custkey) AS mx, avg(o_totalprice) AS my, stddev_samp(o_custkey) AS sx, covar_pop(o_totalprice, o_custkey) AS cxy,
             var_pop(o_custkey) AS vx, count(*) AS c FROM train),
w AS (SELECT my, mx, (c * cxy / sx) / (c * vx / (sx * sx) + 1.0) / sx AS slope FROM m)
SELECT o_orderkey, round(my + slope * (o_custkey - mx), 2) AS prediction FROM orders, w""")
def score_saved_ridge(spark, sf):
    """A ridge model, saved, loaded, and applied to rows that have no target; checked by its closed form."""
    orders = table(spark, sf, "orders")
    tr = models.train(orders, "o_totalprice", ["o_custkey"], "Ridge Regression", "regression", ["o_orderkey"], params={"alpha": 1.0})
    return models.score(_saved(spark, tr), orders.drop("o_totalprice")).select("o_orderkey", F.round("prediction", 2).alias("prediction"))


@register("score_saved_knn", """WITH h AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', CAST(s_suppkey AS VARCHAR), '42'))) AS pos,
  count(*) OVER () AS n FROM supplier),
train AS (SELECT * FROM h WHERE pos > ceil(0.2 * n)),
st AS (SELECT avg(s_suppkey) m1, stddev_samp(s_suppkey) s1, avg(s_nationkey) m2, stddev_samp(s_nationkey) s2 FROM train),
p AS (SELECT (s_suppkey - m1) / s1 AS a, (s_nationkey - m2) / s2 AS b, s_acctbal AS y, s_suppkey AS k FROM train, st),
q AS (SELECT (s_suppkey - m1) / s1 AS a, (s_nationkey - m2) / s2 AS b, s_suppkey AS qk FROM supplier, st),
d AS (SELECT qk, y, row_number() OVER (PARTITION BY qk ORDER BY round((p.a - q.a) ** 2 + (p.b - q.b) ** 2, 12), p.a, p.b) AS r FROM p, q)
SELECT qk AS s_suppkey, round(avg(y), 4) AS prediction FROM d WHERE r <= 5 GROUP BY qk""")
def score_saved_knn(spark, sf):
    """A nearest-neighbour model over two columns, saved, loaded, and applied to rows that have no target."""
    sup = table(spark, sf, "supplier")
    tr = models.train(sup, "s_acctbal", ["s_suppkey", "s_nationkey"], "K-Nearest Neighbors", "regression", ["s_suppkey"])
    return models.score(_saved(spark, tr), sup.drop("s_acctbal")).select("s_suppkey", F.round("prediction", 4).alias("prediction"))


@register("prepare_features", """WITH c AS (SELECT count(DISTINCT p_brand) AS b, count(DISTINCT p_type) AS t, count(DISTINCT p_name) AS n FROM part),
f AS (SELECT 'p_size' AS feature UNION ALL SELECT 'p_retailprice'
  UNION ALL SELECT 'p_brand_' || v FROM (SELECT DISTINCT p_brand AS v, row_number() OVER (ORDER BY p_brand) AS r FROM (SELECT DISTINCT p_brand FROM part)), c
            WHERE b <= 10 AND r > 1
  UNION ALL SELECT 'p_type_' || v FROM (SELECT p_type AS v, row_number() OVER (ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type FROM part)), c
            WHERE t <= 10 AND r > 1)
SELECT feature FROM f""")
def prepare_features(spark, sf):
    prep = models.prepare(table(spark, sf, "part"), ["p_size", "p_retailprice", "p_brand", "p_type", "p_name"])
    return spark.createDataFrame([(f,) for f in prep.features], "feature string")


@register("score_stream")
def score_stream(spark, sf):
    from kiln.streaming.score import read_stream, run_to_files, score_stream as scorer
    df = _li_model_frame(spark, sf)
    tr = models.train(df, "l_returnflag", ["l_quantity", "l_discount", "l_tax", "l_linestatus", "p_size"],
                      "Logistic Regression", "classification", LI_KEY)
    li = table(spark, sf, "lineitem")
    stream = read_stream(spark, sf, li.schema, glob="lineitem.parquet")
    part = table(spark, sf, "part").select("p_partkey", "p_retailprice", "p_size")
    # stream-static join: the dimension table is joined to every micro-batch
    enriched = stream.join(part, stream.l_partkey == part.p_partkey, "left").drop("p_partkey", "l_returnflag")
    scored = scorer(tr.model, enriched).select(*LI_KEY, "predicted_class")
    base = f"{ensure_checkpoint_dir(spark)}/kiln-stream/{uuid.uuid4().hex}"
    run_to_files(scored, f"{base}/out", f"{base}/ckpt")
    return spark.read.parquet(f"{base}/out")


# ------------------------------------------------------------------ hard operators

@register("dedup_fuzzy")
def dedup_fuzzy(spark, sf):
    from kiln.operators.dedup import deduplicate
    p = table(spark, sf, "part").select("p_partkey", "p_name")
    return deduplicate(p, "fuzzy", column="p_name", threshold=80, order_by=["p_partkey"])


@register("dedup_fuzzy_documents")
def dedup_fuzzy_documents(spark, sf):
    """Whole texts; a copy of similarity 96 or more to an earlier kept text goes."""
    from kiln.operators.dedup import deduplicate
    return deduplicate(table(spark, sf, "documents").select("doc_id", "text"), "fuzzy", column="text", threshold=95, order_by=["doc_id"]).select("doc_id")


@register("power_boxcox_lambda")
def power_boxcox_lambda(spark, sf):
    from kiln.operators.power import fit_lambda
    lam = fit_lambda(table(spark, sf, "lineitem"), "l_extendedprice", "boxcox", shift=1.0)
    return spark.createDataFrame([(float(lam),)], "lambda double")


@register("power_boxcox_given", "SELECT l_orderkey, l_linenumber, round((sqrt(l_extendedprice + 1) - 1) / 0.5, 6) AS t FROM lineitem")
def power_boxcox_given(spark, sf):
    from kiln.operators.power import power_transform
    li = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("t"))
    return rounded(power_transform(li, "t", "boxcox", lam=0.5)[0], 6)


@register("kmeans_invariants", "SELECT count(*) AS rows, 4 AS clusters, true AS at_nearest_mean FROM lineitem")
def kmeans_invariants(spark, sf):
    """Every row has a cluster, no cluster is empty, and all but a few rows are in the cluster of the nearest mean."""
    names = ["l_quantity", "l_discount"]
    out = cluster.kmeans(table(spark, sf, "lineitem").select(*names), names, 4)
    means = {r["cluster"]: [float(r[n]) for n in names] for r in out.groupBy("cluster").agg(*[F.avg(n).alias(n) for n in names]).collect()}  # 4 rows
    apart = [F.struct(sum(((F.col(n) - F.lit(v)) * (F.col(n) - F.lit(v)) for n, v in zip(names, m)), F.lit(0.0)).alias("d"), F.lit(k).alias("k")) for k, m in means.items()]
    right = (F.least(*apart)["k"] == F.col("cluster")).cast("double")
    return out.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("cluster").cast("int").alias("clusters"), (F.avg(right) > 0.95).alias("at_nearest_mean"))


@register("isolation_forest_invariants", "SELECT count(*) AS rows, true AS share_kept, true AS inliers_score_less FROM lineitem")
def isolation_forest_invariants(spark, sf):
    """Every row has a score, at most the asked share lies above the threshold, and planted far values score above the median one."""
    from kiln.operators.iforest import isolation_scores
    price = F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 20).otherwise(F.col("l_extendedprice")).cast("double")
    li = table(spark, sf, "lineitem").select(price.alias("v"), (F.col("l_orderkey") % 997 == 0).alias("far"))
    scored, threshold = isolation_scores(li, ["v"], 0.05)
    far = F.avg(F.when(F.col("far") & (F.col("v") > 200_000), F.col("anomaly_score")))
    return scored.agg(F.count("anomaly_score").alias("rows"), (F.avg((F.col("anomaly_score") > threshold).cast("double")) <= 0.05 + 1e-9).alias("share_kept"),
                      F.coalesce(far > F.avg("anomaly_score"), F.lit(True)).alias("inliers_score_less"))


@register("power_yeojohnson", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
  round(CASE WHEN l_tax - 0.04 >= 0 THEN (pow(l_tax - 0.04 + 1, 0.5) - 1) / 0.5
             ELSE -(pow(1 - (l_tax - 0.04), 1.5) - 1) / 1.5 END, 9) AS t FROM lineitem""")
def power_yeojohnson(spark, sf):
    from kiln.operators.power import power_transform
    li = table(spark, sf, "lineitem").withColumn("t", F.col("l_tax") - 0.04)
    out, _ = power_transform(li, "t", "yeojohnson", lam=0.5)
    return rounded(out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "t"), 9)


@register("power_yeojohnson_fit")
def power_yeojohnson_fit(spark, sf):
    from kiln.operators.power import power_transform
    li = table(spark, sf, "lineitem").withColumn("t", F.col("l_tax") - 0.04)
    out, lam = power_transform(li, "t", "yeojohnson")
    return out.select("l_orderkey", "l_linenumber", "t").withColumn("lambda", F.lit(lam))


@register("detect_isolation_forest")
def detect_isolation_forest(spark, sf):
    from kiln.operators.outliers import detect
    li = table(spark, sf, "lineitem").withColumn(
        "l_extendedprice", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 20)
        .otherwise(F.col("l_extendedprice")))
    return detect(li, "l_extendedprice", "isolation_forest", contamination=0.05)


@register("outlier_isolation_forest_null")
def outlier_isolation_forest_null(spark, sf):
    from kiln.operators.outliers import outlier
    li = table(spark, sf, "lineitem").select(*LI_KEY[:4], "l_extendedprice")
    return outlier(li, "l_extendedprice", "isolation_forest", "null", contamination=0.1)

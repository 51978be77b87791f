"""Workloads for sources, cleaning, imputation, outliers, scaling, binning,
encodings, text/type/date functions, deduplication and profiling."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from kiln.functions import text as tx
from kiln.functions.text import ENGLISH_STOP_WORDS
from kiln.operators import bins, clean, dedup, encode, outliers, profile, scale
from kiln.plans.catalog import KEY, KEY_SQL, LI, li_nulls, register, rounded, table
from kiln.session import ensure_checkpoint_dir
from kiln.sources import files

K4 = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
K4_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"

# ------------------------------------------------------------------ sources


@register("csv_roundtrip", "SELECT * FROM orders")
def csv_roundtrip(spark, sf):
    orders = table(spark, sf, "orders")
    path = f"{ensure_checkpoint_dir(spark)}/kiln-io/{uuid.uuid4().hex}"
    files.write_csv(orders, path)
    return files.read_csv(spark, path, schema=orders.schema)


@register("csv_inferred", """SELECT doc_id, '"a", ' || text AS text, CASE WHEN doc_id % 7 > 0 THEN n_chars END AS n_chars,
  CASE WHEN doc_id % 5 > 0 THEN doc_id / 4.0 END AS quarter, doc_id % 2 = 0 AS even FROM documents""")
def csv_inferred(spark, sf):
    """Doubled quotes, quoted line breaks and NA tokens in number columns, read without a schema."""
    d = table(spark, sf, "documents")
    path = f"{ensure_checkpoint_dir(spark)}/kiln-io/{uuid.uuid4().hex}"
    files.write_csv(d.select(
        "doc_id", F.concat(F.lit('"a", '), "text").alias("text"),
        F.when(F.col("doc_id") % 7 == 0, "NA").otherwise(F.col("n_chars").cast("string")).alias("n_chars"),
        F.when(F.col("doc_id") % 5 == 0, "null").otherwise((F.col("doc_id") / 4.0).cast("string")).alias("quarter"),
        (F.col("doc_id") % 2 == 0).alias("even")), path)
    return files.read_csv(spark, path)


@register("tidy_on_load", f"""
WITH {LI}, t AS (SELECT l_quantity, l_discount, l_tax,
                        CASE WHEN l_orderkey % 2 = 0 THEN NULL ELSE l_linenumber END AS "Unnamed: 0" FROM li)
SELECT l_quantity, l_discount, l_tax FROM t
WHERE NOT (l_quantity IS NULL AND l_discount IS NULL AND l_tax IS NULL AND "Unnamed: 0" IS NULL)""")
def tidy_on_load(spark, sf):
    li = li_nulls(spark, sf)
    t = li.select("l_quantity", "l_discount", "l_tax",
                  F.when(F.col("l_orderkey") % 2 != 0, F.col("l_linenumber")).alias("Unnamed: 0"))
    return clean.tidy_on_load(t)


@register("preview", f"SELECT * FROM lineitem ORDER BY {KEY_SQL} LIMIT 20")
def preview(spark, sf):
    return files.preview(table(spark, sf, "lineitem"), KEY, 20)


# ------------------------------------------------------------------ C1-C7

@register("delete_columns", "SELECT * EXCLUDE (l_shipdate, l_tax) FROM lineitem")
def delete_columns(spark, sf):
    return clean.delete_columns(table(spark, sf, "lineitem"), ["l_shipdate", "l_tax"])


@register("drop_na_all", f"""WITH {LI}
SELECT l_quantity, l_discount, l_tax FROM li
WHERE l_quantity IS NOT NULL OR l_discount IS NOT NULL OR l_tax IS NOT NULL""")
def drop_na_all(spark, sf):
    return clean.drop_na(li_nulls(spark, sf).select("l_quantity", "l_discount", "l_tax"), "all")


@register("drop_na_any", f"""WITH {LI}
SELECT * FROM li WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def drop_na_any(spark, sf):
    return clean.drop_na(li_nulls(spark, sf), "any")


@register("drop_na_thresh", f"""WITH {LI}
SELECT l_quantity, l_discount, l_tax FROM li
WHERE (CASE WHEN l_quantity IS NULL THEN 0 ELSE 1 END) + (CASE WHEN l_discount IS NULL THEN 0 ELSE 1 END)
    + (CASE WHEN l_tax IS NULL THEN 0 ELSE 1 END) >= 2""")
def drop_na_thresh(spark, sf):
    return clean.drop_na(li_nulls(spark, sf).select("l_quantity", "l_discount", "l_tax"), "thresh", 2)


@register("missing_drop", f"""WITH {LI}
SELECT * FROM li WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def missing_drop(spark, sf):
    return clean.impute_columns(li_nulls(spark, sf), ["l_discount", "l_tax"], "drop")


@register("select_numeric", """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax FROM lineitem""")
def select_numeric(spark, sf):
    return clean.select_numeric(table(spark, sf, "lineitem"))


@register("pairwise_valid", f"""WITH {LI}
SELECT {K4_SQL}, l_discount, l_tax FROM li WHERE l_discount IS NOT NULL AND l_tax IS NOT NULL""")
def pairwise_valid(spark, sf):
    return clean.pairwise_valid(li_nulls(spark, sf), "l_discount", "l_tax").select(*K4, "l_discount", "l_tax")


# ------------------------------------------------------------------ I1-I7

def _imp_sql(col: str, fill: str) -> str:
    return f"""WITH {LI}
SELECT {K4_SQL}, round(coalesce({col}, ({fill})), 6) AS {col} FROM li"""


def _imp(spark, sf, col, method):
    out = clean.impute(li_nulls(spark, sf), col, method)
    return rounded(out.select(*K4, col))


for _name, _col, _method, _fill in [
    ("impute_mean", "l_discount", "mean", "SELECT avg(l_discount) FROM li"),
    ("impute_median", "l_tax", "median", "SELECT quantile_cont(l_tax, 0.5) FROM li"),
    ("impute_mode", "l_quantity", "mode",
     "SELECT l_quantity FROM li WHERE l_quantity IS NOT NULL GROUP BY l_quantity "
     "ORDER BY count(*) DESC, l_quantity LIMIT 1"),
    ("impute_constant", "l_discount", "constant", "SELECT 0.0"),
    ("impute_knn_single", "l_tax", "knn", "SELECT avg(l_tax) FROM li"),
    ("impute_mice_single", "l_quantity", "mice", "SELECT avg(l_quantity) FROM li"),
]:
    register(_name, _imp_sql(_col, _fill))(
        lambda spark, sf, _c=_col, _m=_method: _imp(spark, sf, _c, _m))


@register("impute_flag", f"""WITH {LI}
SELECT {K4_SQL}, CASE WHEN l_tax IS NULL THEN 1 ELSE 0 END AS l_tax_missing,
       round(coalesce(l_tax, (SELECT quantile_cont(l_tax, 0.5) FROM li)), 6) AS l_tax FROM li""")
def impute_flag(spark, sf):
    out = clean.impute_columns(li_nulls(spark, sf), ["l_tax"], "flag")
    return rounded(out.select(*K4, "l_tax_missing", "l_tax"))


@register("impute_fused_median", f"""WITH {LI}, s AS (
  SELECT quantile_cont(l_quantity, 0.5) AS q, quantile_cont(l_discount, 0.5) AS d,
         quantile_cont(l_tax, 0.5) AS t FROM li)
SELECT {K4_SQL}, round(coalesce(l_quantity, q), 6) AS l_quantity,
       round(coalesce(l_discount, d), 6) AS l_discount, round(coalesce(l_tax, t), 6) AS l_tax
FROM li, s""")
def impute_fused_median(spark, sf):
    out = clean.impute_columns(li_nulls(spark, sf), ["l_quantity", "l_discount", "l_tax"], "median")
    return rounded(out.select(*K4, "l_quantity", "l_discount", "l_tax"))


# ------------------------------------------------------------------ outliers

def li_spiked(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.withColumn("l_extendedprice", F.when(F.col("l_orderkey") % 997 == 0, F.col("l_extendedprice") * 20)
                         .otherwise(F.col("l_extendedprice")))


SPIKED = """sp AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
         CASE WHEN l_orderkey % 997 = 0 THEN l_extendedprice * 20 ELSE l_extendedprice END AS l_extendedprice,
         l_discount, l_tax, l_returnflag, l_linestatus
  FROM lineitem)"""


@register("outlier_zscore_remove", f"""WITH {SPIKED}, s AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) sd FROM sp)
SELECT {K4_SQL}, l_extendedprice FROM sp, s WHERE abs((l_extendedprice - m) / sd) < 3""")
def outlier_zscore_remove(spark, sf):
    return outliers.outlier(li_spiked(spark, sf), "l_extendedprice", "zscore", "remove", 3).select(*K4, "l_extendedprice")


@register("outlier_zscore_cap", f"""WITH {SPIKED}, s AS (SELECT avg(l_extendedprice) m, stddev_samp(l_extendedprice) sd FROM sp)
SELECT {K4_SQL}, round(least(greatest(l_extendedprice, m - 3 * sd), m + 3 * sd), 6) AS l_extendedprice FROM sp, s""")
def outlier_zscore_cap(spark, sf):
    out = outliers.outlier(li_spiked(spark, sf), "l_extendedprice", "zscore", "cap", 3)
    return rounded(out.select(*K4, "l_extendedprice"))


IQR_STATS = """s AS (SELECT quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.75) q3 FROM sp),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s)"""


@register("outlier_iqr_remove", f"""WITH {SPIKED}, {IQR_STATS}
SELECT {K4_SQL}, l_extendedprice FROM sp, f WHERE l_extendedprice >= lo AND l_extendedprice <= hi""")
def outlier_iqr_remove(spark, sf):
    return outliers.outlier(li_spiked(spark, sf), "l_extendedprice", "iqr", "remove", factor=1.5).select(*K4, "l_extendedprice")


@register("outlier_iqr_cap", f"""WITH {SPIKED}, {IQR_STATS}
SELECT {K4_SQL}, round(least(greatest(l_extendedprice, lo), hi), 6) AS l_extendedprice FROM sp, f""")
def outlier_iqr_cap(spark, sf):
    out = outliers.outlier(li_spiked(spark, sf), "l_extendedprice", "iqr", "cap", factor=1.5)
    return rounded(out.select(*K4, "l_extendedprice"))


@register("outliers_clip_pct", f"""WITH {SPIKED}, s AS (
  SELECT quantile_cont(l_extendedprice, 0.05) a1, quantile_cont(l_extendedprice, 0.95) b1,
         quantile_cont(l_quantity, 0.05) a2, quantile_cont(l_quantity, 0.95) b2 FROM sp)
SELECT {K4_SQL}, round(least(greatest(l_extendedprice, a1), b1), 6) AS l_extendedprice,
       round(least(greatest(l_quantity, a2), b2), 6) AS l_quantity FROM sp, s""")
def outliers_clip_pct(spark, sf):
    out = outliers.outliers(li_spiked(spark, sf), ["l_extendedprice", "l_quantity"], "clip")
    return rounded(out.select(*K4, "l_extendedprice", "l_quantity"))


@register("outliers_remove_pct", f"""WITH {SPIKED},
s1 AS (SELECT quantile_cont(l_extendedprice, 0.05) a, quantile_cont(l_extendedprice, 0.95) b FROM sp),
r1 AS (SELECT sp.* FROM sp, s1 WHERE l_extendedprice >= a AND l_extendedprice <= b),
s2 AS (SELECT quantile_cont(l_quantity, 0.05) a, quantile_cont(l_quantity, 0.95) b FROM r1)
SELECT {K4_SQL}, l_extendedprice, l_quantity FROM r1, s2 WHERE l_quantity >= a AND l_quantity <= b""")
def outliers_remove_pct(spark, sf):
    out = outliers.outliers(li_spiked(spark, sf), ["l_extendedprice", "l_quantity"], "remove")
    return out.select(*K4, "l_extendedprice", "l_quantity")


@register("outliers_transform", f"""SELECT {K4_SQL}, round(ln(1 + l_extendedprice), 6) AS l_extendedprice FROM lineitem""")
def outliers_transform(spark, sf):
    out = outliers.outliers(table(spark, sf, "lineitem"), ["l_extendedprice"], "transform")
    return rounded(out.select(*K4, "l_extendedprice"))


@register("detect_zscore", f"""WITH {SPIKED}, s AS (SELECT avg(l_extendedprice) m, stddev_pop(l_extendedprice) sd FROM sp)
SELECT l_extendedprice FROM sp, s WHERE abs((l_extendedprice - m) / sd) > 3""")
def detect_zscore(spark, sf):
    return outliers.detect(li_spiked(spark, sf), "l_extendedprice", "zscore", threshold=3)


@register("detect_iqr", f"""WITH {SPIKED}, {IQR_STATS}
SELECT l_extendedprice FROM sp, f WHERE l_extendedprice < lo OR l_extendedprice > hi""")
def detect_iqr(spark, sf):
    return outliers.detect(li_spiked(spark, sf), "l_extendedprice", "iqr")


@register("detect_dbscan", f"""WITH {SPIKED},
d AS (SELECT l_extendedprice, count(*) OVER (ORDER BY l_extendedprice
        RANGE BETWEEN 5.0 PRECEDING AND 5.0 FOLLOWING) AS deg FROM sp),
c AS (SELECT l_extendedprice, deg >= 5 AS core FROM d),
n AS (SELECT l_extendedprice, core, max(CASE WHEN core THEN 1 ELSE 0 END) OVER (ORDER BY l_extendedprice
        RANGE BETWEEN 5.0 PRECEDING AND 5.0 FOLLOWING) AS near FROM c)
SELECT l_extendedprice FROM n WHERE NOT core AND near = 0""")
def detect_dbscan(spark, sf):
    return outliers.detect(li_spiked(spark, sf), "l_extendedprice", "dbscan", eps=5.0, min_samples=5)


@register("detect_summary", f"""WITH {SPIKED}, {IQR_STATS},
o AS (SELECT count(*) AS k FROM sp, f WHERE l_extendedprice < lo OR l_extendedprice > hi),
n AS (SELECT count(l_extendedprice) AS n FROM sp)
SELECT CAST(k AS BIGINT) AS count, round(k / n * 100.0, 6) AS percentage FROM o, n""")
def detect_summary(spark, sf):
    sp = li_spiked(spark, sf)
    found = outliers.detect(sp, "l_extendedprice", "iqr")
    return rounded(outliers.detection_summary(found, sp, "l_extendedprice"))


# ------------------------------------------------------------------ scaling

@register("scale_log1p", f"""SELECT {K4_SQL}, round(ln(1 + l_discount), 6) AS l_discount FROM lineitem""")
def scale_log1p(spark, sf):
    out = scale.transform(table(spark, sf, "lineitem"), ["l_discount"], "log")
    return rounded(out.select(*K4, "l_discount"))


@register("scale_sqrt", f"""SELECT {K4_SQL}, round(CASE WHEN l_tax - 0.04 < 0 THEN NULL ELSE sqrt(l_tax - 0.04) END, 6) AS t
FROM lineitem""")
def scale_sqrt(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("t", F.col("l_tax") - 0.04)
    return rounded(scale.transform(li, ["t"], "sqrt").select(*K4, "t"))


def _scaled_sql(expr_q: str, expr_d: str, stats: str) -> str:
    return f"""WITH {LI}, s AS ({stats})
SELECT {K4_SQL}, round({expr_q}, 6) AS l_quantity, round({expr_d}, 6) AS l_discount FROM li, s"""


def _scaled(spark, sf, method, rng=(0, 1)):
    out = scale.scale(li_nulls(spark, sf), ["l_quantity", "l_discount"], method, rng)
    return rounded(out.select(*K4, "l_quantity", "l_discount"))


register("scale_standard", _scaled_sql(
    "(l_quantity - mq) / sq", "(l_discount - md) / sd",
    "SELECT avg(l_quantity) mq, stddev_pop(l_quantity) sq, avg(l_discount) md, stddev_pop(l_discount) sd FROM li"))(
    lambda spark, sf: _scaled(spark, sf, "standard"))
register("scale_minmax", _scaled_sql(
    "(l_quantity - aq) / (bq - aq) * 2 - 1", "(l_discount - ad) / (bd - ad) * 2 - 1",
    "SELECT min(l_quantity) aq, max(l_quantity) bq, min(l_discount) ad, max(l_discount) bd FROM li"))(
    lambda spark, sf: _scaled(spark, sf, "minmax", (-1, 1)))
register("scale_robust", _scaled_sql(
    "(l_quantity - q2) / (q3 - q1)", "(l_discount - d2) / (d3 - d1)",
    "SELECT quantile_cont(l_quantity, 0.25) q1, quantile_cont(l_quantity, 0.5) q2, quantile_cont(l_quantity, 0.75) q3, "
    "quantile_cont(l_discount, 0.25) d1, quantile_cont(l_discount, 0.5) d2, quantile_cont(l_discount, 0.75) d3 FROM li"))(
    lambda spark, sf: _scaled(spark, sf, "robust"))


def _eda_sql(expr: str, stats: str) -> str:
    return f"""WITH {LI}, s AS ({stats})
SELECT l_discount AS original, round({expr}, 6) AS transformed FROM li, s WHERE l_discount IS NOT NULL"""


def _eda(spark, sf, method):
    return rounded(scale.eda_transform(li_nulls(spark, sf), "l_discount", method))


register("eda_standardize", _eda_sql("(l_discount - m) / sd",
                                     "SELECT avg(l_discount) m, stddev_samp(l_discount) sd FROM li"))(
    lambda spark, sf: _eda(spark, sf, "standardize"))
register("eda_normalize", _eda_sql("(l_discount - a) / (b - a)",
                                   "SELECT min(l_discount) a, max(l_discount) b FROM li"))(
    lambda spark, sf: _eda(spark, sf, "normalize"))
register("eda_log", _eda_sql("ln(1 + l_discount)", "SELECT 1"))(lambda spark, sf: _eda(spark, sf, "log"))
register("eda_sqrt", _eda_sql("sqrt(l_discount)", "SELECT 1"))(lambda spark, sf: _eda(spark, sf, "sqrt"))


@register("interaction_polynomial", f"""SELECT {K4_SQL}, round(l_quantity * l_extendedprice, 6) AS qp,
       round(pow(l_discount, 3), 6) AS d3 FROM lineitem""")
def interaction_polynomial(spark, sf):
    li = table(spark, sf, "lineitem")
    li = scale.polynomial(scale.interaction(li, "l_quantity", "l_extendedprice", "qp"), "l_discount", 3, "d3")
    return rounded(li.select(*K4, "qp", "d3"))


# ------------------------------------------------------------------ binning

def _edge_case(col: str, edges: list[str], lowest_closed: bool) -> str:
    parts = " ".join(f"WHEN {col} <= {e} THEN {i}" for i, e in enumerate(edges[1:]))
    low = f"{col} >= {edges[0]}" if lowest_closed else f"{col} > {edges[0]}"
    return f"CASE WHEN {col} IS NOT NULL AND {low} AND {col} <= {edges[-1]} THEN CASE {parts} END END"


@register("bin_equal_width", f"""WITH {LI}, s AS (SELECT min(l_quantity) a, max(l_quantity) b FROM li),
e AS (SELECT a - (b - a) * 0.001 + 0 * a AS e0, 1 * ((b - a) / 5) + a AS e1, 2 * ((b - a) / 5) + a AS e2,
             3 * ((b - a) / 5) + a AS e3, 4 * ((b - a) / 5) + a AS e4, b AS e5 FROM s),
c AS (SELECT {K4_SQL}, {_edge_case('l_quantity', ['e0', 'e1', 'e2', 'e3', 'e4', 'e5'], False)} AS code, e.* FROM li, e)
SELECT {K4_SQL}, code AS l_quantity_binned,
       round([e0, e1, e2, e3, e4][code + 1], 6) AS l_quantity_binned_lower,
       round([e1, e2, e3, e4, e5][code + 1], 6) AS l_quantity_binned_upper FROM c""")
def bin_equal_width(spark, sf):
    out = bins.binning(li_nulls(spark, sf), "l_quantity", "equal_width", 5)
    return rounded(out.select(*K4, "l_quantity_binned", "l_quantity_binned_lower", "l_quantity_binned_upper"))


@register("bin_equal_freq", f"""WITH s AS (SELECT quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1]) q FROM lineitem),
e AS (SELECT q[1] e0, q[2] e1, q[3] e2, q[4] e3, q[5] e4 FROM s),
c AS (SELECT {K4_SQL}, {_edge_case('l_extendedprice', ['e0', 'e1', 'e2', 'e3', 'e4'], True)} AS code, e.* FROM lineitem, e)
SELECT {K4_SQL}, code AS l_extendedprice_binned,
       round([e0, e1, e2, e3][code + 1], 6) AS l_extendedprice_binned_lower,
       round([e1, e2, e3, e4][code + 1], 6) AS l_extendedprice_binned_upper,
       ['q1', 'q2', 'q3', 'q4'][code + 1] AS l_extendedprice_binned_label FROM c""")
def bin_equal_freq(spark, sf):
    out = bins.binning(table(spark, sf, "lineitem"), "l_extendedprice", "equal_freq", 4, labels=["q1", "q2", "q3", "q4"])
    return rounded(out.select(*K4, "l_extendedprice_binned", "l_extendedprice_binned_lower",
                              "l_extendedprice_binned_upper", "l_extendedprice_binned_label"))


@register("bin_custom", f"""WITH {LI}, c AS (SELECT {K4_SQL}, {_edge_case('l_discount', ['0.0', '0.02', '0.05', '0.1'], False)} AS code FROM li)
SELECT {K4_SQL}, code AS disc_bin, ['low', 'mid', 'high'][code + 1] AS disc_bin_label FROM c""")
def bin_custom(spark, sf):
    out = bins.binning(li_nulls(spark, sf), "l_discount", "custom", bin_edges=[0, 0.02, 0.05, 0.1],
                       labels=["low", "mid", "high"], new_feature="disc_bin")
    return out.select(*K4, "disc_bin", "disc_bin_label")


@register("eda_bin", f"""WITH {LI}, d AS (SELECT l_quantity FROM li WHERE l_quantity IS NOT NULL),
s AS (SELECT min(l_quantity) a, max(l_quantity) b FROM d),
e AS (SELECT a - (b - a) * 0.001 AS e0, 1 * ((b - a) / 5) + a AS e1, 2 * ((b - a) / 5) + a AS e2,
             3 * ((b - a) / 5) + a AS e3, 4 * ((b - a) / 5) + a AS e4, b AS e5 FROM s)
SELECT l_quantity AS original, {_edge_case('l_quantity', ['e0', 'e1', 'e2', 'e3', 'e4', 'e5'], False)} AS transformed FROM d, e""")
def eda_bin(spark, sf):
    return scale.eda_transform(li_nulls(spark, sf), "l_quantity", "bin", bins=5)


# ------------------------------------------------------------------ encodings

@register("onehot_drop_first", """SELECT o_orderkey,
  CASE WHEN o_orderpriority = '2-HIGH' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_2-HIGH",
  CASE WHEN o_orderpriority = '3-MEDIUM' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_3-MEDIUM",
  CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_4-NOT SPECIFIED",
  CASE WHEN o_orderpriority = '5-LOW' THEN 1.0 ELSE 0.0 END AS "o_orderpriority_5-LOW"
FROM orders""")
def onehot_drop_first(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.encode(o, ["o_orderpriority"], "onehot")


@register("eda_onehot", """SELECT o_orderstatus = 'F' AS "F", o_orderstatus = 'O' AS "O", o_orderstatus = 'P' AS "P"
FROM orders WHERE o_orderstatus IS NOT NULL""")
def eda_onehot(spark, sf):
    return encode.eda_onehot(table(spark, sf, "orders"), "o_orderstatus")


@register("get_dummies", """SELECT c_custkey,
  CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS c_mktsegment_BUILDING,
  CASE WHEN c_mktsegment = 'FURNITURE' THEN 1 ELSE 0 END AS c_mktsegment_FURNITURE,
  CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 1 ELSE 0 END AS c_mktsegment_HOUSEHOLD,
  CASE WHEN c_mktsegment = 'MACHINERY' THEN 1 ELSE 0 END AS c_mktsegment_MACHINERY
FROM customer""")
def get_dummies(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.get_dummies(c, "c_mktsegment", drop_first=True)


@register("label_encode", """SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS BIGINT) AS o_orderpriority
FROM orders""")
def label_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return encode.encode(o, ["o_orderpriority"], "label")


@register("binary_encode", """SELECT c_custkey, CAST(dense_rank() OVER (ORDER BY c_mktsegment) - 1 AS BIGINT) AS c_mktsegment
FROM customer""")
def binary_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return encode.encode(c, ["c_mktsegment"], "binary")


@register("target_encode", """SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_orderpriority), 6) AS o_orderpriority,
       o_totalprice FROM orders""")
def target_encode(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return rounded(encode.encode(o, ["o_orderpriority"], "target", target_col="o_totalprice"), only=["o_orderpriority"])


@register("frequency_encode", """SELECT c_custkey, round(count(*) OVER (PARTITION BY c_mktsegment) / (SELECT count(*) FROM customer), 6) AS c_mktsegment
FROM customer""")
def frequency_encode(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return rounded(encode.encode(c, ["c_mktsegment"], "frequency"))


@register("inverse_label", "SELECT o_orderkey, o_orderpriority AS priority FROM orders")
def inverse_label(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    dic = encode.code_dictionary(o, "o_orderpriority")
    coded = encode.label(o, "o_orderpriority")
    return encode.inverse_label(coded, "o_orderpriority", dic, "o_orderpriority", "priority").select("o_orderkey", "priority")


# ------------------------------------------------------------------ text, types, dates

@register("text_lowercase", "SELECT doc_id, lower(text) AS text FROM documents")
def text_lowercase(spark, sf):
    return tx.text_clean(table(spark, sf, "documents").select("doc_id", "text"), "text", "lowercase")


@register("text_remove_punct", r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{N}_\s]', '', 'g') AS text FROM documents")
def text_remove_punct(spark, sf):
    return tx.text_clean(table(spark, sf, "documents").select("doc_id", "text"), "text", "remove_punct")


_STOP_SQL = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


@register("text_remove_stopwords", rf"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\s+'),
         lambda w: w <> '' AND NOT list_contains([{_STOP_SQL}], w)), ' ') AS text FROM conversations""")
def text_remove_stopwords(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    return tx.text_clean(c, "text", "remove_stopwords")


@register("regex_extract", r"""SELECT event_id, CASE WHEN regexp_matches(props, '"k": (\d+)')
       THEN regexp_extract(props, '"k": (\d+)', 1) END AS k FROM events""")
def regex_extract(spark, sf):
    e = table(spark, sf, "events").select("event_id", "props")
    return tx.extract(e, "props", r'"k": (\d+)', "k").select("event_id", "k")


@register("to_numeric", f"""SELECT {K4_SQL},
  TRY_CAST(CASE WHEN l_orderkey % 5 = 0 THEN 'n/a' ELSE CAST(l_linenumber AS VARCHAR) END AS DOUBLE) AS n FROM lineitem""")
def to_numeric(spark, sf):
    li = table(spark, sf, "lineitem").withColumn(
        "n", F.when(F.col("l_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.col("l_linenumber").cast("string")))
    return tx.type_conversion(li, "n", "numeric").select(*K4, "n")


@register("to_datetime", """SELECT o_orderkey,
  TRY_CAST(CASE WHEN o_orderkey % 9 = 0 THEN 'not a date' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS TIMESTAMP) AS d
FROM orders""")
def to_datetime(spark, sf):
    o = table(spark, sf, "orders").withColumn(
        "d", F.when(F.col("o_orderkey") % 9 == 0, F.lit("not a date"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    out = tx.type_conversion(o, "d", "datetime")
    return out.select("o_orderkey", F.col("d").cast("timestamp_ntz").alias("d"))


@register("to_string_category", f"SELECT {K4_SQL}, CAST(l_linenumber AS VARCHAR) AS s, l_returnflag FROM lineitem")
def to_string_category(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("s", F.col("l_linenumber"))
    li = tx.type_conversion(tx.type_conversion(li, "s", "string"), "l_returnflag", "category")
    return li.select(*K4, "s", "l_returnflag")


@register("datetime_parts", """SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d,
       hour(o_orderdate) AS h, isodow(o_orderdate) - 1 AS wd, quarter(o_orderdate) AS q FROM orders""")
def datetime_parts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    for part, name in [("year", "y"), ("month", "m"), ("day", "d"), ("hour", "h"), ("weekday", "wd"), ("quarter", "q")]:
        o = tx.datetime_part(o, "o_orderdate", part, name)
    return o.select("o_orderkey", *[F.col(c).cast("long").alias(c) for c in ["y", "m", "d", "h", "wd", "q"]])


# ------------------------------------------------------------------ dedup

@register("dedup_exact_first", f"""SELECT s.l_orderkey AS l_orderkey, s.l_linenumber AS l_linenumber, s.l_partkey AS l_partkey,
       s.l_suppkey AS l_suppkey, s.l_extendedprice AS l_extendedprice, l_returnflag, l_linestatus, ln
FROM (SELECT min(struct_pack({KEY_SQL})) AS s, l_returnflag, l_linestatus, l_linenumber AS ln
      FROM lineitem GROUP BY l_returnflag, l_linestatus, l_linenumber)""")
def dedup_exact_first(spark, sf):
    li = table(spark, sf, "lineitem").select(*KEY, "l_returnflag", "l_linestatus")
    out = dedup.deduplicate(li.withColumn("ln", F.col("l_linenumber")), "exact",
                            columns=["l_returnflag", "l_linestatus", "ln"], order_by=KEY)
    return out


@register("dedup_documents", """SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text""")
def dedup_documents(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return dedup.deduplicate(d, "exact", columns=["text"], order_by=["doc_id"])


# ------------------------------------------------------------------ G1-G2, P1-P9

for _f in ("mean", "sum", "max", "min"):
    _sqlf = {"mean": "avg", "sum": "sum", "max": "max", "min": "min"}[_f]
    register(f"group_agg_{_f}", f"""WITH {LI}
SELECT l_returnflag, round({_sqlf}(l_discount), 6) AS value FROM li GROUP BY l_returnflag""")(
        lambda spark, sf, _f=_f: rounded(profile.group_agg(li_nulls(spark, sf), "l_returnflag", "l_discount", _f)))
    register(f"aggregation_feature_{_f}", f"""WITH {LI}
SELECT {K4_SQL}, round({_sqlf}(l_discount) OVER (PARTITION BY l_linestatus, l_returnflag), 6) AS g FROM li""")(
        lambda spark, sf, _f=_f: rounded(profile.aggregation_feature(
            li_nulls(spark, sf).withColumn("grp", F.concat("l_linestatus", "l_returnflag")),
            "grp", "l_discount", _f, "g").select(*K4, "g")))


@register("schema_info", """SELECT CAST(ordinal_position - 1 AS INTEGER) AS position, column_name AS "column",
       (SELECT count(*) FROM lineitem) AS n_rows, CAST((SELECT count(*) FROM information_schema.columns
        WHERE table_name = 'lineitem') AS INTEGER) AS n_cols
FROM information_schema.columns WHERE table_name = 'lineitem'""")
def schema_info(spark, sf):
    return profile.schema_info(table(spark, sf, "lineitem")).drop("dtype")


@register("null_counts", f"""WITH {LI}
SELECT 'l_quantity' AS "column", count(*) - count(l_quantity) AS null_count FROM li
UNION ALL SELECT 'l_discount', count(*) - count(l_discount) FROM li
UNION ALL SELECT 'l_tax', count(*) - count(l_tax) FROM li
UNION ALL SELECT 'l_returnflag', count(*) - count(l_returnflag) FROM li""")
def null_counts(spark, sf):
    return profile.null_counts(li_nulls(spark, sf).select("l_quantity", "l_discount", "l_tax", "l_returnflag"))


@register("column_stats", f"""WITH {LI}
SELECT 'l_quantity' AS "column", count(DISTINCT l_quantity) AS unique_count, count(*) - count(l_quantity) AS null_count FROM li
UNION ALL SELECT 'l_discount', count(DISTINCT l_discount), count(*) - count(l_discount) FROM li
UNION ALL SELECT 'l_returnflag', count(DISTINCT l_returnflag), count(*) - count(l_returnflag) FROM li""")
def column_stats(spark, sf):
    out = profile.column_stats(li_nulls(spark, sf).select("l_quantity", "l_discount", "l_returnflag"))
    return out.select("column", "unique_count", "null_count")


_DESC_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_DESC_SQL = "\nUNION ALL ".join(
    f"""SELECT '{c}' AS "column", CAST(count({c}) AS DOUBLE) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
       round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM li"""
    for c in _DESC_COLS)


@register("describe", f"WITH {LI}\n{_DESC_SQL}")
def describe(spark, sf):
    return rounded(profile.describe(li_nulls(spark, sf), _DESC_COLS))


@register("descriptive_stats", """WITH vc AS (SELECT l_extendedprice v, count(*) n FROM lineitem GROUP BY 1),
m AS (SELECT min(v) AS mode, count(*) AS n_modes FROM vc WHERE n = (SELECT max(n) FROM vc))
SELECT 'l_extendedprice' AS "column", round(avg(l_extendedprice), 6) AS mean, round(median(l_extendedprice), 6) AS median,
       any_value(m.mode) AS mode, any_value(m.n_modes) AS n_modes, round(stddev_samp(l_extendedprice), 6) AS std,
       min(l_extendedprice) AS min, max(l_extendedprice) AS max,
       round(quantile_cont(l_extendedprice, 0.25), 6) AS q1, round(quantile_cont(l_extendedprice, 0.75), 6) AS q3,
       round(skewness(l_extendedprice), 6) AS skewness, round(kurtosis(l_extendedprice), 6) AS kurtosis
FROM lineitem, m""")
def descriptive_stats(spark, sf):
    return rounded(profile.descriptive_stats(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("modes", """WITH vc AS (SELECT l_quantity, count(*) n FROM lineitem GROUP BY 1)
SELECT l_quantity FROM vc WHERE n = (SELECT max(n) FROM vc)""")
def modes(spark, sf):
    from kiln.functions.stats import modes as all_modes
    return all_modes(table(spark, sf, "lineitem"), "l_quantity")


@register("infer_problem_type", """SELECT 'c_mktsegment' AS target, count(DISTINCT c_mktsegment) AS distinct, count(*) AS rows,
       'classification' AS problem_type FROM customer
UNION ALL SELECT 'l_linenumber', count(DISTINCT l_linenumber), count(*),
       CASE WHEN count(DISTINCT l_linenumber) < 10 AND count(DISTINCT l_linenumber) < count(*) / 10
            THEN 'classification' ELSE 'regression' END FROM lineitem
UNION ALL SELECT 'l_extendedprice', count(DISTINCT l_extendedprice), count(*),
       CASE WHEN count(DISTINCT l_extendedprice) < 10 AND count(DISTINCT l_extendedprice) < count(*) / 10
            THEN 'classification' ELSE 'regression' END FROM lineitem""")
def infer_problem_type(spark, sf):
    li = table(spark, sf, "lineitem")
    return profile.union_all([
        profile.infer_problem_type(table(spark, sf, "customer")),
        profile.infer_problem_type(li.select("l_quantity", "l_linenumber")),
        profile.infer_problem_type(li.select("l_quantity", "l_extendedprice")),
    ])


@register("column_types", """SELECT column_name AS "column",
       CASE WHEN data_type = 'VARCHAR' THEN 'categorical' ELSE 'numerical' END AS kind
FROM information_schema.columns WHERE table_name = 'customer'""")
def column_types(spark, sf):
    return profile.column_types(table(spark, sf, "customer"))


@register("value_counts", """SELECT o_orderpriority, count(*) AS count, round(count(*) / (SELECT count(*) FROM orders), 6) AS share
FROM orders GROUP BY o_orderpriority""")
def value_counts(spark, sf):
    return rounded(profile.value_counts(table(spark, sf, "orders"), "o_orderpriority", normalize=True))


@register("crosstab", """SELECT l_returnflag, l_linestatus, count(*) AS count FROM lineitem GROUP BY 1, 2""")
def crosstab(spark, sf):
    return profile.crosstab(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus")


# ------------------------------------------------------------------ Q1

@register("flagship_pipeline", f"""WITH li AS (
  SELECT l_orderkey, l_quantity, l_extendedprice,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount FROM lineitem),
s AS (SELECT quantile_cont(l_discount, 0.5) md, quantile_cont(l_extendedprice, 0.25) q1,
             quantile_cont(l_extendedprice, 0.75) q3, min(l_quantity) a, max(l_quantity) b FROM li),
e AS (SELECT a - (b - a) * 0.001 AS e0, 1 * ((b - a) / 5) + a AS e1, 2 * ((b - a) / 5) + a AS e2,
             3 * ((b - a) / 5) + a AS e3, 4 * ((b - a) / 5) + a AS e4, b AS e5, md,
             q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi FROM s),
t AS (SELECT coalesce(l_discount, md) AS d, least(greatest(l_extendedprice, lo), hi) AS p,
             {_edge_case('l_quantity', ['e0', 'e1', 'e2', 'e3', 'e4', 'e5'], False)} AS bin FROM li, e)
SELECT bin AS l_quantity_binned, round(avg(p), 6) AS avg_price, round(avg(d), 6) AS avg_discount
FROM t WHERE bin IS NOT NULL GROUP BY bin""")
def flagship_pipeline(spark, sf):
    from kiln.plans.pipeline import run_pipeline
    li = table(spark, sf, "lineitem")
    li = li.withColumn("l_discount", F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount")))
    res = run_pipeline(li, [
        {"type": "impute", "params": {"column": "l_discount", "method": "median"}},
        {"type": "outlier", "params": {"column": "l_extendedprice", "method": "iqr", "action": "cap", "factor": 1.5}},
        {"type": "binning", "params": {"column": "l_quantity", "method": "equal_width", "bins": 5}},
    ])
    out = (res.df.where(F.col("l_quantity_binned").isNotNull()).groupBy("l_quantity_binned")
           .agg(F.avg("l_extendedprice").alias("avg_price"), F.avg("l_discount").alias("avg_discount")))
    return rounded(out)


# ------------------------------------------------------------------ streaming apply

@register("stream_impute_scale", f"""WITH {LI}, s AS (
  SELECT quantile_cont(l_discount, 0.5) AS md, avg(l_tax) AS mt, min(l_quantity) AS a, max(l_quantity) AS b FROM li)
SELECT {K4_SQL}, round(coalesce(l_discount, md), 6) AS l_discount, round(coalesce(l_tax, mt), 6) AS l_tax,
       round((l_quantity - a) / (b - a), 6) AS l_quantity FROM li, s""")
def stream_impute_scale(spark, sf):
    """Fit on the static table, apply the same steps to a file stream of it."""
    from kiln.streaming.score import apply_steps, fit_steps, read_stream, run_to_files
    steps = [clean.Impute("l_discount", "median"), clean.Impute("l_tax", "mean"),
             scale.Scale("l_quantity", "minmax")]
    stats = fit_steps(li_nulls(spark, sf), steps)
    li = table(spark, sf, "lineitem")
    raw = read_stream(spark, sf, li.schema, glob="lineitem.parquet")
    k = F.col("l_orderkey")
    nulls = raw.withColumns({"l_quantity": F.when(k % 13 != 0, F.col("l_quantity")),
                             "l_discount": F.when(k % 7 != 0, F.col("l_discount")),
                             "l_tax": F.when(k % 11 != 0, F.col("l_tax"))})
    out = apply_steps(nulls, steps, stats).select(*K4, "l_discount", "l_tax", "l_quantity")
    base = f"{ensure_checkpoint_dir(spark)}/kiln-stream/{uuid.uuid4().hex}"
    run_to_files(out, f"{base}/out", f"{base}/ckpt")
    return rounded(spark.read.parquet(f"{base}/out"))


@register("impute_mice_multi")
def impute_mice_multi(spark, sf):
    li = li_nulls(spark, sf).select(*K4, "l_quantity", "l_discount", "l_tax", "l_extendedprice")
    return clean.impute_iterative(li, ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], max_iter=10)


@register("xlsx_roundtrip", "SELECT * FROM orders")
def xlsx_roundtrip(spark, sf):
    from kiln.sources.xlsx import read_xlsx, write_xlsx
    orders = table(spark, sf, "orders")
    folder = f"{ensure_checkpoint_dir(spark)}/kiln-xlsx/{uuid.uuid4().hex}"
    write_xlsx(orders, folder)
    return read_xlsx(spark, folder, orders.schema)


@register("text_correct_spelling")
def text_correct_spelling(spark, sf):
    from kiln.operators.spell import correct_spelling
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    c = c.withColumn("_k", F.concat_ws(":", "conv_id", "turn"))
    return correct_spelling(c, "text", min_count=3, key="_k").drop("_k")


FEATURE_OPS = [
    {"type": "missing", "strategy": "flag", "columns": ["o_totalprice"]},
    {"type": "encoding", "method": "target", "columns": ["o_orderpriority"], "target": "o_totalprice"},
    {"type": "scaling", "method": "minmax", "columns": ["o_totalprice"], "range": [0, 1]},
    {"type": "feature_creation", "operation": "aggregation", "new_feature": "status_mean",
     "group_column": "o_orderstatus", "aggregation_column": "o_totalprice", "aggregation_function": "mean"},
    {"type": "feature_creation", "operation": "datetime", "new_feature": "wd", "column": "o_orderdate",
     "part": "weekday"},
    {"type": "binning", "method": "custom", "column": "o_totalprice", "bin_edges": [-0.01, 0.25, 0.5, 1.01],
     "labels": ["low", "mid", "high"]},
]


@register("feature_pipeline", f"""WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, o_orderdate,
                  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice END AS p FROM orders),
f AS (SELECT *, CASE WHEN p IS NULL THEN 1 ELSE 0 END AS miss, coalesce(p, (SELECT quantile_cont(p, 0.5) FROM o)) AS p1 FROM o),
t AS (SELECT *, avg(p1) OVER (PARTITION BY o_orderpriority) AS te FROM f),
mm AS (SELECT min(p1) a, max(p1) b FROM f),
s AS (SELECT t.*, (p1 - a) / (b - a) AS p2 FROM t, mm),
g AS (SELECT *, avg(p2) OVER (PARTITION BY o_orderstatus) AS sm FROM s)
SELECT o_orderkey, miss AS o_totalprice_missing, round(te, 6) AS o_orderpriority, round(p2, 6) AS o_totalprice,
       round(sm, 6) AS status_mean, CAST(isodow(o_orderdate) - 1 AS BIGINT) AS wd,
       {_edge_case('p2', ['-0.01', '0.25', '0.5', '1.01'], False)} AS o_totalprice_binned,
       ['low', 'mid', 'high'][{_edge_case('p2', ['-0.01', '0.25', '0.5', '1.01'], False)} + 1] AS o_totalprice_binned_label
FROM g""")
def feature_pipeline(spark, sf):
    from kiln.plans.pipeline import run_pipeline
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_orderstatus", "o_orderpriority", "o_orderdate",
        F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("o_totalprice"))
    res = run_pipeline(o, FEATURE_OPS)
    out = res.df.select("o_orderkey", "o_totalprice_missing", "o_orderpriority", "o_totalprice", "status_mean",
                        F.col("wd").cast("long").alias("wd"), "o_totalprice_binned", "o_totalprice_binned_label")
    return rounded(out, only=["o_orderpriority", "o_totalprice", "status_mean"])


CLEAN_OPS = [
    {"type": "delete_columns", "params": {"columns": ["user_id"]}},
    {"type": "regex_extract", "params": {"column": "props", "pattern": r'"k": (\d+)', "new_column": "k"}},
    {"type": "type_conversion", "params": {"column": "k", "type": "numeric"}},
    {"type": "outlier", "params": {"column": "value", "method": "zscore", "action": "remove", "threshold": 2}},
    {"type": "text_clean", "params": {"column": "event_type", "action": "lowercase"}},
    {"type": "deduplicate", "params": {"method": "exact", "columns": ["event_type", "k"]}},
]


@register("clean_pipeline", r"""WITH e AS (SELECT event_id, ts, event_type, value, props,
        TRY_CAST(CASE WHEN regexp_matches(props, '"k": (\d+)') THEN regexp_extract(props, '"k": (\d+)', 1) END AS DOUBLE) AS k
      FROM events),
s AS (SELECT avg(value) m, stddev_samp(value) sd FROM e),
r AS (SELECT e.event_id, e.ts, lower(e.event_type) AS event_type, e.value, e.props, e.k FROM e, s
      WHERE abs((value - m) / sd) < 2)
SELECT s.event_id AS event_id, s.ts AS ts, event_type, s.value AS value, s.props AS props, k
FROM (SELECT min(struct_pack(event_id, ts, value, props)) AS s, event_type, k FROM r GROUP BY event_type, k)""")
def clean_pipeline(spark, sf):
    from kiln.plans.pipeline import run_pipeline
    res = run_pipeline(table(spark, sf, "events"), CLEAN_OPS, order_by=["event_id"])
    return res.df


@register("impute_knn_multi")
def impute_knn_multi(spark, sf):
    li = li_nulls(spark, sf).select(*K4, "l_discount", "l_extendedprice", "l_quantity")
    return clean.impute_knn(li, "l_discount", ["l_extendedprice", "l_quantity"], 5,
                            key=K4 + ["l_extendedprice"])

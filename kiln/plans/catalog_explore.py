"""Workloads for correlation, feature selection, itemsets/rules and the
aggregated data behind each chart."""

from __future__ import annotations

from pyspark.sql import functions as F

from kiln.operators import charts, correlate, rules, select
from kiln.plans.catalog import LI, li_nulls, register, rounded, table

NUM4 = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr_sql(method: str, a: str, b: str, where: str = "") -> str:
    return f"""WITH {LI}
SELECT '{method}' AS method, round(corr({a}, {b}), 6) AS correlation, count(*) AS n
FROM li WHERE {a} IS NOT NULL AND {b} IS NOT NULL {where}"""


@register("corr_pearson", _corr_sql("pearson", "l_quantity", "l_extendedprice"))
def corr_pearson(spark, sf):
    return rounded(correlate.pearson(li_nulls(spark, sf), "l_quantity", "l_extendedprice").drop("p_value"))


@register("corr_spearman", f"""WITH {LI}, d AS (SELECT l_quantity a, l_discount b FROM li
                             WHERE l_quantity IS NOT NULL AND l_discount IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra,
             rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM d)
SELECT 'spearman' AS method, round(corr(ra, rb), 6) AS correlation, count(*) AS n FROM r""")
def corr_spearman(spark, sf):
    return rounded(correlate.spearman(li_nulls(spark, sf), "l_quantity", "l_discount").drop("p_value"))


@register("corr_pointbiserial", f"""WITH {LI}
SELECT 'pointbiserial' AS method,
       round(corr(CASE WHEN l_linestatus = (SELECT min(l_linestatus) FROM li WHERE l_quantity IS NOT NULL)
                       THEN 0.0 ELSE 1.0 END, l_quantity), 6) AS correlation, count(*) AS n
FROM li WHERE l_quantity IS NOT NULL AND l_linestatus IS NOT NULL""")
def corr_pointbiserial(spark, sf):
    return rounded(correlate.pointbiserial(li_nulls(spark, sf), "l_linestatus", "l_quantity").drop("p_value"))


def _chi2_general_sql(a: str, b: str, src: str) -> str:
    return f"""cells AS (SELECT {a} a, {b} b, count(*)::DOUBLE o FROM {src} GROUP BY 1, 2),
ra AS (SELECT a, sum(o) ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) cb FROM cells GROUP BY b),
tot AS (SELECT sum(o) n, count(DISTINCT a) r, count(DISTINCT b) k FROM cells),
chi AS (SELECT sum(o * o / (ra * cb / n)) - any_value(n) AS chi2 FROM cells JOIN ra USING (a) JOIN cb USING (b), tot)"""


@register("corr_cramersv", f"""WITH {_chi2_general_sql('l_returnflag', 'l_linestatus', 'lineitem')}
SELECT 'cramersv' AS method, round(sqrt(chi2 / n / least(r - 1, k - 1)), 6) AS correlation, CAST(n AS BIGINT) AS n
FROM chi, tot""")
def corr_cramersv(spark, sf):
    return rounded(correlate.cramersv(table(spark, sf, "lineitem"), "l_returnflag", "l_linestatus").drop("p_value"))


@register("corr_cramersv_yates", """WITH src AS (SELECT l_linestatus a, CASE WHEN l_tax > 0.04 THEN 'hi' ELSE 'lo' END b FROM lineitem),
cells AS (SELECT a, b, count(*)::DOUBLE o FROM src GROUP BY 1, 2),
ra AS (SELECT a, sum(o) ra FROM cells GROUP BY a), cb AS (SELECT b, sum(o) cb FROM cells GROUP BY b),
tot AS (SELECT sum(o) n FROM cells),
full_ AS (SELECT ra.a, cb.b, ra.ra, cb.cb, coalesce(cells.o, 0) o, ra.ra * cb.cb / tot.n e
          FROM ra CROSS JOIN cb CROSS JOIN tot LEFT JOIN cells ON cells.a = ra.a AND cells.b = cb.b),
adj AS (SELECT e, o + least(0.5, abs(e - o)) * sign(e - o) AS o2 FROM full_),
chi AS (SELECT sum((o2 - e) * (o2 - e) / e) chi2 FROM adj)
SELECT 'cramersv' AS method, round(sqrt(chi2 / n / 1), 6) AS correlation, CAST(n AS BIGINT) AS n FROM chi, tot""")
def corr_cramersv_yates(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_linestatus", F.when(F.col("l_tax") > 0.04, "hi").otherwise("lo").alias("taxband"))
    return rounded(correlate.cramersv(li, "l_linestatus", "taxband").drop("p_value"))


_CM = "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round({'corr(' + a + ', ' + b + ')' if a != b else 'CASE WHEN count(' + a + ') > 1 THEN 1.0 END'}, 6) AS r FROM li"
    for a in NUM4 for b in NUM4)


@register("corr_matrix", f"WITH {LI}\n{_CM}")
def corr_matrix(spark, sf):
    return rounded(correlate.corr_matrix(li_nulls(spark, sf), NUM4))


# ------------------------------------------------------------------ selection

_VT = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 9) AS variance, var_pop({c}) > 0.0007 AS selected FROM lineitem"
    for c in NUM4)


@register("variance_threshold", _VT)
def variance_threshold(spark, sf):
    li = table(spark, sf, "lineitem").select(*NUM4, "l_returnflag")
    _, m = select.variance_threshold(li, 0.0007)
    rows = [(c, round(v, 9), c in m["selected_features"]) for c, v in m["variances"].items()]
    return spark.createDataFrame(rows, "feature string, variance double, selected boolean")


_CF_COLS = {"c1": "l_extendedprice", "c2": "l_quantity", "c3": "l_extendedprice / l_quantity",
            "c4": "l_extendedprice * (1 - l_discount)", "c5": "l_tax"}
_CF_SQL = ", ".join(f"{e} AS {n}" for n, e in _CF_COLS.items())
_CF_DROP = "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, " + (
        "bool_or(false)" if j == 0 else "greatest(" + ", ".join(f"abs(corr(c{i + 1}, {c}))" for i in range(j)) + ") > 0.8")
    + " AS dropped FROM cf" for j, c in enumerate(_CF_COLS))


@register("correlation_filter", f"WITH cf AS (SELECT {_CF_SQL} FROM lineitem)\n{_CF_DROP}")
def correlation_filter(spark, sf):
    li = table(spark, sf, "lineitem").select(*[F.expr(e).alias(n) for n, e in _CF_COLS.items()])
    _, m = select.correlation_filter(li, 0.8)
    return spark.createDataFrame([(c, c in m["dropped_features"]) for c in _CF_COLS], "feature string, dropped boolean")


def _anova_sql(target: str) -> str:
    parts = []
    for c in NUM4:
        parts.append(f"""SELECT '{c}' AS feature,
  ((sum(s * s / nk) - sum(s) * sum(s) / sum(nk)) / (count(*) - 1)) /
  ((sum(q) - sum(s * s / nk)) / (sum(nk) - count(*))) AS score
FROM (SELECT {target}, count(*)::DOUBLE nk, sum({c}) s, sum({c} * {c}) q FROM lineitem GROUP BY {target})""")
    return "WITH sc AS (" + "\nUNION ALL ".join(parts) + """)
SELECT feature, round(score, 6) AS score, rank() OVER (ORDER BY score DESC) <= 2 AS selected FROM sc"""


def _kbest(spark, sf, target, score_func):
    li = table(spark, sf, "lineitem").select(*NUM4, target)
    _, m = select.select_k_best(li, target, 2, score_func)
    rows = [(c, round(s, 6), c in m["selected_features"]) for c, s in m["scores"].items()]
    return spark.createDataFrame(rows, "feature string, score double, selected boolean")


register("kbest_f_classif", _anova_sql("l_linenumber"))(lambda spark, sf: _kbest(spark, sf, "l_linenumber", "f_classif"))


def _chi2_sql(target: str) -> str:
    parts = []
    for c in NUM4:
        parts.append(f"""SELECT '{c}' AS feature, sum((s - nk / n * t) * (s - nk / n * t) / (nk / n * t)) AS score
FROM (SELECT {target}, count(*)::DOUBLE nk, sum({c}) s FROM lineitem GROUP BY {target}),
     (SELECT count(*)::DOUBLE n, sum({c}) t FROM lineitem)""")
    return "WITH sc AS (" + "\nUNION ALL ".join(parts) + """)
SELECT feature, round(score, 6) AS score, rank() OVER (ORDER BY score DESC) <= 2 AS selected FROM sc"""


register("kbest_chi2", _chi2_sql("l_returnflag"))(lambda spark, sf: _kbest(spark, sf, "l_returnflag", "chi2"))


# ------------------------------------------------------------------ itemsets, rules

ITEM_COLS = ["l_returnflag", "l_linestatus", "l_linenumber"]
_ITEMS_SQL = """base AS (SELECT 'l_returnflag_' || l_returnflag AS a, 'l_linestatus_' || l_linestatus AS b,
                     'l_linenumber_' || CAST(l_linenumber AS VARCHAR) AS c FROM lineitem),
cube_ AS (SELECT list_sort(list_filter([CASE WHEN GROUPING(a) = 0 THEN a END, CASE WHEN GROUPING(b) = 0 THEN b END,
                                        CASE WHEN GROUPING(c) = 0 THEN c END], lambda x: x IS NOT NULL)) AS items,
                 count(*) AS cnt FROM base GROUP BY CUBE (a, b, c)),
sets AS (SELECT items, array_to_string(items, ',') AS itemset, cnt / (SELECT count(*) FROM lineitem) AS support,
                len(items) AS length FROM cube_
         WHERE len(items) > 0 AND cnt / (SELECT count(*) FROM lineitem) >= 0.05)"""


@register("frequent_itemsets", f"WITH {_ITEMS_SQL}\nSELECT itemset, round(support, 6) AS support, length FROM sets")
def frequent_itemsets(spark, sf):
    fi = rules.frequent_itemsets(table(spark, sf, "lineitem"), ITEM_COLS, 0.05)
    return rounded(fi.select("itemset", "support", F.col("length").cast("bigint").alias("length")))


@register("association_rules", f"""WITH {_ITEMS_SQL},
splits AS (SELECT items, support, unnest(generate_series(1, (1 << length) - 2)) AS m FROM sets WHERE length >= 2),
parts AS (SELECT support,
                 array_to_string(list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 1), ',') AS ant,
                 array_to_string(list_filter(items, lambda x, i: ((m >> (i - 1)) & 1) = 0), ',') AS con FROM splits),
j AS (SELECT ant, con, sa.support sa, sc.support sc, p.support s, p.support / sa.support conf
      FROM parts p JOIN sets sa ON sa.itemset = p.ant JOIN sets sc ON sc.itemset = p.con)
SELECT ant AS antecedents, con AS consequents, round(sa, 6) AS antecedent_support, round(sc, 6) AS consequent_support,
       round(s, 6) AS support, round(conf, 6) AS confidence, round(conf / sc, 6) AS lift, round(s - sa * sc, 6) AS leverage,
       round(CASE WHEN conf < 1 THEN (1 - sc) / (1 - conf) END, 6) AS conviction,
       round(CASE WHEN greatest(s * (1 - sa), sa * (sc - s)) <> 0
                  THEN (s - sa * sc) / greatest(s * (1 - sa), sa * (sc - s)) END, 6) AS zhangs_metric
FROM j WHERE conf >= 0.5""")
def association_rules(spark, sf):
    fi = rules.frequent_itemsets(table(spark, sf, "lineitem"), ITEM_COLS, 0.05)
    return rounded(rules.association_rules(fi, 0.5))


# ------------------------------------------------------------------ charts

@register("chart_histogram", """WITH x AS (SELECT l_extendedprice x FROM lineitem),
s AS (SELECT count(*) n, min(x) a, max(x) b, quantile_cont(x, 0.25) q1, quantile_cont(x, 0.75) q3 FROM x),
w AS (SELECT *, least(2.0 * (q3 - q1) * pow(n, -1.0 / 3.0), (b - a) / (log2(n) + 1.0)) AS width FROM s),
p AS (SELECT a AS first, b AS last, CAST(ceil((b - a) / width) AS BIGINT) AS nb, (b - a) / ceil((b - a) / width) AS step FROM w),
g AS (SELECT x, p.*, least(floor((x - first) / (last - first) * nb), nb - 1) AS guess FROM x, p),
d AS (SELECT *, guess - CASE WHEN x < (CASE WHEN guess >= nb THEN last ELSE CAST(guess AS DOUBLE) * step + first END)
                             THEN 1 ELSE 0 END AS down FROM g),
u AS (SELECT *, down + CASE WHEN x >= (CASE WHEN down + 1 >= nb THEN last ELSE CAST(down + 1 AS DOUBLE) * step + first END)
                            AND down <> nb - 1 THEN 1 ELSE 0 END AS bin FROM d),
c AS (SELECT CAST(bin AS BIGINT) AS bin, count(*) AS cnt FROM u GROUP BY bin),
grid AS (SELECT CAST(range AS BIGINT) AS bin, p.* FROM p, range(p.nb))
SELECT grid.bin, round(CASE WHEN grid.bin >= nb THEN last ELSE CAST(grid.bin AS DOUBLE) * step + first END, 6) AS lower,
       round(CASE WHEN grid.bin + 1 >= nb THEN last ELSE CAST(grid.bin + 1 AS DOUBLE) * step + first END, 6) AS upper,
       CAST(coalesce(cnt, 0) AS BIGINT) AS count
FROM grid LEFT JOIN c ON c.bin = grid.bin""")
def chart_histogram(spark, sf):
    return rounded(charts.histogram(table(spark, sf, "lineitem"), "l_extendedprice"))


@register("chart_boxplot", """WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) q1, quantile_cont(l_extendedprice, 0.5) median,
                 quantile_cont(l_extendedprice, 0.75) q3 FROM lineitem GROUP BY l_returnflag),
j AS (SELECT l.l_returnflag, l.l_extendedprice y, q1, median, q3,
             l.l_extendedprice >= q1 - 1.5 * (q3 - q1) AND l.l_extendedprice <= q3 + 1.5 * (q3 - q1) AS inside
      FROM lineitem l JOIN q USING (l_returnflag))
SELECT l_returnflag, round(q1, 6) q1, round(median, 6) median, round(q3, 6) q3,
       min(CASE WHEN inside THEN y END) AS whisker_low, max(CASE WHEN inside THEN y END) AS whisker_high,
       count(*) FILTER (WHERE NOT inside) AS n_outliers, count(*) AS n
FROM j GROUP BY l_returnflag, q1, median, q3""")
def chart_boxplot(spark, sf):
    return rounded(charts.boxplot(table(spark, sf, "lineitem"), "l_extendedprice", "l_returnflag"))


@register("chart_scatter", "SELECT l_quantity, l_extendedprice, l_returnflag FROM lineitem")
def chart_scatter(spark, sf):
    return charts.scatter(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag")


@register("chart_bar", """SELECT l_returnflag, round(avg(l_extendedprice), 6) AS mean, count(*) AS n,
       round(avg(l_extendedprice) - 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS ci_low,
       round(avg(l_extendedprice) + 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS ci_high
FROM lineitem GROUP BY l_returnflag""")
def chart_bar(spark, sf):
    return rounded(charts.bar(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice"))


@register("chart_bar_hue", """SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean, count(*) AS n,
       round(avg(l_quantity) - 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci_low,
       round(avg(l_quantity) + 1.959963984540054 * stddev_samp(l_quantity) / sqrt(count(*)), 6) AS ci_high
FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def chart_bar_hue(spark, sf):
    return rounded(charts.bar(table(spark, sf, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus"))


@register("chart_line", """SELECT l_quantity, round(avg(l_extendedprice), 6) AS mean, count(*) AS n,
       round(avg(l_extendedprice) - 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS ci_low,
       round(avg(l_extendedprice) + 1.959963984540054 * stddev_samp(l_extendedprice) / sqrt(count(*)), 6) AS ci_high
FROM lineitem GROUP BY l_quantity""")
def chart_line(spark, sf):
    return rounded(charts.line(table(spark, sf, "lineitem"), "l_quantity", "l_extendedprice"))


@register("chart_kde", """WITH s AS (SELECT count(*) n, stddev_samp(o_totalprice) sd, min(o_totalprice) a, max(o_totalprice) b FROM orders),
p AS (SELECT n, sd * pow(n, -1.0 / 5.0) AS bw, a, b FROM s),
e AS (SELECT n, bw, a - 3.0 * bw AS lo, b + 3.0 * bw AS hi FROM p),
g AS (SELECT CAST(range AS INTEGER) AS i, CASE WHEN range = 199 THEN hi ELSE lo + range * ((hi - lo) / 199) END AS gx, n, bw
      FROM e, range(200)),
vc AS (SELECT o_totalprice x, count(*)::DOUBLE w FROM orders GROUP BY 1)
SELECT i, round(gx, 6) AS x,
       round(sum(w * exp(-0.5 * pow((gx - x) / bw, 2))) * (1.0 / (n * bw * sqrt(2 * pi()))), 12) AS density
FROM g, vc GROUP BY i, gx, n, bw""")
def chart_kde(spark, sf):
    out = charts.kde(table(spark, sf, "orders"), "o_totalprice")
    return out.select("i", F.round("x", 6).alias("x"), F.round("density", 12).alias("density"))


@register("chart_pie", """SELECT o_orderpriority, count(*) AS value, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 6) AS percent
FROM orders GROUP BY o_orderpriority""")
def chart_pie(spark, sf):
    return rounded(charts.pie(table(spark, sf, "orders"), "o_orderpriority"))


_STOP_SQL = None


def _stop_sql():
    from kiln.functions.text import ENGLISH_STOP_WORDS
    return ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


@register("chart_words", f"""WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '\\w[\\w'']+')) AS word FROM documents)
SELECT word, count(*) AS count FROM w
WHERE NOT list_contains([{_stop_sql()}], word) AND NOT regexp_matches(word, '^[0-9]+$')
GROUP BY word ORDER BY count DESC, word LIMIT 200""")
def chart_words(spark, sf):
    return charts.word_frequencies(table(spark, sf, "documents"), "text", 200)




ACF_SQL = """WITH b AS (SELECT value AS x, row_number() OVER (ORDER BY ts, event_id) AS p FROM events),
s AS (SELECT avg(x) AS m, count(*) AS n, least(CAST(floor(10 * log10(count(*))) AS BIGINT), count(*) // 2) AS k FROM b),
lags AS (SELECT unnest(range(0, k + 1)) AS lag FROM s),
c AS (SELECT lag, sum((b1.x - m) * (b2.x - m)) AS c FROM lags, s, b b1 JOIN b b2 ON b2.p = b1.p + lag GROUP BY lag),
a AS (SELECT lag, c / (SELECT c FROM c WHERE lag = 0) AS acf FROM c),
v AS (SELECT lag, acf, CASE WHEN lag = 0 THEN 0.0 ELSE (1 + 2 * coalesce(sum(CASE WHEN lag > 0 THEN acf * acf END)
        OVER (ORDER BY lag ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / (SELECT n FROM s) END AS var FROM a)
SELECT CAST(lag AS INTEGER) AS lag, round(acf, 6) AS acf, round(acf - 1.959963984540054 * sqrt(var), 6) AS ci_low,
       round(acf + 1.959963984540054 * sqrt(var), 6) AS ci_high FROM v"""


@register("chart_acf", ACF_SQL)
def chart_acf(spark, sf):
    return rounded(charts.acf(table(spark, sf, "events"), "value", ["ts", "event_id"]))


@register("chart_pacf")
def chart_pacf(spark, sf):
    return charts.pacf(table(spark, sf, "events"), "value", ["ts", "event_id"])


def _seasonal_sql() -> str:
    w = ["0.5"] + ["1.0"] * 11 + ["0.5"]
    terms = []
    for i, wt in enumerate(w):
        off = i - 6
        v = "x" if off == 0 else (f"lag(x, {-off}) OVER o" if off < 0 else f"lead(x, {off}) OVER o")
        terms.append(f"({v}) * ({wt} / 12)")
    trend = " + ".join(terms)
    return f"""WITH b AS (SELECT value x, row_number() OVER (ORDER BY ts, event_id) - 1 AS position FROM events),
t AS (SELECT position, x, {trend} AS trend FROM b WINDOW o AS (ORDER BY position)),
ph AS (SELECT position % 12 AS phase, avg(x - trend) AS m FROM t GROUP BY 1),
c AS (SELECT phase, m - (SELECT avg(m) FROM ph) AS seasonal FROM ph)
SELECT position, round(x, 6) AS observed, round(trend, 6) AS trend, round(seasonal, 6) AS seasonal,
       round(x - trend - seasonal, 6) AS resid
FROM t JOIN c ON c.phase = t.position % 12"""


@register("chart_seasonal", _seasonal_sql())
def chart_seasonal(spark, sf):
    out = charts.seasonal_decompose(table(spark, sf, "events"), "value", ["ts", "event_id"], 12)
    return rounded(out.select("position", "observed", "trend", "seasonal", "resid"))


@register("chart_qq")
def chart_qq(spark, sf):
    fit, pts = charts.qq(table(spark, sf, "lineitem"), "l_extendedprice",
                         ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"])
    return fit


@register("chart_violin", """SELECT l_returnflag, quantile_cont(l_quantity, 0.25) AS q1, median(l_quantity) AS median,
       quantile_cont(l_quantity, 0.75) AS q3 FROM lineitem GROUP BY l_returnflag""")
def chart_violin(spark, sf):
    return charts.violin(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")["box"].select("l_returnflag", "q1", "median", "q3")


@register("chart_kde_hue", """WITH d AS (SELECT CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS h, o_totalprice AS x FROM orders),
s AS (SELECT h, count(*) n, stddev_samp(x) sd, min(x) a, max(x) b FROM d WHERE h IS NOT NULL GROUP BY h),
t AS (SELECT sum(n) AS total FROM s),
p AS (SELECT h, n, sd * pow(n, -0.2) AS bw, a, b FROM s),
e AS (SELECT h, n, bw, a - 3.0 * bw AS lo, b + 3.0 * bw AS hi FROM p),
g AS (SELECT h, CAST(range AS INTEGER) AS i, CASE WHEN range = 199 THEN hi ELSE lo + range * ((hi - lo) / 199) END AS gx, n, bw FROM e, range(200)),
vc AS (SELECT h, x, count(*)::DOUBLE w FROM d WHERE h IS NOT NULL GROUP BY h, x)
SELECT g.h AS o_orderstatus, i, round(gx, 4) AS x,
       round(sum(w * exp(-0.5 * pow((gx - x) / bw, 2))) * (1.0 / (n * bw * sqrt(2 * pi())) * (n / any_value(total))), 12) AS density
FROM g JOIN vc ON g.h = vc.h, t GROUP BY g.h, i, gx, n, bw""")
def chart_kde_hue(spark, sf):
    o = table(spark, sf, "orders").withColumn("o_orderstatus", F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderstatus")))
    out = charts.kde(o, "o_totalprice", hue="o_orderstatus")
    return out.select("o_orderstatus", "i", F.round("x", 4).alias("x"), F.round("density", 12).alias("density"))


@register("chart_violin_density")
def chart_violin_density(spark, sf):
    return charts.violin(table(spark, sf, "lineitem"), "l_quantity", "l_returnflag")["density"]


@register("chart_pairplot")
def chart_pairplot(spark, sf):
    pp = charts.pairplot(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])
    h = [df.withColumn("column", F.lit(c)) for c, df in pp["hist"].items()]
    return h[0].unionByName(h[1])


@register("chart_pairplot_points", "SELECT l_quantity, l_discount FROM lineitem")
def chart_pairplot_points(spark, sf):
    return charts.pairplot(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"])["scatter"][("l_quantity", "l_discount")]


@register("chart_bar_bootstrap")
def chart_bar_bootstrap(spark, sf):
    return charts.bar_bootstrap(table(spark, sf, "lineitem"), "l_returnflag", "l_extendedprice",
                                ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"])


@register("kbest_mutual_info")
def kbest_mutual_info(spark, sf):
    return _kbest(spark, sf, "l_returnflag", "mutual_info")

"""Frequent itemsets and association rules.

Items are ``{column}_{value}``; a missing value makes no item.  A row
holds at most one item per column, so the support of *every* itemset over
a few columns is one ``cube`` aggregation (partially aggregated map-side:
the shuffle carries one row per distinct combination per task).  Wide
inputs switch to Spark ML's distributed FP-growth, which returns the same
itemsets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import lookup

CUBE_MAX_COLUMNS = 8


def _item(c: str) -> F.Column:
    return F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}_"), F.col(c).cast("string")))


def frequent_itemsets(df: DataFrame, columns: list[str], min_support: float = 0.1) -> DataFrame:
    """(items array sorted, itemset string, support, length).  The
    result (bounded by the number of frequent itemsets) is checkpointed,
    since rules read it several times."""
    from kiln.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    if len(columns) <= CUBE_MAX_COLUMNS:
        items = df.select(*[_item(c).alias(c) for c in columns])
        g = items.cube(*columns).agg(F.count(F.lit(1)).alias("_cnt"), F.grouping_id().alias("_gid"))
        g = g.checkpoint(eager=True)  # small; read three times below
        full = (1 << len(columns)) - 1
        total = g.where(F.col("_gid") == F.lit(full)).select("_cnt").collect()
        n = total[0][0] if total else 0
        if n == 0:
            raise ValueError("empty input")
        # a grouped column that is NULL is a missing value, not "all": drop
        keep = F.col("_gid") != F.lit(full)
        for i, c in enumerate(columns):
            bit = 1 << (len(columns) - 1 - i)
            keep = keep & ~((F.col("_gid").bitwiseAND(F.lit(bit)) == 0) & F.col(c).isNull())
        sets = g.where(keep).select(
            F.array_sort(F.array_compact(F.array(*[F.col(c) for c in columns]))).alias("items"), "_cnt")
    else:
        from pyspark.ml.fpm import FPGrowth
        n = df.count()
        if n == 0:
            raise ValueError("empty input")
        baskets = df.select(F.array_compact(F.array(*[_item(c) for c in columns])).alias("items"))
        # a support slightly below: count / n decides at the threshold, as for few columns
        model = FPGrowth(itemsCol="items", minSupport=min_support * (1 - 1e-9), minConfidence=1.0).fit(baskets)
        sets = model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("_cnt"))
    support = F.col("_cnt") / F.lit(float(n))
    return (sets.where(support >= F.lit(min_support))
            .select("items", F.array_join("items", ",").alias("itemset"), support.alias("support"),
                    F.size("items").alias("length"))).checkpoint(eager=True)


def association_rules(itemsets: DataFrame, min_threshold: float = 0.5) -> DataFrame:
    """R2: every split of every frequent itemset into antecedent ->
    consequent (multi-item consequents included), with support,
    confidence, lift, leverage, conviction and Zhang's metric; confidence
    >= ``min_threshold``.  Sub-itemset supports are looked up by key."""
    if itemsets.limit(1).count() == 0:
        raise ValueError("No frequent itemsets found with given support")
    sets = itemsets.where(F.col("length") >= 2)
    masks = sets.select("items", "support",
                        F.explode(F.expr("sequence(1, shiftleft(1, length) - 2)")).alias("_m"))

    # bit i of the mask puts item i in the antecedent
    splits = masks.select(F.col("support").alias("support"),
                          F.expr("filter(items, (x, i) -> ((_m >> i) & 1) = 1)").alias("antecedents"),
                          F.expr("filter(items, (x, i) -> ((_m >> i) & 1) = 0)").alias("consequents"))
    # items may hold any character: sets are matched as arrays, and joined to text only for display
    sup = itemsets.select("items", "support")
    out = lookup(splits, sup.select(F.col("items").alias("antecedents"), F.col("support").alias("antecedent_support")),
                 ["antecedents"], "inner")
    out = lookup(out, sup.select(F.col("items").alias("consequents"), F.col("support").alias("consequent_support")),
                 ["consequents"], "inner")
    s, sa, sc = F.col("support"), F.col("antecedent_support"), F.col("consequent_support")
    conf = s / sa
    lev = s - sa * sc
    zhang_den = F.greatest(s * (1 - sa), sa * (sc - s))
    return (out.select(
        F.array_join("antecedents", ",").alias("antecedents"), F.array_join("consequents", ",").alias("consequents"),
        sa, sc, s, conf.alias("confidence"), (conf / sc).alias("lift"), lev.alias("leverage"),
        F.when(conf < 1, (1 - sc) / (1 - conf)).alias("conviction"),
        F.when(zhang_den != 0, lev / zhang_den).alias("zhangs_metric"))
        .where(F.col("confidence") >= F.lit(min_threshold)))

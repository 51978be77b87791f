"""Aggregations and profiling.

Every profile is one pass over all requested columns; results are small
DataFrames (one row per column or per group), never collected rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.frames import lookup
from kiln.functions.nulls import NUMERIC_TYPES, numeric_columns
from kiln.functions.quantile import quantiles
from kiln.functions.stats import modes, sample_kurt, sample_skew

_AGG = {"mean": F.avg, "sum": F.sum, "max": F.max, "min": F.min}


def group_agg(df: DataFrame, group_col: str, agg_col: str, func: str, name: str = "value") -> DataFrame:
    """G1: one value per group (NULL keys form no group, as pandas)."""
    g = df.where(F.col(group_col).isNotNull()).groupBy(group_col)
    expr = _AGG[func](agg_col)
    if func == "sum":
        expr = F.coalesce(expr, F.lit(0))  # pandas: sum of an all-missing group is 0
    return g.agg(expr.alias(name))


def aggregation_feature(df: DataFrame, group_col: str, agg_col: str, func: str, new_feature: str) -> DataFrame:
    """The group statistic mapped back onto every row; missing key -> missing.

    A ``groupBy`` (partial aggregation map-side) plus a checked lookup
    join, rather than ``agg() OVER (PARTITION BY g)``: a window sends a hot
    group to one task, the lookup does not."""
    stats = group_agg(df, group_col, agg_col, func, "_gv")
    out = lookup(df, stats, [group_col], "left")
    return out.withColumn(new_feature, F.col("_gv")).drop("_gv")


def schema_info(df: DataFrame) -> DataFrame:
    """Shape, column names and types: one row per column."""
    spark = df.sparkSession
    n = df.count()
    rows = [(i, f.name, f.dataType.simpleString(), n, len(df.columns)) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "position int, column string, dtype string, n_rows long, n_cols int")


def null_counts(df: DataFrame) -> DataFrame:
    """Missing count per column, one pass, unpivoted."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(df.columns)])
    stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(df.columns))
    return wide.selectExpr(f"stack({len(df.columns)}, {stack}) as (`column`, null_count)")


def _as_text(c: F.Column, kind: T.DataType) -> F.Column:
    """A value as text, equal texts for equal values only (both zeros are one)."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return (c + F.lit(0.0).cast(kind)).cast("string")
    if isinstance(kind, T.BinaryType):
        return F.hex(c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        return F.when(c.isNotNull(), F.to_json(F.struct(c)))
    return c.cast("string")


def column_stats(df: DataFrame, sample_size: int = 5) -> DataFrame:
    """Dtype, distinct non-missing count, missing count, sample values.

    Missing counts and samples come from one pass; the distinct values of
    all columns are counted exactly in another, as (column, value) rows
    that tasks reduce to their distinct ones before the one shuffle.
    Samples are deterministic and bounded: the value with the
    smallest hash under each of ``sample_size`` seeds (``min_by`` keeps one
    value per seed), de-duplicated."""
    aggs = []
    for i, c in enumerate(df.columns):
        col = F.col(c)
        v = col.cast("string")
        picks = [F.min_by(v, F.when(col.isNotNull(), F.xxhash64(v, F.lit(seed)))) for seed in range(sample_size)]
        aggs += [F.count_if(col.isNull()).alias(f"n{i}"),
                 F.array_compact(F.array_distinct(F.array(*picks))).alias(f"s{i}")]
    row = df.agg(*aggs).collect()[0]
    cells = [F.struct(F.lit(i).alias("i"), _as_text(F.col(f"`{f.name}`"), f.dataType).alias("v")) for i, f in enumerate(df.schema.fields)]
    values = df.select(F.explode(F.array(*cells)).alias("c")).select("c.i", "c.v").where("v IS NOT NULL").distinct()
    distinct = {r["i"]: r["n"] for r in values.groupBy("i").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = []
    for i, (c, f) in enumerate(zip(df.columns, df.schema.fields)):
        rows.append((c, f.dataType.simpleString(), int(distinct.get(i, 0)), int(row[f"n{i}"]), list(row[f"s{i}"])))
    return df.sparkSession.createDataFrame(
        rows, "column string, dtype string, unique_count long, null_count long, sample_values array<string>")


def describe(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Count, mean, std, min, 25%, 50%, 75%, max of numeric columns."""
    cols = columns or numeric_columns(df)
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"n{i}"), F.avg(c).alias(f"m{i}"), F.stddev_samp(c).alias(f"s{i}"),
                 F.min(c).cast("double").alias(f"a{i}"), F.max(c).cast("double").alias(f"b{i}")]
    row = df.agg(*aggs).collect()[0]
    base = {c: (row[f"n{i}"], row[f"a{i}"], row[f"b{i}"]) for i, c in enumerate(cols)}
    q = quantiles(df, {c: [0.25, 0.5, 0.75] for c in cols}, base=base)
    rows = [(c, float(row[f"n{i}"]), row[f"m{i}"], row[f"s{i}"], row[f"a{i}"], *q[c], row[f"b{i}"])
            for i, c in enumerate(cols)]
    return df.sparkSession.createDataFrame(
        rows, "column string, count double, mean double, std double, min double, "
              "q25 double, q50 double, q75 double, max double")


def descriptive_stats(df: DataFrame, column: str) -> DataFrame:
    """P5: one row: mean, median, smallest mode and number of modes, sample
    std, min, max, q1, q3, bias-corrected skewness and excess kurtosis.
    All modes are ``modes(df, column)`` (a DataFrame: there may be many)."""
    c = F.col(column)
    row = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"),
                 F.min(c).cast("double").alias("min"), F.max(c).cast("double").alias("max"),
                 F.skewness(c).alias("g1"), F.kurtosis(c).alias("g2")).collect()[0]
    q = quantiles(df, {column: [0.25, 0.5, 0.75]}, base={column: (row["n"], row["min"], row["max"])})[column]
    m = modes(df, column)
    mode_row = m.agg(F.min(column).alias("mode"), F.count(F.lit(1)).alias("n_modes")).collect()[0]
    n = row["n"]
    skew = kurt = None
    if n and n > 2 and row["g1"] is not None:
        skew = row["g1"] * (n * (n - 1)) ** 0.5 / (n - 2)
    if n and n > 3 and row["g2"] is not None:
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * row["g2"] + 6)
    rec = (column, row["mean"], q[1], float(mode_row["mode"]) if mode_row["mode"] is not None else None,
           int(mode_row["n_modes"]), row["std"], row["min"], row["max"], q[0], q[2], skew, kurt)
    return df.sparkSession.createDataFrame(
        [rec], "column string, mean double, median double, mode double, n_modes long, std double, "
               "min double, max double, q1 double, q3 double, skewness double, kurtosis double")


def infer_problem_type(df: DataFrame, target: str | None = None) -> DataFrame:
    """The last column is the target; classification when text, or when
    distinct < 10 and distinct < rows / 10; else regression."""
    target = target or df.columns[-1]
    is_text = isinstance(df.schema[target].dataType, T.StringType)
    stats = df.agg(F.count_distinct(target).alias("distinct"), F.count(F.lit(1)).alias("rows"))
    cls = F.lit(is_text) | ((F.col("distinct") < 10) & (F.col("distinct") < F.col("rows") / 10))
    return stats.select(F.lit(target).alias("target"), F.col("distinct").cast("long").alias("distinct"),
                        F.col("rows").cast("long").alias("rows"),
                        F.when(cls, "classification").otherwise("regression").alias("problem_type"))


def column_types(df: DataFrame) -> DataFrame:
    """Text -> categorical, everything else -> numerical."""
    rows = [(f.name, "categorical" if isinstance(f.dataType, T.StringType) else "numerical")
            for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "column string, kind string")


def value_counts(df: DataFrame, column: str, normalize: bool = False) -> DataFrame:
    """Counts of non-missing values, descending."""
    vc = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.agg(F.count(column)).collect()[0][0] or 1
        vc = vc.withColumn("share", F.col("count") / F.lit(float(total)))
    return vc.orderBy(F.desc("count"), F.asc(column))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """Contingency table in long form (pairs with both values present)."""
    return (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
            .groupBy(a, b).agg(F.count(F.lit(1)).alias("count")))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), frames)

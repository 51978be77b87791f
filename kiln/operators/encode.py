"""Categorical encodings (E1-E8): a dictionary fit, then a lookup.

One-hot encodings make one output column per category; a limit on the
categories can be asked for and is then checked.  Code dictionaries (label/binary) are
built as DataFrames with a distributed global index and joined back with
a size-checked broadcast, so they need no cap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import distinct_capped, lookup, with_global_index


def _cat_name(v) -> str:
    return str(v)


def onehot(df: DataFrame, column: str, drop: str | None = "first", cap: int | None = None) -> DataFrame:
    """One 0/1 double column ``{col}_{cat}`` per sorted category; the
    first category is dropped by default (``drop=None`` keeps all,
    ``if_binary`` drops the first only for two categories).  The source
    column is removed; a missing value gives all zeros."""
    cats = distinct_capped(df, column, cap)
    keep = cats
    if drop == "first" or (drop == "if_binary" and len(cats) == 2):
        keep = cats[1:]
    c = F.col(column)
    cols = {f"{column}_{_cat_name(v)}": F.when(c == F.lit(v), 1.0).otherwise(0.0) for v in keep}
    return df.withColumns(cols).drop(column)


def eda_onehot(df: DataFrame, column: str, cap: int | None = None) -> DataFrame:
    """Indicators for every value over the non-missing rows only."""
    data = df.select(column).where(F.col(column).isNotNull())
    cats = distinct_capped(data, column, cap)
    c = F.col(column)
    return data.select(*[(c == F.lit(v)).alias(_cat_name(v)) for v in cats])


def get_dummies(df: DataFrame, column: str, drop_first: bool = True, cap: int | None = None) -> DataFrame:
    """Model preparation dummies, 0/1 integers; missing gives all zeros."""
    cats = distinct_capped(df, column, cap)
    keep = cats[1:] if drop_first else cats
    c = F.col(column)
    return df.withColumns({f"{column}_{_cat_name(v)}": F.when(c == F.lit(v), 1).otherwise(0)
                           for v in keep}).drop(column)


def code_dictionary(df: DataFrame, column: str, name: str = "code") -> DataFrame:
    """Sorted distinct non-missing values with their 0-based rank."""
    d = df.select(column).where(F.col(column).isNotNull()).distinct()
    return with_global_index(d, [column], name)


def label(df: DataFrame, column: str, missing_code: int | None = None) -> DataFrame:
    """Category -> rank among sorted distinct values (0-based).
    E7 (``binary``) is the same with ``missing_code=-1``."""
    dic = code_dictionary(df, column, "_code")
    out = lookup(df, dic, [column], "left")
    code = F.col("_code") if missing_code is None else F.coalesce(F.col("_code"), F.lit(missing_code))
    return out.withColumn(column, code.cast("long")).drop("_code").select(*df.columns)


def binary(df: DataFrame, column: str) -> DataFrame:
    """Despite the name, the sorted category code; missing -> -1."""
    return label(df, column, missing_code=-1)


def target(df: DataFrame, column: str, target_col: str) -> DataFrame:
    """E5: category -> mean target of the category (no smoothing)."""
    means = (df.where(F.col(column).isNotNull()).groupBy(column)
             .agg(F.avg(target_col).alias("_te")))
    out = lookup(df, means, [column], "left")
    return out.withColumn(column, F.col("_te")).drop("_te").select(*df.columns)


def frequency(df: DataFrame, column: str) -> DataFrame:
    """Category -> share among non-missing rows."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    total = df.agg(F.count(column)).collect()[0][0]
    shares = counts.select(column, (F.col("_n") / F.lit(float(total or 1))).alias("_f"))
    out = lookup(df, shares, [column], "left")
    return out.withColumn(column, F.col("_f")).drop("_f").select(*df.columns)


def inverse_label(df: DataFrame, code_col: str, dictionary: DataFrame, column: str,
                  out: str | None = None) -> DataFrame:
    """Code -> original category, from the dictionary a fit produced."""
    dic = dictionary.select(F.col("code").alias(code_col), F.col(column).alias(out or column))
    return lookup(df, dic, [code_col], "left")


def encode(df: DataFrame, columns: list[str], method: str, target_col: str | None = None,
           drop: str | None = "first") -> DataFrame:
    """Feature-service ``encoding`` over several columns."""
    for c in columns:
        if method == "onehot":
            df = onehot(df, c, drop)
        elif method == "label":
            df = label(df, c)
        elif method == "target":
            df = target(df, c, target_col)
        elif method == "frequency":
            df = frequency(df, c)
        elif method == "binary":
            df = binary(df, c)
        else:
            raise ValueError(f"unknown encoding {method!r}")
    return df

"""Missing-value policy.

pandas counts NaN, NaT and None as missing.  Spark aggregates treat NaN as
a value (``avg`` of (1, NaN) is NaN), so floating columns are normalised
NaN -> NULL once, at ingest, and every operator afterwards sees SQL NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)


def nan_to_null_col(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def nan_to_null(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Replace NaN by NULL in floating columns (all of them by default)."""
    floating = [f.name for f in df.schema.fields
                if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    targets = [c for c in floating if columns is None or c in columns]
    if not targets:
        return df
    return df.withColumns({c: nan_to_null_col(F.col(c)) for c in targets})


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns pandas would return from ``select_dtypes('number')``."""
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC_TYPES)]


def is_numeric(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, NUMERIC_TYPES)


def is_text(df: DataFrame, column: str) -> bool:
    return isinstance(df.schema[column].dataType, T.StringType)

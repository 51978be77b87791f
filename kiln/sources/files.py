"""File sources and sinks.

CSV is read with a header; pass an explicit schema for large inputs
(finding the types costs an extra pass).  The pandas default NA tokens
are mapped to NULL, and floating NaN to NULL (``kiln.functions.nulls``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kiln.functions.nulls import nan_to_null

# The text tokens pandas ``read_csv`` reads as missing by default.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


_INTEGER = r"^\s*[+-]?\d{1,18}\s*$"


def _infer(df: DataFrame) -> dict[str, str]:
    """Type of each text column from all its values, in one pass: whole number, number, true/false, else text."""
    aggs = []
    for i, c in enumerate(df.columns):
        x = F.col(f"`{c}`")
        aggs += [F.count(x).alias(f"n{i}"), F.count_if(x.rlike(_INTEGER)).alias(f"i{i}"),
                 F.count(x.try_cast("double")).alias(f"d{i}"), F.count_if(x.isin("True", "False", "TRUE", "FALSE", "true", "false")).alias(f"b{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = r[f"n{i}"]
        kinds = (("bigint", r[f"i{i}"]), ("double", r[f"d{i}"]), ("boolean", r[f"b{i}"]))
        out[c] = next((k for k, m in kinds if n and m == n), "string")
    return out


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multi_line: bool = True) -> DataFrame:
    """Header row; doubled quotes and line breaks inside quotes belong to the value; the default NA tokens are NULL.

    A file that may hold line breaks inside quotes is read by one task;
    ``multi_line=False`` lets Spark split large files whose values have none.

    Values are read as text, NA tokens mapped, and types then given by
    ``schema`` or found in one aggregate over all rows.  A value that its
    given type cannot hold is NULL.  A column without values stays text.
    """
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("escape", '"').option("multiLine", multi_line)
    if schema is not None:
        want = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        text = T.StructType([T.StructField(f.name, T.StringType()) for f in want.fields])
        kinds = {f.name: f.dataType.simpleString() for f in want.fields}
        df = reader.schema(text).csv(path)
    else:
        df, kinds = reader.csv(path), None
    df = df.select(*[F.when(~F.col(f"`{c}`").isin(NA_TOKENS), F.col(f"`{c}`")).alias(c) for c in df.columns])
    kinds = kinds or _infer(df)
    out = [F.col(f"`{c}`").alias(c) if kinds[c] == "string" else
           F.trim(F.col(f"`{c}`")).try_cast(kinds[c]).alias(c) for c in df.columns]
    return nan_to_null(df.select(*out))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S3: header, no index, quotes doubled; one file per partition (never coalesced to one task)."""
    (df.write.mode(mode).option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False)
     .option("ignoreTrailingWhiteSpace", False).csv(path))


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).parquet(path)


def preview(df: DataFrame, order_by: list[str], n: int = 20) -> DataFrame:
    """First ``n`` rows in ``order_by`` order (a TakeOrdered, bounded)."""
    return df.orderBy(*order_by).limit(n)

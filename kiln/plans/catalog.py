"""Registered workloads: each runs one operator over the driver's tables,
next to the DuckDB SQL that computes the same answer.

Inputs are whole tables.  The test tables have no NULLs, so NULLs are
injected by one fixed expression on both sides (``li``); no row is ever
filtered out to make a check cheaper.  Computed doubles are rounded to
the same number of decimals on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return deco


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def rounded(df: DataFrame, digits: int = 6, only: list[str] | None = None) -> DataFrame:
    cols = {f.name: F.round(F.col(f.name), digits) for f in df.schema.fields
            if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and (only is None or f.name in only)}
    return df.withColumns(cols) if cols else df


# NULL injection shared by Spark and SQL (the same fixed expressions).
def li_nulls(spark: SparkSession, sf: str) -> DataFrame:
    li = table(spark, sf, "lineitem")
    k = F.col("l_orderkey")
    return li.withColumns({
        "l_quantity": F.when(k % 13 != 0, F.col("l_quantity")),
        "l_discount": F.when(k % 7 != 0, F.col("l_discount")),
        "l_tax": F.when(k % 11 != 0, F.col("l_tax")),
    })


LI = """li AS (
  SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber,
         CASE WHEN l_orderkey % 13 = 0 THEN NULL ELSE l_quantity END AS l_quantity,
         l_extendedprice,
         CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS l_discount,
         CASE WHEN l_orderkey % 11 = 0 THEN NULL ELSE l_tax END AS l_tax,
         l_returnflag, l_linestatus, l_shipdate
  FROM lineitem)"""

# the 5-column key is unique at every scale (the usual 2-column one is not)
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"


# populate the registry
from kiln.plans import catalog_clean  # noqa: E402,F401
from kiln.plans import catalog_explore  # noqa: E402,F401
from kiln.plans import catalog_model  # noqa: E402,F401

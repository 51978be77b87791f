"""Reading, checkpoints and labelled samples shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kiln.session import ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialised(df: DataFrame) -> DataFrame:
    """The rows as files in the shared checkpoint folder: later reads see the same rows in the same partitions."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column, parts: int):
    """crc32 of the column as text, modulo ``parts``."""
    return F.crc32(F.col(column).cast("string")) % parts

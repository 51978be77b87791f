"""Stream scoring (M16) and streaming apply of fitted steps.

Every *apply* in the library is a stateless projection or filter, so a
fit computed once on a static table runs unchanged on ``readStream``.
Sinks are files in the shared folder (exactly-once with a checkpoint
location); nothing is gathered in driver memory.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from kiln.functions.stats import Fit
from kiln.operators.base import Step


def fit_steps(df: DataFrame, steps: list[Step]) -> dict:
    """Fit all steps on a static table in one fused pass."""
    fit = Fit()
    for s in steps:
        if not s.fusable():
            raise ValueError(f"{type(s).__name__} cannot be applied to a stream from fitted statistics")
        s.request(fit)
    return fit.run(df) if not fit.empty() else {}


def apply_steps(stream: DataFrame, steps: list[Step], stats: dict) -> DataFrame:
    """Apply fitted steps to a (streaming) DataFrame: projections only."""
    for s in steps:
        stream = s.apply(stream, stats)
    return stream


def read_stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet",
                max_files_per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """A file stream over a folder (optionally only files matching ``glob``)."""
    reader = spark.readStream.schema(schema).format(fmt)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def run_to_files(stream: DataFrame, path: str, checkpoint: str, fmt: str = "parquet",
                 available_now: bool = True):
    """Write a stream to files (append); with ``available_now`` process
    everything present and stop, else keep running (returns the query)."""
    w = (stream.writeStream.format(fmt).outputMode("append")
         .option("path", path).option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    q = w.start()
    if available_now:
        q.awaitTermination()
    return q


def score_stream(model: PipelineModel, stream: DataFrame) -> DataFrame:
    """M16 on a stream of raw rows, with or without the target: the saved pipeline does its own encoding and names the
    class.  (Nearest neighbours join every row to the training points and take whole tables only.)"""
    from kiln.operators.models import score
    return score(model, stream)

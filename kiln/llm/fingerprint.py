"""Bottom-k sketches of word shingles.

A sketch holds the k smallest hashes of a text's distinct shingles.  The
sketch of a union is the k smallest of two sketches together, so sketches
of parts merge; resemblance, containment and the number of distinct
shingles are estimated from sketches alone, and exactly so while a text
has at most k shingles.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.textcore import Words, batch_slices, shingle_sets, string_array

K = 256
SPAN = float(2**64)


def sketches(texts: pa.LargeStringArray, k: int = K) -> list[np.ndarray]:
    """The k smallest shingle hashes of each text, ascending."""
    h, off = shingle_sets(Words(texts))
    return [h[a:min(b, a + k)] for a, b in zip(off[:-1].tolist(), off[1:].tolist())]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of both texts' shingles together."""
    return np.union1d(a, b)[:k]


def distinct(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th smallest hash as a share."""
    return float(len(a)) if len(a) < k else (k - 1) / max(float(a[-1]) / SPAN, 1e-300)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity; two texts without shingles are alike (1), one without is unlike any other (0)."""
    if not len(a) and not len(b):
        return 1.0
    both = np.sort(np.concatenate([a, b]))
    first = np.append(True, both[1:] != both[:-1])
    union = np.flatnonzero(first)[:k]
    return float((~np.append(first, True)[union + 1]).sum() / len(union))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has."""
    if not len(a):
        return 1.0
    whole = distinct(merge(a, b, k), k)
    return min(1.0, resemblance(a, b, k) * whole / distinct(a, k))


def encode(a: np.ndarray) -> str:
    return base64.b64encode(np.ascontiguousarray(a, "<u8").tobytes()).decode()


def decode(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def fingerprints(docs: DataFrame, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles (estimated), fingerprint for every row; a null text counts as empty."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_shingles double, fingerprint string"

    def run(batches):
        for rows, texts in batch_slices(batches):
            got = sketches(texts, k)
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array([distinct(s, k) for s in got]), pa.array(map(encode, got), pa.string())],
                                             [id_col, "n_shingles", "fingerprint"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)


def id_cuts(ids: DataFrame, rows_per_range: int) -> list[int]:
    """Ascending upper bounds of id ranges of about ``rows_per_range`` rows; the last range is open.

    As with Spark's own range partitioning, the driver holds one number
    per range.
    """
    n = ids.count()
    parts = -(-n // rows_per_range)
    if parts < 2:
        return []
    return sorted({int(c) for c in ids.approxQuantile("id", [i / parts for i in range(1, parts)], 0.2 / parts)})


def edited_likeness(docs: DataFrame, k: int = K, rows_per_range: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The next document is the one with the next smaller id (after the last:
    the first).  The edited text has its last ``n_chars // 3`` code points
    replaced by the first as many of the next document's (all, if that is
    shorter).  Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    Ids are integers.  A null text counts as empty; null ids come last;
    rows with equal ids follow each other in the order of a hash of their
    text; a single document is its own next one; an empty table gives an
    empty result; other columns are not read.

    Texts are shuffled once, by id range; only the first text of each range
    also goes to the range before it.  Within a range texts are streamed.
    """
    spark = docs.sparkSession
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    cuts = id_cuts(ids.where("id IS NOT NULL"), rows_per_range)
    shared = spark.sparkContext.broadcast(np.array(cuts, np.int64))

    @F.pandas_udf("int")
    def range_of(values: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(shared.value, values.to_numpy(), "left").astype(np.int32))

    span = F.when(F.col("id").isNull(), F.lit(0)).otherwise(range_of(F.coalesce("id", F.lit(0)))) if cuts else F.lit(0)
    heads = {r["span"]: r["head"] for r in ids.withColumn("span", span).groupBy("span").agg(F.max("id").alias("head")).collect()}
    present = sorted(heads)
    marks = spark.createDataFrame([(s, heads[s], present[(i + 1) % len(present)]) for i, s in enumerate(present)],
                                  "span int, head long, before int")  # one row per range
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("span", span)
    tails = (rows.join(F.broadcast(marks), "span").where(F.col("id").eqNullSafe(F.col("head"))).groupBy("before")
             .agg(F.max_by(F.struct("id", "text"), F.xxhash64("text")).alias("x"))
             .select("x.id", "x.text", F.col("before").alias("span"), F.lit(True).alias("tail")))
    placed = (rows.withColumn("tail", F.lit(False)).unionByName(tails).repartitionById(len(cuts) + 1, F.col("span"))
              .sortWithinPartitions("span", "tail", F.col("id").desc_nulls_last(), F.xxhash64("text").desc()))
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def finish(held_ids: list, texts: list[str], after: str) -> pa.RecordBatch:
        own = sketches(string_array(pa.array([*texts, after], pa.string())), k)
        edited = []
        for t, nxt in zip(texts, [*texts[1:], after]):
            m = len(t) // 3
            edited.append(t[:len(t) - m] + nxt[:m])
        other = sketches(string_array(pa.array(edited, pa.string())), k)
        return pa.RecordBatch.from_arrays([
            pa.array(held_ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited], pa.string()),
            pa.array(map(encode, own[:-1]), pa.string()), pa.array(map(encode, other), pa.string()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, other)], pa.float64()),
            pa.array([resemblance(a, b, k) for a, b in zip(own, own[1:])], pa.float64())], ["id", *names])

    def run(batches):
        held_ids, held, size = [], [], 0
        for batch in batches:
            for i, t, tail in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3))):
                if held and (tail or size > 2_000_000):
                    yield finish(held_ids, held, t)
                    held_ids, held, size = [], [], 0
                if not tail:
                    held_ids.append(i)
                    held.append(t)
                    size += len(t)

    out = placed.select("id", "text", "span", "tail").mapInArrow(run, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), *names)

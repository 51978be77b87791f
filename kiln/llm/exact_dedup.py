"""Exact duplicates by two Bloom passes, in DataFrame functions alone.

Every text becomes its SHA-256 digest; texts with one digest count as
equal.  Digests, ids and a row number are kept once in the shared
checkpoint folder, so texts are read once.

* Pass one gives each row one slot of a filter and keeps a bit for each
  slot that two rows or more have hit.  A row whose bit is not set has no
  equal and passes straight through.
* Pass two does the same with another hash, over the rows left by pass
  one only.  What is left then are the repeats and a few chance hits
  (about 0.1 % of the single rows at 16 bits a row).

Only slot numbers and, of the rows left, digests and ids are shuffled; the
slots and the groups are summed map-side first, so a text held by a third
of all rows sends one row per task.  The filters are broadcast: at most
``max_bits`` / 8 bytes each (2^30 bits: 128 MB).  Past about max_bits / 2
rows the filters fill up and more single rows go with the repeats; the
result is the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import lookup
from kiln.llm.common import materialised

BITS_PER_ROW = 16
MAX_BITS = 1 << 30
_BLOCK = 15  # bits of a filter row's number of slots: bitmap_construct_agg makes 4 KB of 2^15 bits


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """The smallest power of two with 16 bits a row, from one filter row up to ``max_bits``."""
    return max(1 << _BLOCK, min(max_bits, 1 << max(BITS_PER_ROW * rows - 1, 1).bit_length()))


def _slot(digest: str, seed: int, bits: int) -> Column:
    return F.xxhash64(F.col(digest), F.lit(seed)).bitwiseAND(F.lit(bits - 1))


def _hit_twice(rows: DataFrame, digest: str, seed: int, bits: int) -> DataFrame:
    """(block, bits): the filter's non-empty blocks; a bit is set where at least two rows hit the slot."""
    slots = rows.select(_slot(digest, seed, bits).alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    inside = F.col("p").bitwiseAND(F.lit((1 << _BLOCK) - 1))
    return materialised(slots.groupBy(F.shiftright("p", _BLOCK).alias("block")).agg(F.bitmap_construct_agg(inside).alias("bits")))


def _hits(rows: DataFrame, digest: str, seed: int, bits: int, filter_rows: DataFrame) -> DataFrame:
    """``rows`` with ``_hit``: is the row's bit set?"""
    p = _slot(digest, seed, bits)
    table = F.broadcast(filter_rows.select(F.col("block").alias("_block"), F.col("bits").alias("_bits")))
    found = rows.join(table, F.shiftright(p, _BLOCK) == F.col("_block"), "left")
    inside = p.bitwiseAND(F.lit((1 << _BLOCK) - 1)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("_bits"), F.shiftright(inside, 3) + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.getbit(byte, inside.bitwiseAND(F.lit(7)))
    return found.select(*rows.columns, (F.coalesce(bit, F.lit(0)) == 1).alias("_hit"))


def possibly_repeated(rows: DataFrame, digest: str, n_rows: int, max_bits: int = MAX_BITS) -> DataFrame:
    """``rows`` (materialised) with ``_maybe``: false where no other row has the digest; true for every repeated digest."""
    bits = filter_bits(n_rows, max_bits)
    once = _hits(rows, digest, 1, bits, _hit_twice(rows, digest, 1, bits)).withColumnRenamed("_hit", "_first")
    left = once.where("_first").select(digest)
    both = _hits(once, digest, 2, bits, _hit_twice(left, digest, 2, bits))
    return both.select(*rows.columns, (F.col("_first") & F.col("_hit")).alias("_maybe"))


def _digest(docs: DataFrame, text: str, normalise) -> Column:
    t = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    return F.unhex(F.sha2(normalise(t) if normalise else t, 256))


def group_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=None, max_bits: int = MAX_BITS) -> DataFrame:
    """One row per row of ``docs``: key, keep_id, group_size, kept, text_sha256.

    Of equal texts the row of the largest key stays.  A null text is the
    empty text.  A null key is less than any other; among rows of the same
    key and text, one stays.  ``normalise`` (column to column) is applied
    to the text first; as given, texts are compared unchanged.  An empty
    table gives no rows; columns other than key and text are not read.
    """
    rows = materialised(docs.select(F.col(f"`{key}`").alias("_k"), _digest(docs, text, normalise).alias("_d"))
                        .withColumn("_r", F.monotonically_increasing_id()))
    marked = possibly_repeated(rows, "_d", rows.count(), max_bits)
    maybe = marked.where("_maybe").drop("_maybe")
    groups = (maybe.groupBy("_d").agg(F.max(F.struct("_k", "_r")).alias("b"), F.count(F.lit(1)).alias("_n"))
              .select("_d", F.col("b._k").alias("_best"), F.col("b._r").alias("_best_r"), "_n"))
    repeated = lookup(maybe, groups, ["_d"])
    single = marked.where("NOT _maybe").select("_d", "_k", "_r", F.col("_k").alias("_best"), F.col("_r").alias("_best_r"), F.lit(1).cast("long").alias("_n"))
    both = single.unionByName(repeated.select(*single.columns))
    return both.select(F.col("_k").alias(key), F.col("_best").alias("keep_id"), F.col("_n").alias("group_size"),
                       (F.col("_r") == F.col("_best_r")).alias("kept"), F.lower(F.hex("_d")).alias("text_sha256"))


def drop_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", normalise=None, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, without repeated texts: of equal texts the row of the largest key stays (ties: the
    larger of the other columns, in their order).  Rows without an equal never move; columns must be of sortable types."""
    rows = docs.select(F.struct("*").alias("_row"), _digest(docs, text, normalise).alias("_d"))
    digests = materialised(rows.select("_d"))
    bits = filter_bits(digests.count(), max_bits)
    first = _hit_twice(digests, "_d", 1, bits)
    left = _hits(digests, "_d", 1, bits, first).where("_hit").select("_d")
    second = _hit_twice(left, "_d", 2, bits)
    marked = _hits(_hits(rows, "_d", 1, bits, first).withColumnRenamed("_hit", "_first"), "_d", 2, bits, second)
    maybe = F.col("_first") & F.col("_hit")
    best = F.max(F.struct(F.col(f"_row.`{key}`").alias("k"), F.col("_row"))).alias("b")
    kept = marked.where(maybe).groupBy("_d").agg(best).select("b._row.*")
    return marked.where(~maybe).select("_row.*").unionByName(kept)

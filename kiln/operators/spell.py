"""Spelling correction (X4), re-aimed as Spark jobs over the corpus itself.

1. Tokens as the reference's library splits them (words, single
   punctuation marks, single whitespace characters); the word-frequency
   table of the corpus decides which words are known (count >= min_count).
2. Unknown words and known words both explode into their deletion
   neighbourhoods (every string reachable by deleting up to two
   characters); an equi-join on those keys yields every known word within
   edit distance 2 (symmetric-delete candidate generation, exact for
   distance <= 2), verified with ``levenshtein``.  The best candidate is
   the smallest distance, then the most frequent, then the smallest word
   (a ``min`` over a struct, partially aggregated).
3. Each document's tokens are mapped through the correction table
   (checked-broadcast lookup) and re-joined in position order.  The work
   per document is bounded by the document; the candidate join is over
   distinct words, not rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.functions.frames import lookup

TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]|\s"
WORD = r"^\p{L}+$"
# Two words within two edits of each other also meet by deleting at most two characters from each of their first
# PREFIX characters, so long words need no larger neighbourhood.
PREFIX = 10


def _deletes(word: F.Column, max_edits: int = 2) -> F.Column:
    """The word's beginning, and every string with 1..max_edits characters deleted from it."""
    word = F.substring(word, 1, PREFIX)
    n = F.length(word)
    one = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))),
                      lambda i: F.concat(F.substring(word, 1, i - 1), F.substring(word, i + 1, 1 << 20)))
    out = F.array_union(F.array(word), one)
    if max_edits >= 2:
        two = F.flatten(F.transform(one, lambda w: F.transform(
            F.sequence(F.lit(1), F.greatest(F.length(w), F.lit(1))),
            lambda i: F.concat(F.substring(w, 1, i - 1), F.substring(w, i + 1, 1 << 20)))))
        out = F.array_union(out, two)
    return F.array_distinct(out)


def correction_table(words: DataFrame, min_count: int = 3, max_edits: int = 2) -> DataFrame:
    """words(word, n) -> (word, correction) for unknown words with a match."""
    known = words.where(F.col("n") >= min_count)
    unknown = words.where(F.col("n") < min_count).select("word")
    kd = known.select(F.col("word").alias("cand"), "n", F.explode(_deletes(F.col("word"), max_edits)).alias("key"))
    ud = unknown.select("word", F.explode(_deletes(F.col("word"), max_edits)).alias("key"))
    pairs = ud.join(kd, "key").select("word", "cand", "n").distinct()
    scored = pairs.withColumn("d", F.levenshtein("word", "cand", max_edits)).where(F.col("d") >= 0)
    best = scored.groupBy("word").agg(F.min(F.struct(F.col("d"), (-F.col("n")).alias("negn"), F.col("cand")))
                                      .alias("b"))
    return best.select("word", F.col("b.cand").alias("correction"))


def correct_spelling(df: DataFrame, column: str, min_count: int = 3, key: str | None = None) -> DataFrame:
    """Correct every word of ``column`` against the corpus' own vocabulary.

    Each distinct text is corrected once and found again by its digest, so
    no row number has to survive a retry (``key`` is accepted and not
    needed)."""
    pattern = F.lit(TOKEN_PATTERN)
    words = (df.select(F.explode(F.regexp_extract_all(F.col(column), pattern, 0)).alias("tok"))
             .where(F.col("tok").rlike(WORD)).groupBy(F.lower("tok").alias("word")).agg(F.count(F.lit(1)).alias("n")))
    table = correction_table(words, min_count)
    texts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_text")).distinct()
    toks = texts.select(F.md5("_text").alias("_rid"), F.posexplode(F.regexp_extract_all("_text", pattern, 0)).alias("pos", "tok"))
    fixed = lookup(toks.withColumn("word", F.lower("tok")), table, ["word"], "left")
    # keep the token's case for unchanged words; corrections are lower-case
    fixed = fixed.select("_rid", "pos", F.coalesce("correction", "tok").alias("tok"))
    text = (fixed.groupBy("_rid").agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("_t"))
            .select("_rid", F.array_join(F.transform("_t", lambda s: s["tok"]), "").alias("_fixed")))
    out = df.withColumn("_rid", F.md5(F.col(column))).join(text, "_rid", "left")
    return out.withColumn(column, F.when(F.col(column).isNotNull(), F.coalesce("_fixed", F.col(column)))).select(*df.columns)

"""Quality rules: exact text statistics with fixed limits, and a calibrated classifier's verdict.

The classifier is a logistic regression on hashed word and byte n-grams,
trained by minibatch descent on a bounded sample of labelled rows and
calibrated by Platt scaling on sample rows that it was not trained on.
Texts are scored in Arrow batches against a fixed threshold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import hashed
from kiln.llm.hashed import SYMBOL, LinearModel, repeats, sigmoid
from kiln.llm.textcore import Words, batch_slices, grams, per_text, span_hash

BITS, CHAR_SIZES = 17, (3, 4)
SAMPLE_ROWS = 6000
THRESHOLD = 0.3
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def statistics(words: Words) -> dict[str, np.ndarray]:
    """The exact counts of each text."""
    b, off, n = words.bytes, words.off, words.n_texts
    first_byte = (b & 0xC0) != 0x80
    h = words.hashes(lower=False)
    covered = np.zeros(len(h) + 3, bool)
    g, at = grams(h, words.text_of, 3)
    if len(at):
        again = at[repeats(g, words.text_of[at])]
        for j in range(3):
            covered[again + j] = True
    return {
        "n_words": words.count.astype(np.int64),
        "word_chars": per_text(words.inside & first_byte, off),
        "n_symbols": per_text(SYMBOL[b], off),
        "n_dup_lines": _equal_lines(words),
        "n_repeat_words": np.bincount(words.text_of, covered[:len(h)], n).astype(np.int64),
    }


def _equal_lines(words: Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    b, off, n = words.bytes, words.off, words.n_texts
    if not len(b):
        return np.zeros(n, np.int64)
    brk = np.flatnonzero(b == 10)
    start = np.union1d(off[:-1], brk + 1)
    start = start[start < len(b)]
    end = np.append(start[1:], len(b))
    has_break = b[end - 1] == 10
    end = end - has_break
    owner = np.searchsorted(off, start, "right") - 1
    word_at = np.concatenate([[0], np.cumsum(words.inside)])
    full = (word_at[end] - word_at[start]) > 0
    start, end, owner = start[full], end[full], owner[full]
    if not len(start):
        return np.zeros(n, np.int64)
    code, uniq = pd.factorize(span_hash(b, start, end) ^ hashed.mix(owner.astype(np.uint64) + np.uint64(1)))
    return np.bincount(owner, minlength=n) - np.bincount(owner[np.unique(code, return_index=True)[1]], minlength=n)


def base_failed(stats: dict[str, np.ndarray]) -> np.ndarray:
    return (stats["n_words"] < 50) | (100 * stats["n_repeat_words"] > 50 * stats["n_words"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample_rows: int = SAMPLE_ROWS) -> LinearModel:
    """Fit on at most ``sample_rows`` labelled rows, one per id; every fifth of them only calibrates.

    Without any labelled text, or with one class only, the model gives
    every text the smoothed share of that class.
    """
    picked = hashed.sample_of(labels.where(F.col(label_col).isNotNull()).groupBy(id_col).agg(F.max(label_col).cast("double").alias("_y")),
                              id_col, sample_rows)
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(picked), id_col)
    rows = hashed.one_row_each(rows, [id_col])
    got, x = hashed.collect_features(rows, [id_col, "_y"], BITS, CHAR_SIZES, True)
    model = LinearModel(BITS, CHAR_SIZES, True)
    y = got["_y"].to_numpy()
    if len(set(y)) < 2:
        model.shift = float(np.log((y.sum() + 1) / (len(y) - y.sum() + 1)))
        return model
    held = np.arange(len(y)) % 5 == 4
    part = x.take(~held)
    yt = y[~held]
    weight = np.where(yt > 0, 0.5 / max(yt.mean(), 1e-9), 0.5 / max(1 - yt.mean(), 1e-9))
    model.descend(part, lambda r, z: weight[r] * (sigmoid(z) - yt[r]) / len(r), epochs=12, batch=128, rate=0.3)
    rest = x.take(held) if len(set(y[held])) == 2 else part
    model.calibrate(model.of_rows(rest), y[held] if rest is not part else yt)
    return model


def score(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, score, kept for every row.

    ``kept``: the base rules pass and the classifier's probability of good
    quality is at least ``threshold``.  A null or empty text has no words
    and fails; repeated rows and null ids are kept as rows; other columns
    are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, *STATS, "base_failed", "score", "kept"]
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{s} long" for s in STATS)
              + ", base_failed boolean, score double, kept boolean")

    def run(batches):
        for rows, texts in batch_slices(batches):
            words = Words(texts)
            stats = statistics(words)
            bad = base_failed(stats)
            p = shared.value.scores(words)
            yield pa.RecordBatch.from_arrays([rows.column(0), *(pa.array(stats[s].astype(np.int64)) for s in STATS), pa.array(bad), pa.array(p),
                                              pa.array(~bad & (p >= threshold))], names)

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)


def keep(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose text is kept.  Null and empty texts fail the rules and go; repeated rows and null
    ids are judged row by row; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for rows, texts in batch_slices(batches, text_col):
            words = Words(texts)
            good = ~base_failed(statistics(words)) & (shared.value.scores(words) >= threshold)
            yield rows.filter(pa.array(good))

    return docs.mapInArrow(run, docs.schema)

"""Language identification by averaged hashed subword embeddings and a linear softmax.

Training: hashed words and byte n-grams of a bounded sample of texts with
a known language are embedded (a table of small vectors), averaged and
fed to a softmax; table and softmax are trained by stochastic gradient
descent in numpy.  Since average and softmax layer are both linear, the
trained table and layer are multiplied out once: a text's class margins
are then the mean of one row of class weights per n-gram.

Calibrated rejection: the margins' temperature is fitted on sample rows
that were not trained on, and a text is rejected when its probability is
below the level that only ``reject_share`` of the rightly recognised
calibration rows miss (never above one half), or when it has no letter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm import hashed
from kiln.llm.common import fold, materialised
from kiln.llm.hashed import Sparse, groups
from kiln.llm.textcore import Words, batch_slices, per_text

BITS, CHAR_SIZES, DIM = 16, (3, 4), 16
SAMPLE_ROWS = 4000  # over all languages
LEAST_ROWS = 200     # of one language
UNKNOWN = "und"


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


class LanguageModel:
    """Class weights per hash bucket, bias, temperature and the probability below which a text is rejected."""

    def __init__(self, languages: list[str]):
        self.languages = languages
        self.table = np.zeros((1 << BITS, max(len(languages), 1)))
        self.bias = np.zeros(max(len(languages), 1))
        self.temperature, self.least = 1.0, 0.0

    def fit(self, x: Sparse, y: np.ndarray, epochs: int = 8, batch: int = 32, rate: float = 0.5, seed: int = 0) -> None:
        """SGD with a linearly falling rate; the softmax layer and only the embeddings of the batch's buckets move."""
        rng = np.random.default_rng(seed)
        c = len(self.languages)
        emb = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM))
        out, bias = np.zeros((DIM, c)), np.zeros(c)
        steps, done = epochs * -(-x.n // batch), 0
        n_groups = len(CHAR_SIZES) + 1
        for _ in range(epochs):
            order = rng.permutation(x.n)
            for lo in range(0, x.n, batch):
                which = order[lo:lo + batch]
                r, i, s = x.rows(which)
                s = s / n_groups
                lr = rate * (1 - done / steps)
                done += 1
                start = np.flatnonzero(np.append(True, r[1:] != r[:-1])) if len(r) else np.empty(0, np.int64)
                mean = np.zeros((len(which), DIM))
                if len(r):
                    mean[r[start]] = np.add.reduceat(emb[i] * s[:, None], start)
                d = _softmax(mean @ out + bias)
                d[np.arange(len(which)), y[which]] -= 1
                back = d @ out.T
                out -= lr * mean.T @ d
                bias -= lr * d.mean(0)
                np.add.at(emb, i, -lr * len(which) * back[r] * s[:, None])
        self.table, self.bias = emb @ out / n_groups, bias

    def of_rows(self, x: Sparse) -> np.ndarray:
        z = np.tile(self.bias, (x.n, 1)).astype(float)
        for which in x.slices():
            r, i, s = x.rows(which)
            for k in range(z.shape[1]):
                z[which, k] += np.bincount(r, self.table[i, k] * s, len(which))
        return z

    def calibrate(self, z: np.ndarray, y: np.ndarray, reject_share: float) -> None:
        grid = np.exp(np.linspace(np.log(0.02), np.log(20), 200))
        loss = [-np.log(_softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])
        p = _softmax(z / self.temperature)
        right = p.max(1)[p.argmax(1) == y]
        self.least = float(min(np.quantile(right, reject_share), 0.5)) if len(right) else 0.0

    def predict(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """(index of the likeliest language, its calibrated probability) of each text."""
        z = np.tile(self.bias, (words.n_texts, 1)).astype(float)
        for bucket, cut in groups(words, BITS, CHAR_SIZES, False):
            n = np.maximum(np.diff(cut), 1)
            for k in range(z.shape[1]):
                c = np.concatenate([[0.0], np.cumsum(self.table[bucket, k])])
                z[:, k] += (c[cut[1:]] - c[cut[:-1]]) / n
        p = _softmax(z / self.temperature)
        return p.argmax(1), p.max(1)


def has_letter(words: Words, texts: pa.LargeStringArray) -> np.ndarray:
    b = words.bytes
    low = b | 0x20
    out = per_text((low >= 97) & (low <= 122), words.off) > 0
    for t in np.flatnonzero(~out):
        out[t] = any(ch.isalpha() for ch in texts[int(t)].as_py())
    return out


def train(docs: DataFrame, parts: int = 3, held_out: int = 1, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          sample_rows: int = SAMPLE_ROWS, reject_share: float = 0.001) -> LanguageModel:
    """Fit on rows with a language whose fold is not ``held_out``; every fifth only calibrates.

    Each language has the same share of ``sample_rows``, but at least ``LEAST_ROWS``, one row per id, those first in the order
    of a hash of the id: a rare language is learned however many rows others have.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (fold(id_col, parts) != held_out)) \
        .select(id_col, F.col(lang_col).alias("_y"), F.col(text_col).alias("text"))
    keys = rows.select(id_col, "_y").where(F.col(id_col).isNotNull()).distinct()
    sizes = materialised(keys.groupBy("_y").agg(F.count(F.lit(1)).alias("_n")))  # one row per language
    each = max(LEAST_ROWS, sample_rows // max(sizes.count(), 1))
    drawn = F.xxhash64(F.col(id_col).cast("string"))
    likely = drawn.cast("double") <= F.lit(-2.0 ** 63) + F.lit(2.0 ** 64) * F.least(F.lit(1.0), F.lit(2.0 * each) / F.col("_n"))  # twice what is wanted
    place = F.row_number().over(Window.partitionBy("_y").orderBy(drawn, id_col))
    picked = keys.join(F.broadcast(sizes), "_y").where(likely).select(id_col, "_y").withColumn("_place", place).where(F.col("_place") <= each).drop("_place")
    sample = hashed.one_row_each(rows.join(F.broadcast(picked), [id_col, "_y"]), [id_col, "_y"])
    got, x = hashed.collect_features(sample, [id_col, "_y"], BITS, CHAR_SIZES, False)
    names = sorted(set(got["_y"]))
    model = LanguageModel(names or [UNKNOWN])
    if len(names) < 2:
        return model
    y = got["_y"].map({n: k for k, n in enumerate(names)}).to_numpy()
    held = np.arange(len(y)) % 5 == 4
    model.fit(x.take(~held), y[~held])
    if held.any():
        model.calibrate(model.of_rows(x.take(held)), y[held], reject_share)
    return model


def predict(docs: DataFrame, model: LanguageModel, parts: int = 3, held_out: int = 1, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row.

    ``und`` with score 0 where the text is null or has no letter (empty
    ones included); those, and texts whose probability is below the
    calibrated level, are ``rejected``.  Repeated rows and null ids are
    kept; other columns are not read; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = [id_col, "held_out", "lang_pred", "score", "rejected"]
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, held_out boolean, lang_pred string, score double, rejected boolean"

    def run(batches):
        m = shared.value
        for rows, texts in batch_slices(batches):
            words = Words(texts)
            k, p = m.predict(words)
            known = has_letter(words, texts)
            lang = [m.languages[j] if ok else UNKNOWN for j, ok in zip(k.tolist(), known.tolist())]
            p = np.where(known, p, 0.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(lang, pa.string()), pa.array(p),
                                              pa.array(~known | (p < m.least))], names)

    return docs.select(id_col, F.coalesce(fold(id_col, parts) == held_out, F.lit(False)).alias("held_out"),
                       F.col(text_col).alias("text")).mapInArrow(run, schema)


def keep(docs: DataFrame, model: LanguageModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whose language is recognised.  Null texts and texts without a letter go; repeated rows
    and null ids are judged row by row; an empty table stays empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for rows, texts in batch_slices(batches, text_col):
            words = Words(texts)
            yield rows.filter(pa.array(has_letter(words, texts) & (m.predict(words)[1] >= m.least)))

    return docs.mapInArrow(run, docs.schema)

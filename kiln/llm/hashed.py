"""Hashed word and character n-grams of whole texts, and linear models on them.

A text's features are shares: how often each hashed n-gram occurs among
the n-grams of its group (words, word pairs, byte n-grams), so the length
of a text does not matter.  A trained linear model is a weight per hash
bucket, and a batch is scored by one gather and one running sum per group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm.textcore import LOWER, U64, Words, batch_slices, grams, mix, per_text, powers, span_hash

SYMBOL = np.zeros(256, bool)
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
N_SHAPE = 8
FETCHES = 32  # partitions in which a sample comes to the driver


def byte_grams(values: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every ``n`` consecutive bytes within one text, and offsets per text."""
    m = len(values) - n + 1
    lens = np.maximum(np.diff(off) - n + 1, 0)
    if m <= 0:
        return np.empty(0, U64), np.zeros(len(off), np.int64)
    v = values.astype(U64) + U64(1)
    h = np.full(m, n, U64)
    for j in range(n):
        h += v[j:j + m] << U64(9 * j)
    ok = np.ones(m + n, bool)
    for cut in range(1, n):
        at = off[1:-1] - cut
        ok[at[(at >= 0) & (at < m)]] = False
    return mix(h[ok[:m]]), np.concatenate([[0], np.cumsum(lens)])


def repeats(keys: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """True where a key occurs at least twice within its owner."""
    code, uniq = pd.factorize(mix(owner.astype(U64) + U64(1)) ^ keys)
    return np.bincount(code, minlength=len(uniq))[code] > 1


def groups(words: Words, bits: int, char_sizes: tuple[int, ...], pairs: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket of each n-gram, offsets per text) for each group of n-grams."""
    shift = U64(64 - bits)
    h = words.hashes(lower=True)
    text_cut = np.append(words.first, len(h))
    out = [(((mix(h + U64(11))) >> shift).astype(np.int32), text_cut)]
    if pairs:
        g, at = grams(h, words.text_of, 2)
        same = h[at] == h[at + 1] if len(at) else np.empty(0, bool)
        g[same] = U64(7)  # a word after itself is one feature, whichever word it is
        out.append(((mix(g + U64(23)) >> shift).astype(np.int32),
                    np.searchsorted(words.text_of[at], np.arange(words.n_texts + 1)) if len(at) else np.zeros(words.n_texts + 1, np.int64)))
    for n in char_sizes:
        g, cut = byte_grams(words.bytes, words.off, n)
        out.append(((mix(g + U64(31 * n)) >> shift).astype(np.int32), cut))
    return out


def shape(words: Words) -> np.ndarray:
    """A few shares per text that n-grams of a fixed size miss: repeated word triples, symbols, case, digits, word length."""
    n = words.n_texts
    h = words.hashes(lower=False)
    size = np.maximum(np.diff(words.off), 1)
    b = words.bytes
    out = np.zeros((n, N_SHAPE))
    g, at = grams(h, words.text_of, 3)
    if len(at):
        again = at[repeats(g, words.text_of[at])]
        covered = np.zeros(len(h) + 3, bool)
        for j in range(3):
            covered[again + j] = True
        out[:, 0] = np.bincount(words.text_of, covered[:len(h)], n) / np.maximum(words.count, 1)
    if len(h) > 1:
        same = np.append((h[1:] == h[:-1]) & (words.text_of[1:] == words.text_of[:-1]), False)
        out[:, 1] = np.bincount(words.text_of, same, n) / np.maximum(words.count, 1)
    out[:, 2] = per_text(SYMBOL[b], words.off) / size * 10
    out[:, 3] = per_text((b >= 65) & (b <= 90), words.off) / size
    out[:, 4] = per_text((b >= 48) & (b <= 57), words.off) / size * 5
    out[:, 5] = np.minimum((size / np.maximum(words.count, 1)) / 10, 3)
    out[:, 6] = np.minimum(words.count, 50) / 50
    out[:, 7] = per_text((b == 33) | (b == 63), words.off) / size * 10
    return out


def sparse_rows(words: Words, bits: int, char_sizes: tuple[int, ...], pairs: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, shares) of each text, buckets ascending."""
    parts = groups(words, bits, char_sizes, pairs)
    out = []
    for t in range(words.n_texts):
        idx, val = [], []
        for bucket, cut in parts:
            got = bucket[cut[t]:cut[t + 1]]
            if len(got):
                u, c = np.unique(got, return_counts=True)
                idx.append(u)
                val.append((c / len(got)).astype(np.float32))
        if idx:
            i, v = np.concatenate(idx), np.concatenate(val)
            u, inverse = np.unique(i, return_inverse=True)
            out.append((u.astype(np.int32), np.bincount(inverse, v).astype(np.float32)))
        else:
            out.append((np.empty(0, np.int32), np.empty(0, np.float32)))
    return out


def collect_features(rows: DataFrame, keep: list[str], bits: int, char_sizes: tuple[int, ...], pairs: bool) -> tuple[pd.DataFrame, Sparse]:
    """The features of a *bounded* sample (columns ``keep`` and text): its columns ``keep`` and its n-grams, both in the order of ``keep``.

    The executors compute the features and deal them over small partitions;
    the driver fetches one partition at a time into flat buffers, so it
    holds the sample once.  Rows that tie in ``keep`` are in the order of
    their text's hash.
    """
    names = [*keep, "_digest", "idx", "val", "shape"]
    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep) + ", _digest long, idx binary, val binary, shape binary"

    def run(batches):
        for part, texts in batch_slices(batches):
            words = Words(texts)
            got = sparse_rows(words, bits, char_sizes, pairs)
            dense = shape(words)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(part.schema.get_field_index(c)) for c in names[:-3]), pa.array([i.tobytes() for i, _ in got], pa.binary()),
                 pa.array([v.tobytes() for _, v in got], pa.binary()), pa.array([d.tobytes() for d in dense], pa.binary())], names)

    found = rows.select(*keep, F.xxhash64("text").alias("_digest"), "text").mapInArrow(run, schema).repartition(FETCHES)
    idx, val, dense, size, kept = bytearray(), bytearray(), bytearray(), [], []
    for row in found.toLocalIterator():
        kept.append(tuple(row[:len(keep) + 1]))
        idx += row["idx"]
        val += row["val"]
        dense += row["shape"]
        size.append(len(row["idx"]) // 4)
    table = pd.DataFrame(kept, columns=names[:-3]).sort_values(names[:-3], kind="stable")
    size = np.array(size, np.int64)
    x = Sparse(np.frombuffer(idx, np.int32), np.frombuffer(val, np.float32), np.cumsum(size) - size, size, np.frombuffer(dense).reshape(-1, N_SHAPE))
    return table[keep].reset_index(drop=True), x.take(table.index.to_numpy(np.int64))


class Sparse:
    """Rows of (bucket, share) pairs, flat; a choice of rows shares the pairs."""

    def __init__(self, idx: np.ndarray, val: np.ndarray, first: np.ndarray, size: np.ndarray, shape: np.ndarray):
        self.n = len(size)
        self.idx, self.val, self.first, self.size, self.shape = idx, val, first, size, shape

    def take(self, which: np.ndarray) -> Sparse:
        """The rows of these numbers, or where a mask is true."""
        return Sparse(self.idx, self.val, self.first[which], self.size[which], self.shape[which])

    def rows(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, share) triples of the chosen rows, rows renumbered."""
        lens = self.size[which]
        at = np.repeat(self.first[which] - (np.cumsum(lens) - lens), lens) + np.arange(int(lens.sum()))
        return np.repeat(np.arange(len(which)), lens), self.idx[at], self.val[at]

    def slices(self) -> list[np.ndarray]:
        """The numbers of all rows, a few at a time."""
        return [np.arange(lo, min(lo + 256, self.n)) for lo in range(0, self.n, 256)]


class LinearModel:
    """A weight per bucket, weights for the shape shares, and a bias; ``scale`` and ``shift`` map margins to calibrated ones."""

    def __init__(self, bits: int, char_sizes: tuple[int, ...], pairs: bool):
        self.bits, self.char_sizes, self.pairs = bits, char_sizes, pairs
        self.w = np.zeros(1 << bits)
        self.v = np.zeros(N_SHAPE)
        self.bias, self.scale, self.shift = 0.0, 1.0, 0.0

    def margins(self, words: Words) -> np.ndarray:
        z = shape(words) @ self.v + self.bias
        for bucket, cut in groups(words, self.bits, self.char_sizes, self.pairs):
            c = np.concatenate([[0.0], np.cumsum(self.w[bucket])])
            z += (c[cut[1:]] - c[cut[:-1]]) / np.maximum(np.diff(cut), 1)
        return z

    def scores(self, words: Words) -> np.ndarray:
        return sigmoid(self.scale * self.margins(words) + self.shift)

    def of_rows(self, x: Sparse) -> np.ndarray:
        z = x.shape @ self.v + self.bias
        for which in x.slices():
            r, i, s = x.rows(which)
            z[which] += np.bincount(r, self.w[i] * s, len(which))
        return z

    def descend(self, x: Sparse, slope, epochs: int, batch: int, rate: float, seed: int = 0, decay: float = 1e-5) -> None:
        """AdaGrad over shuffled minibatches; ``slope(rows, margins)`` is the loss's derivative for each margin."""
        rng = np.random.default_rng(seed)
        hw, hv, hb = np.full(len(self.w), 1e-8), np.full(N_SHAPE, 1e-8), 1e-8
        for _ in range(epochs):
            order = rng.permutation(x.n)
            for lo in range(0, x.n, batch):
                which = order[lo:lo + batch]
                r, i, s = x.rows(which)
                z = np.bincount(r, self.w[i] * s, len(which)) + x.shape[which] @ self.v + self.bias
                d = slope(which, z)
                g = np.bincount(i, d[r] * s, len(self.w)) + decay * self.w
                hw += g * g
                self.w -= rate * g / np.sqrt(hw)
                gv = x.shape[which].T @ d + decay * self.v
                hv += gv * gv
                self.v -= rate * gv / np.sqrt(hv)
                gb = d.sum()
                hb += gb * gb
                self.bias -= rate * gb / np.sqrt(hb)

    def calibrate(self, margins: np.ndarray, y: np.ndarray) -> None:
        """Platt scaling: the logistic curve through (margin, label), by Newton's method with smoothed targets."""
        pos, neg = y.sum(), len(y) - y.sum()
        t = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        sd = float(margins.std()) or 1.0
        x = np.stack([margins / sd, np.ones(len(y))], 1)
        a = np.array([1.0, 0.0])
        for _ in range(50):
            p = sigmoid(x @ a)
            grad = x.T @ (p - t) + 1e-3 * a
            hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
            step = np.linalg.solve(hess, grad)
            a = a - np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        self.scale, self.shift = max(float(a[0]), 0.0) / sd, float(a[1])


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sample_of(keys: DataFrame, key: str, most: int) -> DataFrame:
    """At most ``most`` rows, those first in the order of a hash of the key: a random, repeatable, *bounded* sample."""
    return keys.where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.col(key).cast("string")), key).limit(most)


def one_row_each(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, that of the least text hash: a key on many rows does not lift the bound of a sample."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.min(F.struct(F.xxhash64("text").alias("_h"), *rest)).alias("_b")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.`{c}`").alias(c) for c in rest])


__all__ = ["LOWER", "LinearModel", "Sparse", "collect_features", "groups", "one_row_each", "powers", "sample_of", "shape", "span_hash"]

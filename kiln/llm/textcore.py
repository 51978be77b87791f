"""Vectorised text helpers that run inside Arrow batches.

Everything here works on one batch of whole texts held by one task: a
``Words`` object locates the words of every text of the batch in its
UTF-8 bytes and hashes them with numpy, without a Python loop over words.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_R = 0x9E3779B97F4A7C15 | 1
_POWERS = np.ones(1, U64)

SEP = np.zeros(256, bool)
SEP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(n: int) -> np.ndarray:
    """The first ``n`` powers of the hash's multiplier, modulo 2**64."""
    global _POWERS
    if len(_POWERS) < n:
        out = np.full(max(n, 256), _R, U64)
        out[0] = 1
        _POWERS = np.cumprod(out, dtype=U64)
    return _POWERS[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of ``values[s:e]`` for each ascending, non-empty, disjoint span."""
    if not len(starts):
        return np.empty(0, U64)
    lens = ends - starts
    whole = len(starts) == 1 or bool((ends[:-1] == starts[1:]).all())
    lo, hi = int(starts[0]), int(ends[-1])
    if whole:
        first, part = starts - lo, values[lo:hi]
    else:
        first = np.cumsum(lens) - lens
        at = np.arange(int(lens.sum())) + np.repeat(starts - first, lens)
        part = values[at]
    k = np.arange(len(part), dtype=np.int32 if len(part) < 2**31 else np.int64)
    k -= np.repeat(first.astype(k.dtype), lens)
    v = part.astype(U64)
    v += U64(1)
    v *= powers(int(lens.max()))[k]
    return mix(np.add.reduceat(v, first) ^ (lens.astype(U64) * U64(0xD6E8FEB86659FD93)))


try:
    _malloc_trim = ctypes.CDLL("libc.so.6").malloc_trim
except (OSError, AttributeError):  # another C library
    _malloc_trim = None


def trim() -> None:
    """Give freed memory back to the system: Python workers are reused, and what one task freed would otherwise stay with its worker."""
    pa.default_memory_pool().release_unused()
    if _malloc_trim is not None:
        _malloc_trim(0)


def string_array(column) -> pa.LargeStringArray:
    """One large-string array without nulls (a null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    return column.cast(pa.large_string())


def slices(array: pa.LargeStringArray, budget: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``budget`` bytes each; a longer text gets a range of its own."""
    if not len(array):
        return
    off = np.frombuffer(array.buffers()[1], np.int64)[array.offset:array.offset + len(array) + 1]
    lo = 0
    while lo < len(array):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + budget, "right")) - 1)
        yield lo, min(hi, len(array))
        lo = hi


def batch_slices(batches: Iterable[pa.RecordBatch], column: str = "text",
                 budget: int = 1_000_000) -> Iterator[tuple[pa.RecordBatch, pa.LargeStringArray]]:
    """(rows, their texts) in pieces of bounded size, so that temporaries stay small."""
    for batch in batches:
        texts = string_array(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in slices(texts, budget):
            yield batch.slice(lo, hi - lo), texts.slice(lo, hi - lo)
        del batch, texts
    trim()


def raw_bytes(texts: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, and the offsets of each (one more than there are texts)."""
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[off[0]:off[-1]], off - off[0]


def per_text(counts_at: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many of the flagged positions lie in each text."""
    c = np.concatenate([[0], np.cumsum(counts_at)])
    return c[off[1:]] - c[off[:-1]]


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each text: byte spans, owner text, range per text."""

    def __init__(self, texts: pa.LargeStringArray):
        self.bytes, self.off = raw_bytes(texts)
        b, off = self.bytes, self.off
        n = len(b)
        self.n_texts = len(texts)
        inside = ~SEP[b]
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = inside[:-1], inside[1:]
        self.start = np.flatnonzero(inside & (~before | edge[:n]))
        self.end = np.flatnonzero(inside & (~after | edge[1:n + 1])) + 1
        self.inside = inside
        self.first = np.searchsorted(self.start, off[:-1])
        self.last = np.searchsorted(self.start, off[1:])
        self.count = self.last - self.first
        self.text_of = np.repeat(np.arange(self.n_texts), self.count)

    def hashes(self, lower: bool) -> np.ndarray:
        return span_hash(LOWER[self.bytes] if lower else self.bytes, self.start, self.end)


def grams(h: np.ndarray, text_of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and owner of every run of ``n`` consecutive words that lies in one text (gram i starts at word i's place)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, U64), np.empty(0, np.int64)
    g = np.full(m, n, U64)
    c = powers(n + 2)
    for j in range(n):
        g += h[j:j + m] * c[j + 1]
    ok = text_of[:m] == text_of[n - 1:]
    at = np.flatnonzero(ok)
    return mix(g[at]), at


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ``n``-word shingles of each lower-cased text, as sorted 64-bit hashes.

    Returns (hashes, offsets).  A text with fewer words has its whole word
    sequence as its one shingle; a text without words has none.
    """
    h = words.hashes(lower=True)
    g, at = grams(h, words.text_of, n)
    owner = words.text_of[at] if len(at) else np.empty(0, np.int64)
    few = np.flatnonzero((words.count > 0) & (words.count < n))
    if len(few):
        extra = np.empty(len(few), U64)
        c = powers(n + 2)
        for k, t in enumerate(few):
            part = h[words.first[t]:words.last[t]]
            extra[k] = (part * c[1:len(part) + 1]).sum(dtype=U64) + U64(len(part))
        g, owner = np.concatenate([g, mix(extra)]), np.concatenate([owner, few])
    order = np.lexsort((g, owner))
    g, owner = g[order], owner[order]
    if len(g):
        keep = np.ones(len(g), bool)
        keep[1:] = (g[1:] != g[:-1]) | (owner[1:] != owner[:-1])
        g, owner = g[keep], owner[keep]
    off = np.searchsorted(owner, np.arange(words.n_texts + 1))
    return g, off

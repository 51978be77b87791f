"""Token counts by the whole-token shortcut.

Offline, every string of the vocabulary is encoded alone by the library;
those that come out as one token, as one pre-token, are *proven*.  Inside
tasks a pre-token that equals a proven string counts one without being
merged, and only the others are merged (once per distinct pre-token and
task; the cache is bounded).

The table of proven strings has at most one entry per vocabulary string,
so its broadcast does not grow with the data.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kiln.llm import bpe
from kiln.llm.textcore import batch_slices, span_hash


def prove_whole_tokens(path: str) -> list[str]:
    """Vocabulary strings that the library encodes alone as one token, within one pre-token."""
    enc = bpe.Encoder(path)
    lib = enc.lib
    strings = [lib.decode([i], skip_special_tokens=False) for i in range(lib.get_vocab_size())]
    strings = [s for s in dict.fromkeys(strings) if s and "�" not in s and not enc.library_only(s)]
    codes = lib.encode_batch(strings, add_special_tokens=False)
    parts = np.bincount(enc.segment(strings)[2], minlength=len(strings))
    return [s for s, e, n in zip(strings, codes, parts) if len(e.ids) == 1 and n == 1]


class WholeTokenCounter(bpe.Encoder):
    """Counts proven pre-tokens directly and merges the rest."""

    def __init__(self, path: str, proven: list[str]):
        super().__init__(path)
        parts = [np.frombuffer(s.encode("utf-32-le"), np.uint32) for s in proven]
        ends = np.cumsum([len(p) for p in parts])
        flat = np.concatenate(parts) if parts else np.empty(0, np.uint32)
        self.proven = np.sort(span_hash(flat, np.append(0, ends[:-1]), ends)) if parts else np.empty(0, np.uint64)

    def lengths(self, hashes: np.ndarray, strings) -> np.ndarray:
        at = np.searchsorted(self.proven, hashes)
        whole = self.proven[np.minimum(at, len(self.proven) - 1)] == hashes if len(self.proven) else np.zeros(len(hashes), bool)
        out = np.ones(len(hashes), np.int64)
        rest = np.flatnonzero(~whole)
        if len(rest):
            out[rest] = self.lookup(hashes[rest], lambda which: strings(rest[which]))[1]
        return out


@lru_cache(2)
def _counter(path: str, proven: tuple[str, ...]) -> WholeTokenCounter:
    return WholeTokenCounter(path, list(proven))


def count_tokens(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens) for every row of ``docs``.

    A null text counts as empty (0 bytes, 0 tokens); an empty table gives
    an empty result; repeated rows and null ids are kept as they are;
    other columns of ``docs`` are not read.  Counts equal those of the
    library, special strings inside texts included.
    """
    spark = docs.sparkSession
    proven = spark.sparkContext.broadcast(tuple(prove_whole_tokens(path)))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean"

    def run(batches):
        counter = _counter(path, proven.value)
        for rows, texts in batch_slices(batches):
            n = counter.count(texts.to_pylist())
            off = np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1])
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(off), pa.array(n), pa.array(n > limit)],
                                             [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)

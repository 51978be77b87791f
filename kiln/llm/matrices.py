"""Token-id matrices: best-fit-decreasing packing with a segment tree over free capacity.

Each task tokenises its documents and packs them shard by shard (a shard
is about ``shard_tokens`` tokens, so memory is bounded and no shuffle is
needed).  Within a shard the pieces are placed longest first into the
open sequence with the least room that still holds them; a segment tree
over capacities finds it in logarithmic time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from kiln.llm import bpe
from kiln.llm.pieces import crc, pieces
from kiln.llm.textcore import batch_slices


class CapacityTree:
    """Sequences with room, by their room; ``best(n)`` is one with the least room that is at least ``n``."""

    def __init__(self, capacity: int):
        self.size = 1
        while self.size < capacity + 1:
            self.size *= 2
        self.count = [0] * (2 * self.size)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, sequence: int) -> None:
        self.stacks[room].append(sequence)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        node = self.size + room
        while node:
            self.count[node] += by
            node //= 2

    def best(self, need: int) -> tuple[int, int] | None:
        """(room, sequence), taken out of the tree; None if no sequence has ``need`` room."""
        node = self.size + need
        if not self.count[node]:
            while node > 1 and (node % 2 or not self.count[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node if self.count[2 * node] else 2 * node + 1
        room = node - self.size
        self._change(room, -1)
        return room, self.stacks[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indices of the pieces in each sequence."""
    tree, out = CapacityTree(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        hit = tree.best(lengths[i])
        if hit is None:
            out.append([i])
            hit = capacity, len(out) - 1
        else:
            out[hit[1]].append(i)
        if hit[0] - lengths[i]:
            tree.add(hit[0] - lengths[i], hit[1])
    return out


SCHEMA = ("part long, shard long, sequence long, n_tokens long, n_segments long, ids binary, cu_seqlens array<int>, positions binary, "
          "doc_ids array<{id}>, pieces array<int>, ids_crc32 long")


def token_matrix(docs: DataFrame, path: str, length: int = 1024, end_id: int = 50256, pad_id: int = 50256,
                 shard_tokens: int = 4_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per packed sequence, i.e. per row of a shard's id matrix.

    ``ids``: ``length`` ids, little-endian unsigned 32-bit, padded with
    ``pad_id`` after the last segment; ``cu_seqlens``: 0 and the end of
    each segment; ``positions``: position of each id in its segment, from
    0 again at each segment start (unsigned 32-bit, 0 in the padding);
    ``doc_ids`` and ``pieces``: what each segment holds.  A document's
    ids are followed by ``end_id`` and cut only if longer than ``length``
    (only its first piece may be shorter).  (part, shard, sequence) is a
    key: the partition of ``docs``, a shard of it, a row of its matrix.

    A null text counts as empty (one end token); repeated rows and null
    ids are packed each for itself; other columns are not read; an empty
    table gives an empty result.
    """
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["part", "shard", "sequence", "n_tokens", "n_segments", "ids", "cu_seqlens", "positions", "doc_ids", "pieces", "ids_crc32"]
    ramp = np.arange(length, dtype="<u4")

    def shard_rows(part: int, shard: int, held: list, id_kind: pa.DataType):
        out = [[] for _ in names]
        for k, members in enumerate(best_fit_decreasing([len(x[2]) for x in held], length)):
            got = [held[i] for i in members]
            row, pos = np.full(length, pad_id, "<u4"), np.zeros(length, "<u4")
            ends = np.cumsum([len(x[2]) for x in got])
            for (_, _, ids), e in zip(got, ends):
                row[e - len(ids):e] = ids
                pos[e - len(ids):e] = ramp[:len(ids)]
            values = (part, shard, k, int(ends[-1]), len(got), row.tobytes(), [0, *ends.tolist()], pos.tobytes(),
                      [x[0] for x in got], [x[1] for x in got], crc(row[:ends[-1]]))
            for column, v in zip(out, values):
                column.append(v)
            if len(out[0]) == 2000:
                yield as_batch(out, id_kind)
                out = [[] for _ in names]
        if out[0]:
            yield as_batch(out, id_kind)

    def as_batch(columns: list, id_kind: pa.DataType) -> pa.RecordBatch:
        kinds = [pa.int64()] * 5 + [pa.binary(), pa.list_(pa.int32()), pa.binary(), pa.list_(id_kind), pa.list_(pa.int32()), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    def run(batches):
        part = TaskContext.get().partitionId()
        enc = bpe.encoder(path)
        shard, held, tokens, id_kind = 0, [], 0, pa.int64()
        for rows, texts in batch_slices(batches):
            id_kind = rows.schema.field(0).type
            for doc, ids in zip(rows.column(0).to_pylist(), enc.encode(texts.to_pylist())):
                for k, _, piece in pieces(ids, end_id, length):
                    held.append((doc, k, piece))
                    tokens += len(piece)
                if tokens >= shard_tokens:
                    yield from shard_rows(part, shard, held, id_kind)
                    shard, held, tokens = shard + 1, [], 0
        if held:
            yield from shard_rows(part, shard, held, id_kind)

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, SCHEMA.format(id=id_type))


def write_matrices(matrix: DataFrame, path: str) -> None:
    """Write the packed rows as Parquet at ``path`` (any store Spark can write), one folder per partition of the input."""
    matrix.write.mode("overwrite").parquet(path)

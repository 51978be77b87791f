"""Best-fit packing of token pieces by bin completion.

How many pieces there are of each length is all that the search needs,
and that table has at most ``length`` rows however large the corpus is.
The plan is found on it: patterns of piece lengths, each with the number
of sequences that follow it.  Around the largest remaining length,
undominated fillings of the rest are enumerated, those of least waste
first; a branch is pruned when its waste so far cannot lead to fewer
sequences than the incumbent, and best-fit decreasing gives the first
incumbent.  A pattern is repeated as often as the remaining counts
allow, so a plan has only a few thousand entries.

Spark then gives each piece its rank among the pieces of its length
(ranks within a partition, plus the counts of the partitions before), and
the plan maps (length, rank) to a sequence and an offset.
"""

from __future__ import annotations

import logging
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kiln.llm import bpe
from kiln.llm.common import materialised
from kiln.llm.pieces import crc, pieces
from kiln.llm.textcore import batch_slices

Plan = list[tuple[tuple[int, ...], int]]
#: Branches that are ended by best-fit decreasing once the nodes are used up.
ENDS = 200


def lower_bound(hist: dict[int, int], length: int) -> int:
    """No packing has fewer sequences: all tokens over the length; and, for any bound on what counts as small, pieces of more than
    half a sequence take one each, and what the room beside them cannot hold comes on top."""
    best = -(-sum(k * c for k, c in hist.items()) // length)
    for small in {k for k in hist if 2 * k <= length} | {0}:
        alone = sum(c for k, c in hist.items() if k > length - small)
        mid = [(k, c) for k, c in hist.items() if 2 * k > length and k <= length - small]
        room = sum((length - k) * c for k, c in mid)
        rest = sum(k * c for k, c in hist.items() if small <= k and 2 * k <= length)
        best = max(best, alone + sum(c for _, c in mid) + max(0, -(-(rest - room) // length)))
    return best


def best_fit_decreasing(hist: dict[int, int], length: int) -> Plan:
    """Best-fit decreasing over counts: alike sequences are handled as one group."""
    open_groups: dict[int, Counter] = {}
    for k in sorted(hist, reverse=True):
        left = hist[k]
        for room in sorted(r for r in open_groups if r >= k):
            groups = open_groups[room]
            fit = room // k
            for pattern in list(groups):
                if not left:
                    break
                m = groups.pop(pattern)
                full = min(m, left // fit)
                left -= full * fit
                moved = [(full, fit)]
                if full < m and left:
                    moved.append((1, left))
                    left = 0
                stay = m - sum(n for n, _ in moved)
                if stay:
                    groups[pattern] += stay
                for n, times in moved:
                    if n:
                        open_groups.setdefault(room - times * k, Counter())[pattern + (k,) * times] += n
            if not groups:
                del open_groups[room]
            if not left:
                break
        if left:
            fit = length // k
            if left // fit:
                open_groups.setdefault(length - fit * k, Counter())[(k,) * fit] += left // fit
            if left % fit:
                open_groups.setdefault(length - left % fit * k, Counter())[(k,) * (left % fit)] += 1
    return [(p, m) for groups in open_groups.values() for p, m in groups.items()]


def fillings(hist: dict[int, int], room: int, most: int, parts: int) -> list[tuple[int, ...]]:
    """Up to ``most`` undominated fillings of ``room`` with at most ``parts`` pieces, least waste first.

    A filling is dominated if a piece that is still there is as long as
    two of its pieces together (that piece alone would do as well).
    """
    sizes = sorted((k for k, c in hist.items() if c and k <= room), reverse=True)
    if not sizes:
        return [()]
    reach = [1]  # bit s of reach[i]: some i pieces are s tokens long together (counts aside)
    mask = (1 << (room + 1)) - 1
    for _ in range(parts):
        sums = 0
        for k in sizes:
            sums |= reach[-1] << k
        reach.append(sums & mask)
    found: list[tuple[int, ...]] = []
    used: Counter = Counter()
    steps = 0

    def build(total: int, n: int, largest: int, chosen: tuple[int, ...]) -> None:
        nonlocal steps
        steps += 1
        if len(found) >= most or steps > 4000:
            return
        if n == 0:
            if total == 0 and not any(a + b in present for i, a in enumerate(chosen) for b in chosen[i + 1:]):
                found.append(chosen)
            return
        for k in sizes:
            if k > largest or k > total:
                continue
            if k * n < total:
                break
            if used[k] < hist[k] and reach[n - 1] >> (total - k) & 1:
                used[k] += 1
                build(total - k, n - 1, k, chosen + (k,))
                used[k] -= 1
                if len(found) >= most:
                    return

    present = {k for k in sizes if hist[k]}
    for total in range(room, sizes[0] - 1, -1):
        for n in range(1, parts + 1):
            if reach[n] >> total & 1:
                build(total, n, room, ())
        if len(found) >= most:
            break
    return found[:most] or [(sizes[0],)]


def fullest(hist: dict[int, int], room: int, longest: bool = True) -> tuple[int, ...]:
    """The filling of ``room`` with any number of pieces that leaves the least waste, of the longest (or shortest) pieces first.

    Sums that the lengths yet to come reach are bits of a number, so a piece is taken only if it still leads to the best sum.
    """
    sizes = sorted((k for k, c in hist.items() if c and k <= room), reverse=longest)
    mask = (1 << (room + 1)) - 1
    reach = [1]  # by the number of lengths from the last on
    for k in reversed(sizes):
        sums, times, step = reach[-1], min(hist[k], room // k), 1
        while times:  # as many as there are, in doubling steps
            take = min(step, times)
            sums |= sums << (take * k)
            times, step = times - take, 2 * step
        reach.append(sums & mask)
    left, out = reach[-1].bit_length() - 1, []
    for i, k in enumerate(sizes):
        below = reach[len(sizes) - 1 - i]
        times = min(hist[k], left // k)
        while not below >> (left - times * k) & 1:
            times -= 1
        out += [k] * times
        left -= times * k
    return tuple(sorted(out, reverse=True))


def bin_completion(hist: dict[int, int], length: int, branches: int = 3, parts: int = 4, nodes: int = 3000) -> Plan:
    """Patterns with their multiplicities that hold every piece of the histogram.

    Fillings of up to ``parts`` pieces are enumerated; each is filled up
    with any number of shorter pieces, and the fullest filling of any
    number of pieces is tried as well, of the longest pieces first in one
    search and of the shortest in another.  ``nodes`` bounds each (every
    node completes all sequences around one largest length at once); past
    it, open branches end by best-fit decreasing.  The best plan found is
    kept, and never is worse than best-fit decreasing; the log says which
    of the two it is.
    """
    hist = {int(k): int(c) for k, c in hist.items() if c}
    if not hist:
        return []
    least = lower_bound(hist, length)
    best = best_fit_decreasing(hist, length)
    count = lambda plan: sum(m for _, m in plan)
    tokens = sum(k * c for k, c in hist.items())
    seen, longest = 0, True

    def descend(left: dict[int, int], plan: Plan, bins: int, waste: int) -> None:
        nonlocal best, seen
        if not left:
            if bins < count(best):
                best = list(plan)
            return
        seen += 1
        if count(best) == least:
            return
        if waste > (count(best) - 1) * length - tokens:  # this waste already costs a sequence more
            return
        if seen > nodes:
            if seen < nodes + ENDS:
                rest = best_fit_decreasing(left, length)
                if bins + count(rest) < count(best):
                    best = plan + rest
            return
        top = max(left)
        left[top] -= 1
        full = fullest(left, length - top, longest)
        options = fillings(left, length - top, branches, parts) if seen < nodes // 2 else []
        if sum(full) > max((sum(o) for o in options), default=-1) or not options:
            options = [full, *options]
        elif full not in options:
            options.append(full)
        left[top] += 1
        for rest in options:
            need = Counter((top, *rest))
            times = min(left[k] // c for k, c in need.items())
            if not times:
                continue
            after = dict(left)
            for k, c in need.items():
                after[k] -= times * c
                if not after[k]:
                    del after[k]
            pattern = (top, *rest)
            spare = length - sum(pattern)
            if rest and spare >= min(after, default=length + 1):  # still room: fill it up with the longest that fit
                fill = fullest(after, spare, longest)
                if fill:
                    pattern = pattern + fill
                    need = Counter(pattern)
                    times = min(left[k] // c for k, c in need.items())
                    if not times:
                        continue
                    after = dict(left)
                    for k, c in need.items():
                        after[k] -= times * c
                        if not after[k]:
                            del after[k]
                    spare = length - sum(pattern)
            plan.append((pattern, times))
            descend(after, plan, bins + times, waste + spare * times)
            plan.pop()

    first = count(best)
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(max(limit, 20_000))
    try:
        for longest in (True, False):  # the second search takes the shortest pieces beside the longest
            seen = 0
            descend(dict(hist), [], 0, 0)
    finally:
        sys.setrecursionlimit(limit)
    logging.getLogger(__name__).info("%s: %d sequences, best-fit decreasing %d, at least %d",
                                     "bin completion" if count(best) < first else "best-fit decreasing", count(best), first, least)
    return best


class Slots:
    """The place of the r-th piece of each length under a plan."""

    def __init__(self, plan: Plan):
        rows, taken, sequence = [], Counter(), 0
        for pattern, times in plan:
            offset = 0
            for k in pattern:
                rows.append((k, taken[k], sequence, offset))
                taken[k] += times
                offset += k
            sequence += times
        rows.sort()
        a = np.array(rows, np.int64).reshape(-1, 4)
        self.key, self.rank, self.sequence, self.offset = (a[:, 0] << 44) + a[:, 1], a[:, 1], a[:, 2], a[:, 3]

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (lengths << 44) + ranks, "right") - 1
        return self.sequence[at] + ranks - self.rank[at], self.offset[at]


def token_pieces(docs: DataFrame, path: str, length: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: one row per piece of every document (a null text is empty: one end token)."""
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long"

    def run(batches):
        enc = bpe.encoder(path)
        for rows, texts in batch_slices(batches):
            out = [(i, k, s, len(ids), crc(ids)) for i, doc in enumerate(enc.encode(texts.to_pylist()))
                   for k, s, ids in pieces(doc, end_id, length)]
            at, piece, start, n, crcs = (np.array(c, np.int64) for c in zip(*out))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0).take(pa.array(at)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(n), pa.array(crcs)],
                [id_col, "piece", "start", "length", "ids_crc32"])

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents into sequences of at most ``length`` tokens, whole pieces only.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset.
    Null and empty texts are one end token; rows with equal or null ids
    are packed each for itself; an empty table gives an empty result;
    other columns are not read.  Ties among pieces of one length are
    settled by (id, piece) within the partition that tokenised them.
    """
    rows = materialised(token_pieces(docs, path, length, end_id, id_col, text_col))
    rows = rows.withColumn("_part", F.spark_partition_id())
    counts = rows.groupBy("_part", "length").agg(F.count(F.lit(1)).alias("_n"))
    hist = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most `length` rows
    slots = docs.sparkSession.sparkContext.broadcast(Slots(bin_completion(hist, length)))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_part")) - F.col("_n")).drop("_n")
    local = F.row_number().over(Window.partitionBy("_part", "length").orderBy(id_col, "piece", "ids_crc32")).cast("long") - 1
    ranked = rows.withColumn("_rank", local).join(before, ["_part", "length"]).select(
        id_col, "piece", "start", "length", "ids_crc32", (F.col("_rank") + F.col("_before")).alias("_rank"))
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, "
              "sequence_id long, offset long")

    def place(batches):
        for b in batches:
            seq, off = slots.value.place(b.column(3).to_numpy(), b.column(5).to_numpy())
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(seq), pa.array(off)], [*b.schema.names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)

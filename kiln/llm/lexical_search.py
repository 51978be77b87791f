"""Ranked lexical search over a length-stratified index.

Scores depend on a document only through its length normaliser m and the
counts (tf) of the query's terms, so documents are grouped by equal m and
postings inside a stratum by (term, tf): the impact of a term is computed
once per tf, not once per posting.

1. Tasks read each text once and keep the counts of the queries' terms: a
   forward index, written to the shared checkpoint folder, from which the
   collection's counts (N, L, df) are summed.
2. The index is dealt by ranges of (m, hash of the id) and sorted by m.
   Each run of at most ``SEGMENT`` documents of one m becomes a segment:
   its runs of postings and, for each query, a bound on any score in it.
   A stratum of any size is cut into many segments, so none is gathered.
3. For each query the segment of the best bound is visited first; its k-th
   score is a threshold. Tasks then visit their segments in the order of
   bounds, skip the queries whose bound stays under the threshold, raise
   it as they go and send at most k documents per query.

Queries come in blocks of at most ``BLOCK_PAIRS`` (query, term) pairs (or
one query), whose vocabulary is broadcast; each block reads the texts once.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from kiln.functions.frames import prefix_sum
from kiln.llm.common import materialised

SEGMENT = 4096           # documents
BLOCK_PAIRS = 1 << 16    # (query, term) pairs whose vocabulary tasks hold at once
_QUERIES_AT_ONCE = 256   # rows of a score table: 256 x 4096 doubles, 8 MB
_EXPANDED = 1 << 21      # (posting, query) pairs handled at once

#: Separators become blanks, A-Z small; bytes of other characters stay.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x40 or 0x5B <= b <= 0x60 or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b
              for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    """The terms of a text in UTF-8: letters A-Z in lower case, digits and everything beyond ASCII."""
    return [] if text is None else text.translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def impact(tf, m):
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Queries:
    """A block of queries: their distinct terms and (query, term, count) pairs sorted by term."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        self.ids = sorted({q for q, _, _ in rows})
        self.vocabulary = {t: i for i, t in enumerate(sorted({t for _, t, _ in rows}))}
        place = {q: i for i, q in enumerate(self.ids)}
        pairs = np.array(sorted((self.vocabulary[t], place[q], n) for q, t, n in rows), dtype=np.int64).reshape(-1, 3)
        self.term, self.query, self.times = pairs[:, 0], pairs[:, 1], pairs[:, 2]
        self.weighted = np.zeros(len(pairs), dtype=np.int64)

    def weigh(self, weights: np.ndarray) -> None:
        """Adds the terms' weights, one per vocabulary entry."""
        self.weighted = weights[self.term] * self.times

    def bounds(self, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
        """For each query the largest score that documents with at most these impacts of these terms can have."""
        best = np.zeros(len(self.vocabulary), dtype=np.int64)
        best[terms] = impacts
        return np.bincount(self.query, (self.weighted * best[self.term]).astype(float), minlength=len(self.ids)).astype(np.int64)

    def scores(self, segment: dict, queries: np.ndarray) -> np.ndarray:
        """(queries, documents) scores.  Sums are exact: they stay under 2^53."""
        docs, m = segment["size"], segment["m"]
        wanted = np.full(len(self.ids), -1)
        wanted[queries] = np.arange(len(queries))
        at = np.flatnonzero(wanted[self.query] >= 0)
        term, row, worth = self.term[at], wanted[self.query[at]], self.weighted[at].astype(float)
        tfs, which = np.unique(segment["run_tf"], return_inverse=True)
        run_impact = impact(tfs, m)[which].astype(float)  # once per tf
        first, last = np.searchsorted(term, segment["run_term"], "left"), np.searchsorted(term, segment["run_term"], "right")
        run = np.repeat(np.arange(len(tfs[which])), segment["run_len"])
        each = (last - first)[run]
        out = np.zeros(len(queries) * docs)
        ends = np.cumsum(each)
        lo = 0
        while lo < len(run):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _EXPANDED, "right")))
            n, r = each[lo:hi], run[lo:hi]
            total = int(n.sum())
            if total:
                pair = np.repeat(first[r] - (np.cumsum(n) - n), n) + np.arange(total)
                cell = row[pair] * docs + np.repeat(segment["post"][lo:hi], n)
                out += np.bincount(cell, np.repeat(run_impact[r], n) * worth[pair], minlength=len(out))
            lo = hi
        return out.reshape(len(queries), docs)


# ------------------------------------------------------------- queries and forward index

def _query_terms(items: DataFrame, text: str) -> DataFrame:
    """(q, term, times) of every row of ``items`` (with a number ``q``)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(q, t, n) for q, x in zip(b["q"].to_pylist(), b["x"].cast(pa.binary()).to_pylist()) for t, n in Counter(terms_of(x)).items()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 3, (pa.int64(), pa.binary(), pa.int64()))],
                                             names=["q", "term", "times"])

    return items.select("q", F.col("x")).mapInArrow(count, "q long, term binary, times long")


def _blocks(pairs: DataFrame, block_pairs: int) -> Iterator[list[tuple[int, bytes, int]]]:
    sizes = pairs.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    if total <= block_pairs:
        yield [tuple(r) for r in pairs.collect()]
        return
    at = materialised(prefix_sum(sizes, ["q"], "n", "cum").select("q", F.floor((F.col("cum") - F.col("n")) / block_pairs).alias("block")))
    dealt = materialised(pairs.join(at, "q"))
    for b in range(-(-total // block_pairs)):
        rows = [tuple(r) for r in dealt.where(F.col("block") == b).select("q", "term", "times").collect()]
        if rows:
            yield rows


def _forward_index(docs: DataFrame, key: str, text: str, queries: Queries) -> DataFrame:
    """(key, n, terms, tfs): length in terms and the counts of the queries' terms of every document with a term."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(queries.vocabulary)
    kind = docs.schema[key].dataType

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = vocabulary.value.get
        for b in batches:
            n, terms, tfs, ends, rows = [], [], [], [0], []
            for i, x in enumerate(b["x"].cast(pa.binary())):
                found = terms_of(x.as_py())
                if not found:
                    continue
                counts = Counter(map(number, found))
                counts.pop(None, None)
                rows.append(i)
                n.append(len(found))
                terms.extend(counts.keys())
                tfs.extend(counts.values())
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b["k"].take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], names=["k", "n", "terms", "tfs"])

    schema = T.StructType([T.StructField("k", kind), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())),
                           T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    return materialised(docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").cast("string").alias("x")).mapInArrow(count, schema))


# ------------------------------------------------------------- segments

def _segments(index: DataFrame, queries, rows: int, segment: int) -> DataFrame:
    """(m, size, keys, run_term, run_tf, run_len, post, bounds): the stratified index, ``index`` having (k, m, terms, tfs)."""
    spark = index.sparkSession
    kind = index.schema["k"].dataType
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // (4 * segment)))
    dealt = index.repartitionByRange(parts, F.col("m"), F.xxhash64("k")).sortWithinPartitions(F.col("m"), F.col("k").asc_nulls_last())
    held = spark.sparkContext.broadcast(queries)
    key_type = to_arrow_type(kind)
    names = ["m", "size", "keys", "run_term", "run_tf", "run_len", "post", "bounds"]

    def build(m: int, parts: list[tuple]) -> pa.RecordBatch:
        keys = pa.concat_arrays([p[0] for p in parts])
        lens, terms, tfs = (np.concatenate([p[i] for p in parts]) for i in (1, 2, 3))
        doc = np.repeat(np.arange(len(keys)), lens)
        order = np.lexsort((doc, tfs, terms))
        terms, tfs, doc = terms[order], tfs[order], doc[order]
        new = np.flatnonzero(np.diff(terms, prepend=-1) | np.diff(tfs, prepend=-1)) if len(terms) else np.zeros(0, np.int64)
        run_term, run_tf, run_len = terms[new], tfs[new], np.diff(np.append(new, len(terms)))
        top = np.flatnonzero(np.diff(run_term, append=-1))  # a term's last run has its largest tf
        bounds = held.value.bounds(run_term[top], impact(run_tf[top].astype(np.int64), m))
        cells = [pa.array([x.astype(t).tobytes()], pa.binary()) for x, t in ((run_term, "<i4"), (run_tf, "<i4"), (run_len, "<i4"), (doc, "<u2"))]
        return pa.RecordBatch.from_arrays(
            [pa.array([m], pa.int64()), pa.array([len(keys)], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys), *cells,
             pa.array([bounds], pa.list_(pa.int64()))], names=names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, parts, size = None, [], 0
        for b in batches:
            ms = b["m"].to_numpy()
            starts = np.flatnonzero(np.diff(ms, prepend=-1))
            for s, e in zip(starts, np.append(starts[1:], len(ms))):
                if ms[s] != m and parts:
                    yield build(m, parts)
                    parts, size = [], 0
                m = int(ms[s])
                while s < e:
                    here = min(e - s, segment - size)
                    terms, tfs = b["terms"].slice(s, here), b["tfs"].slice(s, here)
                    parts.append((b["k"].slice(s, here).cast(key_type), np.diff(terms.offsets.to_numpy()), terms.flatten().to_numpy(), tfs.flatten().to_numpy()))
                    size, s = size + here, s + here
                    if size == segment:
                        yield build(m, parts)
                        parts, size = [], 0
        if parts:
            yield build(m, parts)

    schema = T.StructType([T.StructField("m", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("keys", T.ArrayType(kind)),
                           *[T.StructField(c, T.BinaryType()) for c in names[3:7]], T.StructField("bounds", T.ArrayType(T.LongType()))])
    return materialised(dealt.select("m", "k", "terms", "tfs").mapInArrow(cut, schema))


def _visit(segments: DataFrame, queries, least, k: int, kind: T.DataType) -> DataFrame:
    """(q, key, score): of each task's segments at most k documents per query, scores of ``least`` (by query) or more.

    Segments come in the order of their bounds; those with a column ``only`` are visited for these queries.
    """
    limit = segments.sparkSession.sparkContext.broadcast(least)
    key_type = to_arrow_type(kind)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = queries.value
        floor = np.maximum(limit.value, 1)
        best: dict[int, list] = {}
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b[c][i] for c in b.schema.names}
                seg = {"m": r["m"].as_py(), "size": r["size"].as_py(), "post": np.frombuffer(r["post"].as_py(), "<u2").astype(np.int64)}
                seg |= {c: np.frombuffer(r[c].as_py(), "<i4").astype(np.int64) for c in ("run_term", "run_tf", "run_len")}
                open_ = r["bounds"].values.to_numpy() >= floor
                if "only" in r:
                    asked = np.zeros(len(floor), bool)
                    asked[r["only"].values.to_numpy()] = True
                    open_ &= asked
                todo = np.flatnonzero(open_)
                for lo in range(0, len(todo), _QUERIES_AT_ONCE):
                    some = todo[lo:lo + _QUERIES_AT_ONCE]
                    table = q.scores(seg, some)
                    for j in np.flatnonzero((table >= floor[some][:, None]).any(axis=1)):
                        row, at = table[j], int(some[j])
                        cand = np.flatnonzero(row >= floor[at])
                        if len(cand) > k:
                            cand = cand[row[cand] >= np.partition(row[cand], -k)[-k]]
                        cand = cand[np.lexsort((cand, -row[cand]))[:k]]  # documents of a segment are in the order of their keys
                        keys = [r["keys"].values[int(d)].as_py() for d in cand]
                        new = [(-int(row[d]), x is None, x) for d, x in zip(cand, keys)]
                        held = best[at] = sorted(best.get(at, []) + new, key=lambda e: (e[0], e[1], 0 if e[2] is None else e[2]))[:k]
                        if len(held) == k:
                            floor[at] = -held[-1][0]
        out = [(q.ids[a], e[2], -e[0]) for a, es in best.items() for e in es]
        for lo in range(0, len(out), 10_000):
            part = list(zip(*out[lo:lo + 10_000]))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], key_type), pa.array(part[2], pa.int64())], names=["q", "key", "score"])

    schema = T.StructType([T.StructField("q", T.LongType()), T.StructField("key", kind), T.StructField("score", T.LongType())])
    return segments.mapInArrow(look, schema)


def _search_block(docs: DataFrame, key: str, text: str, queries: Queries, k: int, segment: int) -> DataFrame | None:
    spark = docs.sparkSession
    index = _forward_index(docs, key, text, queries)
    kind = index.schema["k"].dataType
    total = index.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).first()
    if not total["docs"]:
        return None
    n_docs, length = int(total["docs"]), int(total["terms"])
    df = np.zeros(len(queries.vocabulary), dtype=np.int64)
    for r in index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per vocabulary entry at most
        df[r["t"]] = r["n"]
    queries.weigh(np.array([weight(n_docs, int(d)) for d in df], dtype=np.int64))
    stratum = (F.lit(25) + F.expr(f"(75L * n * {n_docs}L) div {length}L")).cast("long")
    segments = _segments(index.where("size(terms) > 0").withColumn("m", stratum), queries, n_docs, segment)
    held = spark.sparkContext.broadcast(queries)

    # the first visit: for each query the segment of the largest bound among those with documents enough
    numbered = segments.withColumn("seg", F.monotonically_increasing_id())
    bounds = numbered.where(F.col("size") >= 2 * k).select("seg", F.posexplode("bounds").alias("at", "bound"))
    best = bounds.where("bound > 0").groupBy("at").agg(F.max(F.struct("bound", "seg")).alias("b"))
    first = best.groupBy(F.col("b.seg").alias("_seg")).agg(F.collect_list("at").alias("only"))  # at most one row per query
    visited = numbered.join(F.broadcast(first), F.col("seg") == F.col("_seg")).drop("seg", "_seg")
    least = np.zeros(len(queries.ids), dtype=np.int64)
    place = {q: i for i, q in enumerate(queries.ids)}
    scored = _visit(visited, held, least, k, kind).groupBy("q").agg(F.sort_array(F.collect_list("score"), asc=False).alias("s"))  # k scores at most
    for r in scored.where(F.size("s") >= k).select("q", F.col("s")[k - 1].alias("s")).collect():
        least[place[r["q"]]] = r["s"]

    ordered = segments.sortWithinPartitions(F.array_max("bounds").desc())
    return _visit(ordered, held, least, k, kind)


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text",
           block_pairs: int = BLOCK_PAIRS, segment: int = SEGMENT) -> DataFrame:
    """For every row of ``items`` its ``k`` documents of highest score above 0: item, rank (from 1), key, score.

    Equal scores go by ascending key, null keys last.  A null text has no
    terms; documents and items without terms find nothing, nor do terms
    that no document holds.  Rows of equal ids are documents (items) of
    their own.  An empty table gives no rows; other columns are not read.
    """
    if segment > 1 << 16:
        raise ValueError("a segment holds at most 65,536 documents")
    numbered = materialised(items.select(F.col(f"`{item}`").alias("_item"), F.col(f"`{item_text}`").cast("string").alias("x"),
                                         F.monotonically_increasing_id().alias("q")))
    found = None
    for rows in _blocks(materialised(_query_terms(numbered, "x")), block_pairs):
        part = _search_block(docs, key, text, Queries(rows), k, segment) if rows else None
        if part is not None:
            found = part if found is None else found.unionByName(part)
    if found is None:
        schema = T.StructType([T.StructField(item, items.schema[item].dataType), T.StructField("rank", T.IntegerType()),
                               T.StructField(key, docs.schema[key].dataType), T.StructField("score", T.LongType())])
        return docs.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), F.col("key").asc_nulls_last()))
    top = found.withColumn("rank", place).where(F.col("rank") <= k)
    return top.join(numbered.select("q", "_item"), "q").select(F.col("_item").alias(item), "rank", F.col("key").alias(key), "score")

"""BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last code points hits a pattern,
so passages that documents share fall into equal chunks wherever they
stand.  Chunk names are counted over the corpus; the chunks that repeat
most are encoded once into a dictionary of bounded size that all tasks
get, and a task encodes any other chunk once for all its documents.

A cut may fall inside a word, so each join of two chunks is repaired: a
window of whole cells (stretches without white space) around the join is
encoded again, and taken over only if its outermost cells come out exactly
as the two chunks have them; otherwise the window is widened, at last to
both chunks.  White space separates cells for this vocabulary, so agreeing
outer cells make everything beyond them agree too.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kiln.llm import bpe
from kiln.llm.textcore import batch_slices, mix

WINDOW, MASK_BITS, LEAST, MOST = 16, 10, 256, 8192
DICTIONARY_CHARS = 16_000_000  # bound of the shared dictionary, in code points of its chunks
DICTIONARY_ENTRIES = 16_384
TASK_CACHE_CHARS = 8_000_000


def cut_points(text: str) -> list[int]:
    """Ends of the chunks of a text: content-defined, LEAST to MOST code points each (the last may be shorter)."""
    n = len(text)
    if n <= LEAST:
        return [n] if n else []
    cp = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    g = mix(cp.astype(np.uint64) + np.uint64(0xA5A5)).astype(np.uint32)
    width = 1
    while width < WINDOW:  # the hash of the last 2 * width code points from two of the last width
        older = np.zeros_like(g)
        older[width:] = g[:-width]
        g = g + (older << np.uint32(width))
        width *= 2
    hits = np.flatnonzero((g >> np.uint32(32 - MASK_BITS)) == 0) + 1
    out, last = [], 0
    for h in hits.tolist():
        while h - last > MOST:
            last += MOST
            out.append(last)
        if h - last >= LEAST and n - h > 0:
            out.append(h)
            last = h
    while n - last > MOST:
        last += MOST
        out.append(last)
    out.append(n)
    return out


def chunk_name(chunk: str) -> bytes:
    return hashlib.blake2b(chunk.encode(), digest_size=16).digest()


class Encoded:
    """Token ids of one stretch of text, and its cells: begin, end (code points) and number of tokens before each."""

    __slots__ = ("ids", "begin", "end", "before", "size")

    def __init__(self, ids, begin, end, before, size):
        self.ids, self.begin, self.end, self.before, self.size = ids, begin, end, before, size

    def cell(self, k: int) -> bytes:
        return self.ids[self.before[k]:self.before[k + 1]].tobytes()


def encode_stretches(enc: bpe.Encoder, texts: list[str]) -> list[Encoded]:
    """Each text alone, with its cells.  The texts hold no special string and are in normal form (see Encoder.library_only)."""
    if not texts:
        return []
    start, end, owner, code, uniq, strings = enc.segment(texts)
    place, number = enc.lookup(uniq, strings)
    ids = enc.gather(code, place, number).astype(np.uint16 if enc.lib.get_vocab_size() <= 65536 else np.uint32)
    upto = np.concatenate([[0], np.cumsum(number[code])])
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != end[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1 if len(first) else first
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    base = np.cumsum(sizes + 1) - sizes - 1
    cell_of = owner[first]
    cuts = np.searchsorted(cell_of, np.arange(len(texts) + 1))
    begin, stop, before = start[first] - base[cell_of], end[last] - base[cell_of], upto[first]
    words = np.searchsorted(owner, np.arange(len(texts) + 1))
    out = []
    for t in range(len(texts)):
        a, b = cuts[t], cuts[t + 1]
        lo, hi = int(upto[words[t]]), int(upto[words[t + 1]])
        out.append(Encoded(ids[lo:hi], begin[a:b].astype(np.uint32), stop[a:b].astype(np.uint32),
                           np.append(before[a:b] - lo, hi - lo).astype(np.uint32), int(sizes[t])))
    return out


def join_windows(enc: bpe.Encoder, pairs: list[tuple[str, Encoded, str, Encoded]]) -> list[tuple[int, int, np.ndarray] | None]:
    """For each two neighbouring chunks: (tokens to keep of the left one, tokens to skip of the right one, ids between); None if only
    encoding both anew can tell."""
    out: list = [None] * len(pairs)
    todo = [(i, 2) for i in range(len(pairs))]
    while todo:
        windows = []
        for i, k in todo:
            lt, le, rt, re_ = pairs[i]
            a, b = len(le.begin) - k, k - 1
            windows.append(None if a < 1 or b >= len(re_.begin) - 1 else lt[int(le.begin[a]):] + rt[:int(re_.end[b])])
        got = iter(encode_stretches(enc, [w for w in windows if w is not None]))
        again = []
        for (i, k), w in zip(todo, windows):
            if w is None:
                continue
            _, le, _, re_ = pairs[i]
            e = next(got)
            a, b = len(le.begin) - k, k - 1
            # the outermost cells of the window end at white space, inside the left and right chunk
            if len(e.begin) >= 2 and e.cell(0) == le.cell(a) and e.cell(len(e.begin) - 1) == re_.cell(b) \
                    and int(e.end[0]) == int(le.end[a] - le.begin[a]):
                out[i] = (int(le.before[a]), int(re_.before[b + 1]), e.ids)
            else:
                again.append((i, 2 * k))
        todo = again
    return out


class ChunkCoder:
    """Encodes whole documents through chunks; keeps the chunks of the shared dictionary and the last ones of this task."""

    def __init__(self, path: str, shared: dict[bytes, Encoded]):
        self.enc = bpe.encoder(path)
        self.shared, self.own, self.held = shared, OrderedDict(), 0

    def _chunks(self, chunks: list[str]) -> list[Encoded]:
        names = [chunk_name(c) for c in chunks]
        fresh: dict[bytes, str] = {}
        for n, c in zip(names, chunks):
            if n not in self.shared and n not in self.own and n not in fresh:
                fresh[n] = c
        made = dict(zip(fresh, encode_stretches(self.enc, list(fresh.values()))))
        out = [self.shared.get(n) or made.get(n) or self.own[n] for n in names]
        for n, e in made.items():
            self.own[n] = e
            self.held += e.size
        while self.held > TASK_CACHE_CHARS:
            self.held -= self.own.popitem(last=False)[1].size
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without added special tokens."""
        out: list = [None] * len(texts)
        whole = [i for i, t in enumerate(texts) if self.enc.library_only(t)]
        for i, ids in zip(whole, self.enc.encode([texts[i] for i in whole])):
            out[i] = ids
        chunks, spans = [], []
        for i, t in enumerate(texts):
            if out[i] is None:
                ends = cut_points(t)
                spans.append((i, len(chunks), len(ends)))
                chunks += [t[a:b] for a, b in zip([0, *ends], ends)]
        coded = self._chunks(chunks)
        joins = {}
        at = [k for _, first, n in spans for k in range(first, first + n - 1)]
        for k, j in zip(at, join_windows(self.enc, [(chunks[k], coded[k], chunks[k + 1], coded[k + 1]) for k in at])):
            joins[k] = j
        redo = []
        for i, first, n in spans:
            if n == 0:
                out[i] = np.empty(0, np.uint32)
                continue
            parts, skip, fine = [], 0, True
            for k in range(first, first + n):
                ids = coded[k].ids
                if k == first + n - 1:
                    parts.append(ids[skip:])
                    break
                j = joins[k]
                if j is None or j[0] < skip:
                    fine = False
                    break
                parts += [ids[skip:j[0]], j[2]]
                skip = j[1]
            if fine:
                out[i] = np.concatenate(parts).astype(np.uint32)
            else:
                redo.append(i)
        for i, ids in zip(redo, self.enc.encode([texts[i] for i in redo])):  # windows as wide as the document
            out[i] = ids
        return out


class Decoder:
    """Ids to text as the library's decode without skipping special tokens: for a vocabulary without a decoder, names joined by blanks."""

    def __init__(self, path: str):
        lib = bpe.load(path)
        self.lib = lib
        n = lib.get_vocab_size()
        probe = lib.decode([0, n - 1, 1], skip_special_tokens=False)
        names = [lib.id_to_token(i) for i in range(n)]
        self.joined = all(x is not None for x in names) and probe == " ".join([names[0], names[n - 1], names[1]])
        self.names = np.array(names, object)

    def decode(self, ids: np.ndarray) -> str:
        if self.joined:
            return " ".join(self.names[ids].tolist())
        return self.lib.decode(ids.tolist(), skip_special_tokens=False)


@lru_cache(2)
def _decoder(path: str) -> Decoder:
    return Decoder(path)


def shared_chunks(docs: DataFrame, path: str, text_col: str = "text", most_chars: int = DICTIONARY_CHARS,
                  most_entries: int = DICTIONARY_ENTRIES) -> dict[bytes, Encoded]:
    """The chunks that occur most often in the corpus (twice at least), encoded once each.

    Chunk names are counted over all documents.  The dictionary is bounded
    by both limits, whatever the size of the corpus; chunks beyond it are
    encoded by the tasks that meet them.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(text_col).alias("text"))

    def names(batches):
        for _, part in batch_slices(batches):
            seen: dict[bytes, list] = {}
            for t in part.to_pylist():
                ends = cut_points(t)
                for a, b in zip([0, *ends], ends):
                    if b - a >= LEAST:
                        seen.setdefault(chunk_name(t[a:b]), [0, b - a])[0] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([c for c, _ in seen.values()], pa.int64()),
                                              pa.array([n for _, n in seen.values()], pa.int64())], ["name", "uses", "chars"])

    counted = texts.mapInArrow(names, "name binary, uses long, chars long").groupBy("name").agg(F.sum("uses").alias("uses"),
                                                                                                F.max("chars").alias("chars"))
    top = counted.where("uses > 1").orderBy(F.desc(F.col("uses") * F.col("chars")), "name").limit(most_entries).collect()
    chosen, chars = set(), 0
    for r in top:
        if chars + r["chars"] > most_chars:
            break
        chosen.add(bytes(r["name"]))
        chars += r["chars"]
    if not chosen:
        return {}
    wanted = spark.sparkContext.broadcast(chosen)

    def strings(batches):
        sent: set[bytes] = set()
        for _, part in batch_slices(batches):
            got = {}
            for t in part.to_pylist():
                ends = cut_points(t)
                for a, b in zip([0, *ends], ends):
                    if b - a >= LEAST and (n := chunk_name(t[a:b])) in wanted.value and n not in sent:
                        sent.add(n)
                        got[n] = t[a:b]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.string())], ["name", "text"])

    def once(batches):
        enc = bpe.encoder(path)
        for b in batches:
            rows = [(n, t) for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if not enc.library_only(t)]
            coded = encode_stretches(enc, [t for _, t in rows])
            arrays = [[n for n, _ in rows], [e.ids.tobytes() for e in coded], [e.begin.tobytes() for e in coded],
                      [e.end.tobytes() for e in coded], [e.before.tobytes() for e in coded]]
            yield pa.RecordBatch.from_arrays([*(pa.array(a, pa.binary()) for a in arrays), pa.array([e.size for e in coded], pa.int64())],
                                             ["name", "ids", "first", "stop", "before", "size"])

    coded = texts.mapInArrow(strings, "name binary, text string").groupBy("name").agg(F.first("text").alias("text")).select("name", "text") \
        .mapInArrow(once, "name binary, ids binary, first binary, stop binary, before binary, size long").toArrow()
    kind = np.uint16 if bpe.load(path).get_vocab_size() <= 65536 else np.uint32
    return {n: Encoded(np.frombuffer(i, kind), *(np.frombuffer(x, np.uint32) for x in rest), size)
            for n, i, *rest, size in zip(*(c.to_pylist() for c in coded.columns))}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit), decoded_sha256 for every row.

    A null text counts as empty (no ids, empty decoded text); repeated rows
    and null ids are kept; other columns are not read; an empty table gives
    an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(shared_chunks(docs, path, text_col))
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]

    def run(batches):
        coder, decoder = ChunkCoder(path, shared.value), _decoder(path)
        for rows, texts in batch_slices(batches):
            ids = coder.encode(texts.to_pylist())
            yield pa.RecordBatch.from_arrays([
                rows.column(0), pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(np.ascontiguousarray(x, "<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(decoder.decode(x).encode()).hexdigest() for x in ids], pa.string())], names)

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)

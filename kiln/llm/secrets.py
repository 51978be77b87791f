"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A run of at least ``min_run`` key characters, or a part of it between
separators, is a *random* string if a tiktoken vocabulary needs so many
tokens for it that a token covers fewer than ``max_chars_per_token``
characters: words compress to four or more characters a token, random
strings, of one class of characters or more, to less than two.  Known
digests (hex of the usual lengths), UUIDs, plain numbers and identifiers
whose words compress are excluded.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from kiln.llm import bpe
from kiln.llm.textcore import LOWER, batch_slices, raw_bytes

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
DIGEST_LENGTHS = (32, 40, 48, 56, 64, 96, 128)
UUID = re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}")
NAME = re.compile(r"[A-Za-z]*[0-9]{0,4}")
PART = re.compile(r"[^+/=_-]+")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HEX, _ACCESS, _KEY = _table(_DIGITS + "abcdef"), _table(_DIGITS + _UP), _table(_DIGITS + _LOW + _UP + "+/=_-")


@lru_cache(2)
def _tiktoken(path: str):
    import base64

    import tiktoken
    from public_tokenizers import PATTERN
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def known(run: str) -> bool:
    """Digests, UUIDs and numbers: strings that look dense but are no secrets."""
    return bool(DIGEST.fullmatch(run) and len(run) in DIGEST_LENGTHS or UUID.fullmatch(run.strip("-_="))) or not any(c.isalpha() for c in run)


def is_random(run: str, enc, max_chars_per_token: float) -> bool:
    """Whether the vocabulary finds no words in a string, nor in its parts if it looks like an identifier."""
    if known(run) or len(run) >= max_chars_per_token * len(enc.encode_ordinary(run)):
        return False
    parts = [p for p in re.split(r"[+/=_-]+|(?<=[a-z])(?=[A-Z])", run) if p]
    size = sum(map(len, parts))
    named = len(parts) > 1 and all(NAME.fullmatch(p) and len(p) < 20 for p in parts) and size / len(parts) >= 4
    return not named or size < max_chars_per_token * sum(len(enc.encode_ordinary(p)) for p in parts)


def random_spans(run: str, enc, min_run: int, max_chars_per_token: float) -> list[tuple[int, int]]:
    """The whole run if it is random, else its random parts, and what is random between those."""
    if is_random(run, enc, max_chars_per_token):
        return [(0, len(run))]
    parts = [m.span() for m in PART.finditer(run) if min_run <= len(m[0]) < len(run) and is_random(m[0], enc, max_chars_per_token)]
    cuts = [0, *(x for span in parts for x in span), len(run)]
    rest = [(a, z) for a, z in zip(cuts[::2], cuts[1::2]) if parts and z - a >= min_run and is_random(run[a:z], enc, max_chars_per_token)]
    return sorted(parts + rest)


def _runs(flags: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the maximal flagged runs of at least ``least`` bytes, not across texts."""
    n = len(flags)
    if n < least:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    start = flags.copy()
    start[1:] &= ~flags[:-1] | edge[1:n]
    end = flags.copy()
    end[:-1] &= ~flags[1:] | edge[1:n]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    keep = b - a >= least
    return a[keep], b[keep]


def scan_texts(texts: pa.LargeStringArray, vocab: str, min_run: int = 16, max_chars_per_token: float = 2.2,
               ) -> dict[int, list[tuple[int, int, int]]]:
    """Spans (start, kind, end) of each text that has any, sorted; code points, end exclusive."""
    b, off = raw_bytes(texts)
    found: dict[int, list[tuple[int, int, int]]] = {}
    if not len(b):
        return found
    chars = np.concatenate([[0], np.cumsum((b & 0xC0) != 0x80)])

    def add(kind: int, spans) -> None:
        for s, e in spans:
            t = int(np.searchsorted(off, s, "right")) - 1
            found.setdefault(t, []).append((int(chars[s] - chars[off[t]]), kind, int(chars[e] - chars[off[t]])))

    low = LOWER[b].tobytes()
    hits = set()
    for word in KEYWORDS:
        at = low.find(word)
        while at >= 0:
            t = int(np.searchsorted(off, at, "right")) - 1
            hits.add(t)
            at = low.find(word, int(off[t + 1]))
    for t in hits:
        spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(texts[t].as_py()) if len(m[2]) >= 6]
        if spans:
            found.setdefault(t, []).extend(spans)
    raw = b.tobytes()
    if b"AKIA" in raw:
        access = []
        for s, e in zip(*_runs(_ACCESS[b], off, 20)):
            at = raw.find(b"AKIA", s, e)
            if at >= 0 and e - at >= 20:
                access.append((at, e))
        add(1, access)
    add(2, zip(*_runs(_HEX[b], off, 24)))
    enc = None
    for s, e in zip(*_runs(_KEY[b], off, min_run)):
        run = raw[s:e].decode("ascii")
        if known(run):
            continue
        enc = enc or _tiktoken(vocab)
        t = int(np.searchsorted(off, s, "right")) - 1
        at = int(chars[s] - chars[off[t]])
        for a, z in random_spans(run, enc, min_run, max_chars_per_token):
            if not any(x <= at + a and at + z <= y for x, _, y in found.get(t, ())):
                found.setdefault(t, []).append((at + a, 3, at + z))
    return {t: sorted(spans) for t, spans in found.items()}


def _joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans for every row.

    A null text counts as empty: no spans, and base_sha256 of the empty
    string.  Repeated rows and null ids are kept; other columns are not
    read; an empty table gives an empty result.
    """
    schema = (f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_assign long, n_access long, n_hex long, "
              "n_random long, base_sha256 string, spans string")
    names = [id_col, "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"]

    def run(batches):
        for rows, texts in batch_slices(batches):
            found = scan_texts(texts, vocab)
            each = [found.get(i, ()) for i in range(len(texts))]
            counts = [pa.array([sum(x[1] == k for x in s) for s in each], pa.int64()) for k in range(4)]
            digest = pa.array([hashlib.sha256(_joined([x for x in s if x[1] < 3]).encode()).hexdigest() for s in each], pa.string())
            yield pa.RecordBatch.from_arrays([rows.column(0), *counts, digest, pa.array(map(_joined, each), pa.string())], names)

    return docs.selectExpr(f"`{id_col}`", f"`{text_col}` AS text").mapInArrow(run, schema)


def redact(docs: DataFrame, vocab: str, text_col: str = "text", chars_col: str = "n_chars", mask: str = "[SECRET]") -> DataFrame:
    """The same rows with every found span (overlapping ones as one) replaced by ``mask``, and the character count brought
    up to date where there is such a column.  Null texts stay null."""
    names = docs.columns
    at = names.index(text_col)
    count_at = names.index(chars_col) if chars_col in names else None

    def run(batches):
        for rows, texts in batch_slices(batches, text_col):
            found = scan_texts(texts, vocab)
            if found:
                old = rows.column(at).to_pylist()
                for t, spans in found.items():
                    text, out, done = old[t], [], 0
                    for s, _, e in spans:
                        if s >= done:
                            out += [text[done:s], mask]
                        done = max(done, e)
                    old[t] = "".join([*out, text[done:]])
                columns = list(rows.columns)
                columns[at] = pa.array(old, pa.string())
                if count_at is not None:
                    n = rows.column(count_at).to_pylist()
                    for t in found:
                        n[t] = len(old[t])
                    columns[count_at] = pa.array(n, rows.column(count_at).type)
                rows = pa.RecordBatch.from_arrays(columns, names)
            yield rows

    return docs.mapInArrow(run, docs.schema)

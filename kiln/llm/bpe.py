"""Whole-batch BPE: pre-tokens are found with numpy, each distinct one is merged once.

The results equal those of the tokenizers library for the two public
vocabularies: ``byte_bpe_50k.json`` (byte-level) and ``word_bpe_49k.json``
(lower-cased, word ends).  A text whose normal form differs from itself
in length, or which holds a special string, goes through the library
itself.
"""

from __future__ import annotations

import json
import os
import unicodedata
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pandas as pd

from kiln.llm.textcore import span_hash

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

OTHER, LETTER, NUMBER, SPACE, EDGE = range(5)
EDGE_CODE = 0x110000
SLICE_CHARS = 500_000
CACHE_WORDS = 250_000


def vocabulary(name: str) -> str:
    """The path of a public vocabulary file."""
    import public_tokenizers
    return str(public_tokenizers.path(name))


@lru_cache(4)
def load(path: str):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class of every code point, asked of the tokenizers library's own pattern engine."""
    from tokenizers import Regex
    from tokenizers.pre_tokenizers import Split
    out = np.zeros(EDGE_CODE + 1, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        split = Split(Regex(pattern), "removed", invert=True)
        for lo in range(0, 0x40000, 2048):  # no letter, number or space is assigned above
            if not 0xD800 <= lo < 0xE000:
                for _, (a, b) in split.pre_tokenize_str("".join(map(chr, range(lo, lo + 2048)))):
                    out[lo + a:lo + b] = kind
    out[EDGE_CODE] = EDGE
    return out


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case of every code point that has a one-character one; U+0130 has none and is left to the library."""
    out = np.arange(EDGE_CODE + 1, dtype=np.uint32)
    for i in range(0x20000):  # no cased letter is assigned above
        low = chr(i).lower()
        if len(low) == 1:
            out[i] = ord(low)
    return out


def _shift(a: np.ndarray, by: int, fill) -> np.ndarray:
    out = np.full_like(a, fill)
    if by > 0:
        out[by:] = a[:-by]
    else:
        out[:by] = a[-by:]
    return out


def token_starts(cp: np.ndarray, cls: np.ndarray, spaced: bool) -> np.ndarray:
    """Where pre-tokens start.  ``spaced``: one leading space belongs to the next run (byte-level pattern);
    otherwise each number character stands alone and white space is dropped later (word pattern)."""
    prev, nxt = _shift(cls, 1, EDGE), _shift(cls, -1, EDGE)
    run = cls != prev
    start = run | (cls == EDGE)
    after_blank = _shift(cp, 1, 0) == 32
    if spaced:
        start &= ~(after_blank & (cls < SPACE))
        start |= (cls == SPACE) & (prev == SPACE) & (nxt < SPACE)
    else:
        start |= cls == NUMBER
    quote = (cp == 39) & run & (nxt == LETTER)
    if spaced:
        quote &= ~after_blank
    at = np.flatnonzero(quote)
    if len(at):
        pad = np.concatenate([cp, np.zeros(4, cp.dtype)])
        c1, c2 = pad[at + 1], pad[at + 2]
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == ord("r")) & (c2 == ord("e"))) | ((c1 == ord("v")) & (c2 == ord("e"))) | \
            ((c1 == ord("l")) & (c2 == ord("l")))
        hit = one | two
        at, k = at[hit], np.where(one, 1, 2)[hit]
        start[at + 1] = False
        nexts = at + 1 + k
        start[nexts[nexts < len(start)]] = True
    return start


class Encoder:
    """Encodes lists of texts; keeps the token ids of up to ``CACHE_WORDS`` distinct pre-tokens between calls."""

    def __init__(self, path: str):
        self.path, self.lib = path, load(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.spaced = spec["pre_tokenizer"]["type"] == "ByteLevel"
        self.specials = [t["content"] for t in spec["added_tokens"]]
        self.piece = self._ranked(spec["model"]) if self.spaced else None
        self.names: list[str] | None = None
        self._reset()

    def _reset(self) -> None:
        self.index: dict[int, int] = {}
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0
        self.off = np.empty(1 << 16, np.int64)
        self.len = np.empty(1 << 16, np.int64)

    @staticmethod
    def _ranked(model: dict):
        """A merger of single pre-tokens, if the ids of the vocabulary follow the order of its merges."""
        import tiktoken
        from tokenizers.pre_tokenizers import ByteLevel
        vocab, merges = model["vocab"], model["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        if any(vocab["".join(p)] != 256 + i for i, p in enumerate(pairs)):
            return None
        alphabet = {}
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        extra = [b for b in range(256) if b not in keep]
        for b in keep:
            alphabet[chr(b)] = b
        for i, b in enumerate(extra):
            alphabet[chr(256 + i)] = b
        if set(alphabet) != set(ByteLevel.alphabet()):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocab.items() if i < 256 + len(pairs)}
        core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
        return core._core_bpe.encode_single_piece

    def library_only(self, text: str) -> bool:
        """Texts that the vectorised path leaves to the library."""
        if any(s in text for s in self.specials):
            return True
        return not self.spaced and ("İ" in text or not unicodedata.is_normalized("NFC", text))

    def merge(self, words: list[str]) -> list[list[int]]:
        """Token ids of each pre-token alone."""
        if self.piece:
            return [self.piece(w.encode()) for w in words]
        return [e.ids for e in self.lib.encode_batch(words, add_special_tokens=False)]

    def lookup(self, hashes: np.ndarray, strings) -> tuple[np.ndarray, np.ndarray]:
        """Place and number of the ids of each distinct pre-token."""
        if len(self.index) > CACHE_WORDS:
            self._reset()
        known = np.fromiter(map(self.index.get, hashes.tolist(), repeat(-1)), np.int64, len(hashes))
        missing = np.flatnonzero(known < 0)
        if len(missing):
            merged = self.merge(strings(missing))
            n = np.fromiter(map(len, merged), np.int64, len(merged))
            first = len(self.index)
            if first + len(merged) > len(self.off):
                grow = max(len(self.off), len(merged))
                self.off, self.len = np.append(self.off, np.empty(grow, np.int64)), np.append(self.len, np.empty(grow, np.int64))
            total = int(n.sum())
            if self.used + total > len(self.ids):
                self.ids = np.append(self.ids, np.empty(max(len(self.ids), total), np.uint32))
            self.ids[self.used:self.used + total] = np.fromiter(chain.from_iterable(merged), np.uint32, total)
            codes = np.arange(first, first + len(merged))
            self.off[codes], self.len[codes] = self.used + np.cumsum(n) - n, n
            self.index.update(zip(hashes[missing].tolist(), codes.tolist()))
            known[missing] = codes
            self.used += total
        return self.off[known], self.len[known]

    def segment(self, texts: list[str]):
        """(start, end, text index, code) of all pre-tokens of the texts, the hash of each code, and a function that
        gives the strings of codes.  start and end count code points from the beginning of the whole list, one more
        for each text before."""
        joined = "\0".join(texts) + "\0"
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32).copy()
        edges = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1) - 1
        cp[edges] = EDGE_CODE
        if not self.spaced:
            cp = lower_table()[cp]
        cls = char_classes()[cp]
        start = np.flatnonzero(token_starts(cp, cls, self.spaced))
        end = np.append(start[1:], len(cp))
        kind = cls[start]
        keep = kind != EDGE if self.spaced else kind < SPACE
        start, end = start[keep], end[keep]
        code, uniq = pd.factorize(span_hash(cp, start, end))
        first = np.empty(len(uniq), np.int64)
        first[code[::-1]] = np.arange(len(code))[::-1]

        def strings(which):
            return [joined[a:b] for a, b in zip(start[first[which]].tolist(), end[first[which]].tolist())]

        return start, end, np.searchsorted(edges, start), code, uniq, strings

    def gather(self, code, place, number) -> np.ndarray:
        """The ids of a sequence of pre-tokens."""
        n = number[code]
        total = int(n.sum())
        base = place[code] - (np.cumsum(n) - n)
        return self.ids[np.repeat(base, n) + np.arange(total)]

    def lengths(self, hashes: np.ndarray, strings) -> np.ndarray:
        """Number of ids of each distinct pre-token."""
        return self.lookup(hashes, strings)[1]

    def _grouped(self, texts: list[str]):
        """Lists of at most about SLICE_CHARS characters, by index; None for a text that the library must do."""
        group, size = [], 0
        for i, t in enumerate(texts):
            if self.library_only(t):
                yield None, [i]
                continue
            if group and size + len(t) > SLICE_CHARS:
                yield True, group
                group, size = [], 0
            group.append(i)
            size += len(t)
        if group:
            yield True, group

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, as the library gives them without added special tokens."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        for fast, group in self._grouped(texts):
            if not fast:
                i = group[0]
                out[i] = np.array(self.lib.encode(texts[i], add_special_tokens=False).ids, np.uint32)
                continue
            _, _, owner, code, uniq, strings = self.segment([texts[i] for i in group])
            place, number = self.lookup(uniq, strings)
            ids = self.gather(code, place, number)
            c = np.concatenate([[0], np.cumsum(number[code])])
            cuts = c[np.searchsorted(owner, np.arange(len(group) + 1))]
            for k, i in enumerate(group):
                out[i] = ids[cuts[k]:cuts[k + 1]]
        return out

    def count(self, texts: list[str]) -> np.ndarray:
        """The number of ids of each text."""
        out = np.zeros(len(texts), np.int64)
        for fast, group in self._grouped(texts):
            if not fast:
                out[group[0]] = len(self.lib.encode(texts[group[0]], add_special_tokens=False).ids)
                continue
            _, _, owner, code, uniq, strings = self.segment([texts[i] for i in group])
            out[group] = np.bincount(owner, self.lengths(uniq, strings)[code], len(group)).astype(np.int64)
        return out


@lru_cache(4)
def encoder(path: str) -> Encoder:
    """One encoder per vocabulary in each Python worker."""
    return Encoder(path)

"""Token pieces: documents as token ids with an end token, cut losslessly at the sequence length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np


def cut(n: int, length: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` tokens: pieces of ``length`` tokens, of which only the first may be shorter."""
    if n <= length:
        return [(0, n)]
    head = n % length
    out = [(0, head)] if head else []
    return out + [(s, length) for s in range(head, n, length)]


def crc(ids: np.ndarray) -> int:
    """crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def pieces(ids: np.ndarray, end_id: int, length: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(piece, start, ids) of one document with its end token."""
    whole = np.append(ids, np.uint32(end_id)).astype("<u4")
    for k, (s, n) in enumerate(cut(len(whole), length)):
        yield k, s, whole[s:s + n]

"""Vectorised text work on Arrow batches: code points of many texts at once, spans, and hashes of spans by prefix sums."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Code points that are worked on at once; a longer text is a block of its own.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First ``n`` powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of 64-bit values."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the offsets at which each text starts (one more than texts)."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4"), offsets


def lower_ascii(cp: np.ndarray) -> np.ndarray:
    return np.where((cp >= 65) & (cp <= 90), cp + np.uint32(32), cp)


class SpanHasher:
    """Hashes of any spans of one code point array, each in constant time."""

    def __init__(self, cp: np.ndarray):
        p, self.inverse = powers(len(cp) + 1)
        self.prefix = np.zeros(len(cp) + 1, np.uint64)
        np.cumsum((cp.astype(np.uint64) + np.uint64(1)) * p[:-1], out=self.prefix[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * self.inverse[start])


def same_spans(cp: np.ndarray, start: np.ndarray, end: np.ndarray, start2: np.ndarray, end2: np.ndarray, step: int = 1 << 18) -> bool:
    """Whether each span holds the same code points as its counterpart."""
    n = end - start
    if (n != end2 - start2).any():
        return False
    last = np.cumsum(n)
    a = 0
    while a < len(n):  # a stretch of spans at a time
        b = max(a + 1, int(np.searchsorted(last, last[a] - n[a] + step, "right")))
        place = np.arange(int(n[a:b].sum())) - np.repeat(last[a:b] - n[a:b] - (last[a] - n[a]), n[a:b])
        if (cp[np.repeat(start[a:b], n[a:b]) + place] != cp[np.repeat(start2[a:b], n[a:b]) + place]).any():
            return False
        a = b
    return True


def runs(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that cross no text's border: starts, ends, and the text each is in."""
    if not len(mask):
        return (np.zeros(0, np.int64),) * 3
    first = np.zeros(len(mask), bool)
    inner = offsets[offsets < len(mask)]
    first[inner] = True
    begin = mask.copy()
    begin[1:] &= ~mask[:-1] | first[1:]
    stop = mask.copy()
    stop[:-1] &= ~mask[1:] | first[1:]
    start, end = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return start, end, np.searchsorted(offsets, start, "right") - 1


def white_words(cp: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between ASCII white space (space, and U+0009 to U+000D)."""
    return runs(~((cp == 32) | ((cp >= 9) & (cp <= 13))), offsets)


def blocks(batch: pa.RecordBatch, column: str = "text", limit: int = BLOCK) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of a batch with their texts (null: empty), each about ``limit`` code points at most."""
    texts = [t or "" for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
    at = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield batch.slice(at, i - at), texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield batch.slice(at), texts[at:]


def sums(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sum of ``values`` (rows) for each of ``n`` owners."""
    if values.ndim == 1:
        return np.bincount(owner, values, n)
    return np.stack([np.bincount(owner, values[:, j], n) for j in range(values.shape[1])], 1)

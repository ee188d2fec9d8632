"""Vectorised scans over the UTF-8 bytes of Arrow string columns.

Texts are looked at as one byte array with document offsets; tokens are spans
in it, hashed all at once with a polynomial over 64-bit words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Documents are scanned in slices of about this many bytes, so that what is computed of them stays small; a longer document is a slice of its own.
SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_VALUES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.uint64)
_tables: list[np.ndarray] = []

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Space and \x09-\x0D separate words; everything else belongs to one.
WORDS = np.ones(256, dtype=np.uint8)
WORDS[[0x20, *range(0x09, 0x0E)]] = 0
#: Letters (with all bytes from 0x80), digits and other marks are runs of their own; white space separates.
RUNS = np.full(256, 3, dtype=np.uint8)
RUNS[[0x20, *range(0x09, 0x0E)]] = 0
RUNS[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1), *range(0x80, 0x100)]] = 1
RUNS[[*range(ord("0"), ord("9") + 1)]] = 2
#: Only letters and digits are in words.
ALNUM = np.where((RUNS == 1) | (RUNS == 2), 1, 0).astype(np.uint8)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n of the base and of its inverse, modulo 2**64."""
    if not _tables or len(_tables[0]) <= n:
        size = max(n + 1, SLICE + 4096)
        _tables[:] = []
        for base in (_BASE, _INVERSE):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _tables.append(np.multiply.accumulate(table))
    return _tables[0], _tables[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit words, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(32)
    return h


class Hasher:
    """Hashes of any spans of one byte array."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _powers(len(data))
        terms = _VALUES[data]
        terms *= power[: len(data)]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(terms, out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = self.sums[ends]
        h -= self.sums[starts]
        h *= self.inverse[starts]
        return mix(h)

    def grams(self, k: int) -> np.ndarray:
        """The hash of the k bytes from each position that has so many."""
        h = self.sums[k:] - self.sums[:-k]
        h *= self.inverse[: len(h)]
        return mix(h)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets between them; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, at - at[0]


def slices(data: np.ndarray, offsets: np.ndarray, limit: int = SLICE):
    """Runs of whole documents of at most `limit` bytes, or one document: (first, last + 1, bytes, offsets)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def tokens(data: np.ndarray, offsets: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes of one class other than 0, within documents: starts, ends, and the index of each document's first."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    kinds = classes[data]
    cut = np.empty(n + 1, dtype=bool)
    cut[0] = cut[n] = True
    np.not_equal(kinds[1:], kinds[:-1], out=cut[1:n])
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    keep = kinds[edges[:-1]] != 0
    starts, ends = edges[:-1][keep], edges[1:][keep]
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k words in a row, of one document's word hashes; all words as one, where there are fewer."""
    n = len(words)
    if not n:
        return words
    size = min(n, k)
    h = np.full(n - size + 1, size, dtype=np.uint64)
    for i in range(size):
        h *= np.uint64(0xD6E8FEB86659FD93)
        h += words[i : n - size + 1 + i]
    return mix(h)

"""Words and n-grams of Arrow string arrays as numpy arrays.

A batch of texts is one byte buffer with offsets. Words ``[^\\x20\\x09-\\x0D]+`` are found on the
buffer, and every word gets a 64-bit hash of its bytes, without one Python object per word. UTF-8
keeps other characters' bytes out of the ASCII range, so working on bytes is exact.

Byte ranges below ``LONG`` bytes are hashed as a polynomial modulo 2^64, all at once. Longer ones
need another hash, since Thue-Morse words of 1024 bytes are equal under every such polynomial: they
take BLAKE2b, one call each, of which a buffer has at most one per ``LONG`` bytes.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_M1, _M2 = U64(0xFF51AFD7ED558CCD), U64(0xC4CEB9FE1A85EC53)

LONG = 256  # bytes

IS_GAP = np.zeros(256, bool)
IS_GAP[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240501).integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)

_powers = [np.ones(1, U64), np.ones(1, U64)]


def _power_tables(n: int) -> list[np.ndarray]:
    if len(_powers[0]) <= n:
        for i, base in enumerate((BASE, _INVERSE)):
            steps = np.full(max(n + 1, 1 << 16), base, U64)
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def salt(n: int) -> np.uint64:
    """A constant that tells n-gram orders apart."""
    return U64(0x9E3779B97F4A7C15 * n % (1 << 64))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    h = h ^ (h >> U64(33))  # a new array, changed in place from here on
    h *= _M1
    h ^= h >> U64(33)
    h *= _M2
    h ^= h >> U64(33)
    return h


def rehash_long(data: np.ndarray, start: np.ndarray, end: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """``hashes`` of the byte ranges [start, end), those of ``LONG`` bytes or more replaced by BLAKE2b."""
    for i in np.flatnonzero(end - start >= LONG):
        digest = hashlib.blake2b(data[start[i]:end[i]].tobytes(), digest_size=8).digest()
        hashes[i] = int.from_bytes(digest, "little")
    return hashes


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one text."""
    _, offsets = buffer_of(texts)
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1)
        yield low, high
        low = high


def release() -> None:
    """Give freed memory back to the system. Python workers are reused by later stages, and memory
    that the allocators keep would count against every one of them."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


class Words:
    """The words of a batch: ``start`` and ``end`` in ``data``, ``doc`` (row), ``hash``, and
    ``first``, where each row's words begin (one more entry than rows)."""

    def __init__(self, texts: pa.Array, lower: bool = True):
        data, offsets = buffer_of(texts)
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        n = len(data)
        word = ~IS_GAP[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.concatenate(([False], word[:-1])) if n else word
        after = np.concatenate((word[1:], [False])) if n else word
        self.start = np.flatnonzero(word & (~before | edge[:-1]))
        self.end = np.flatnonzero(word & (~after | edge[1:])) + 1
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.first = np.searchsorted(self.start, offsets)
        power, inverse = _power_tables(n)
        self._total = np.zeros(n + 1, U64)
        np.cumsum(_BYTE[self.data] * power[:n], out=self._total[1:])
        self._inverse = inverse
        self.hash = self.hash_of(self.start, self.end)

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hashes of the byte ranges [start, end) of ``data``, of which long ones do not overlap."""
        return rehash_long(self.data, start, end, mix((self._total[end] - self._total[start]) * self._inverse[start]))

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.data[self.start[i]:self.end[i]].tobytes()


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``n`` words within a row, and the row of each."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    out = h[:len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * BASE + h[i:len(h) - n + 1 + i])
    doc = words.doc
    inside = doc[:len(h) - n + 1] == doc[n - 1:]
    return out[inside], doc[:len(h) - n + 1][inside]


def sorted_distinct(values: np.ndarray, rows: np.ndarray, n_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of each row in order, and where each row's begin. ``rows`` ascends."""
    values = values.copy()
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    for low, high in zip(bounds[:-1], bounds[1:]):
        if high - low > 1:
            values[low:high].sort()
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (rows[1:] != rows[:-1])
    kept = np.concatenate(([0], np.cumsum(new)))
    return values[new], kept[bounds]

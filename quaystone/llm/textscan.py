"""Numpy kernels over the UTF-8 bytes of an Arrow string array.

A batch is handled in chunks of whole texts, so memory follows the chunk (or
the one longest text), not the batch. Words are runs of bytes outside space
and 0x09-0x0D; those bytes never occur inside a multi-byte character, so byte
offsets cut the same words as code points do.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
GAP = np.zeros(256, bool)
GAP[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: xor-shift and multiply rounds."""
    x = x ^ (x >> _U(30))
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0x9E3779B97F4A7C15))
_BYTE[GAP] = 0
_POWERS = np.full(1 << 16, 0x5851F42D4C957F2D, np.uint64)
_POWERS[0] = 1
_POWERS = np.multiply.accumulate(_POWERS)
_STEP = (_POWERS[-1:] * _POWERS[1])[0]
_PLACE = mix(np.arange(11, 11 + 64, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)


def powers(base: np.uint64, exponent: np.ndarray) -> np.ndarray:
    """base to each exponent, modulo 2**64."""
    table = np.full(int(exponent.max()) + 1, base, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)[exponent]


class Chunk:
    """Whole texts, one after another: bytes, offsets (n + 1), first row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first, self.n = data, offsets, first, len(offsets) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end byte of each word, and the number of words that start
        before each text (n + 1)."""
        data, offsets = self.data, self.offsets
        if not len(data):
            e = np.zeros(0, np.int64)
            return e, e, np.zeros(self.n + 1, np.int64)
        inside = ~GAP[data]
        start = inside.copy()
        start[1:] &= ~inside[:-1]
        edge = offsets[(offsets > 0) & (offsets < len(data))]
        start[edge] = inside[edge]
        stop = inside.copy()
        stop[:-1] &= ~inside[1:]
        stop[edge - 1] = inside[edge - 1]
        s, e = np.flatnonzero(start), np.flatnonzero(stop) + 1
        return s, e, np.searchsorted(s, offsets)

    def word_hashes(self, s: np.ndarray, e: np.ndarray, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, of its bytes alone."""
        if not len(s):
            return np.zeros(0, np.uint64)
        data = LOWER[self.data] if lower else self.data
        place = np.arange(s[0], len(data), dtype=np.int32)
        place -= np.repeat(s.astype(np.int32), np.diff(np.append(s, len(data))))
        value = _BYTE[data[s[0] :]]
        value *= _POWERS[place & 0xFFFF]
        if (e - s).max() > len(_POWERS):  # weights go on as powers of the weight one table further
            value *= powers(_STEP, place >> 16)
        h = np.add.reduceat(value, s - s[0])
        return mix(h ^ ((e - s).astype(np.uint64) * _U(0x9E3779B97F4A7C15)))


def chunks(texts: pa.Array | pa.ChunkedArray, size: int = CHUNK) -> Iterator[Chunk]:
    """Null texts count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    n = len(texts)
    if not n:
        return
    offsets = np.frombuffer(texts.buffers()[1], kind, n + 1, texts.offset * np.dtype(kind).itemsize).astype(np.int64)
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        end = min(end, n)
        yield Chunk(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end
    pa.default_memory_pool().release_unused()


def shingle_hashes(words: np.ndarray, k: int = 5) -> np.ndarray:
    """Hashes of the k-word shingles of one text, in order, with repeats; with
    fewer words the whole sequence as one; without words none."""
    n = len(words)
    if not n:
        return words
    m = min(n, k)
    total = np.zeros(n - m + 1, np.uint64)
    for j in range(m):
        total += words[j : n - m + 1 + j] * _PLACE[j]
    return mix(total + _U(m))


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; sorting beats hashing for arrays this short."""
    if len(x) < 2:
        return x
    x = np.sort(x)
    return x[np.append(True, x[1:] != x[:-1])]


def shingle_sets(texts, k: int = 5) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of each text."""
    for c in chunks(texts):
        s, e, first = c.words()
        h = c.word_hashes(s, e)
        for i in range(c.n):
            yield c.first + i, distinct(shingle_hashes(h[first[i] : first[i + 1]], k))

"""Vectorised byte and word primitives shared by the operators of this package.

Everything works on whole Arrow batches: a piece is a run of rows whose UTF-8 bytes lie back to back in one
numpy array, with ``off`` holding the row boundaries. No Python object is made per word or per byte.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

#: Bytes of text handled at once; a longer single row is handled alone.
PIECE_BYTES = 768 << 10

_TABLE = np.random.default_rng(20240613).integers(0, 2**64, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def lean(run: Callable) -> Callable:
    """Gives memory back to the system at the end of a partition, as a worker lives on and others run beside it."""

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            return

    return whole


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row boundaries of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, bounds, data = column.buffers()
    off = np.frombuffer(bounds, kind, len(column) + 1, column.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """Row ranges of about ``limit`` bytes with their bytes and boundaries."""
    buf, off = utf8(column)
    row, rows = 0, len(off) - 1
    while row < rows:
        end = max(row + 1, int(np.searchsorted(off, off[row] + limit, "right")) - 1)
        yield slice(row, end), buf[off[row] : off[end]], off[row : end + 1] - off[row]
        row = end


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse, for i up to n."""
    if len(_POWERS[0]) <= n:
        size = 1 << max(12, int(n).bit_length())
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(size, base, np.uint64)
            step[0] = 1
            _POWERS[k] = np.cumprod(step, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Rolling:
    """Hashes of any span of a token array in O(1) each."""

    def __init__(self, tokens: np.ndarray):
        self.n = len(tokens)
        up, self.down = powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(tokens * up[: self.n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Of every run of k tokens."""
        if self.n < k:
            return np.zeros(0, np.uint64)
        return (self.sums[k:] - self.sums[:-k]) * self.down[: self.n - k + 1]


def byte_tokens(buf: np.ndarray) -> np.ndarray:
    return _TABLE[buf]


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every maximal run of bytes other than space and 9 to 13, and each row's first word."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    white = WHITE[buf]
    before, after = np.ones(n, bool), np.ones(n, bool)
    before[1:], after[:-1] = white[:-1], white[1:]
    before[off[:-1][off[:-1] < n]] = True
    after[off[1:][off[1:] > 0] - 1] = True
    starts, ends = np.flatnonzero(~white & before), np.flatnonzero(~white & after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_tokens(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(Rolling(byte_tokens(buf)).spans(starts, ends) ^ (ends - starts).astype(np.uint64))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w neighbours, by minima from either end of blocks of w."""
    n = len(a)
    if n < w:
        return a[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(a.dtype).max, a.dtype)
    padded[:n] = a
    blocks = padded.reshape(-1, w)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.ascontiguousarray(np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]).ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each pair, one after the other."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - counts), counts)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of n tokens lie in a span of ``length`` from any of ``starts``."""
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, starts, 1)
    np.add.at(marks, np.minimum(starts + length, n), -1)
    return np.cumsum(marks[:-1]) > 0


def lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and row boundaries of a list column of numbers; null counts as empty."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])


def pack(texts: pa.Array) -> pa.Array:
    """Each text compressed on its own, for a shuffle; null counts as empty."""
    squeeze = zstandard.ZstdCompressor(level=3).compress
    return pa.array([squeeze((x or "").encode() if not isinstance(x, bytes) else x) for x in texts.to_pylist()], pa.binary())


def unpack(packed: pa.Array) -> pa.Array:
    return pa.array(map(zstandard.ZstdDecompressor().decompress, packed.to_pylist()), pa.binary(), size=len(packed))


def longs(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def binaries(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of spans of buf, without a Python object for each."""
    sizes = ends - starts
    bounds = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=bounds[1:])
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(bounds), pa.py_buffer(buf[ranges(starts, sizes)].tobytes())])

"""Vector kernels over the bytes of a batch of texts, used inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 2**64))
#: Bytes of text that one round of kernels works on; the arrays are some tens of times that.
SLICE = 1 << 20

_SPACES = np.zeros(256, bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: All that separates terms: ASCII other than digits and letters. Bytes of other characters are part of terms.
TERM_BREAKS = np.arange(256) < 0x80
TERM_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits in which every input bit reaches every output bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def text_slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) for runs of rows of about `most` bytes; null is empty."""
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def _powers(n: int, base: np.uint64) -> np.ndarray:
    out = np.full(n, base, U64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=U64)


class Prefix:
    """Polynomial hashes of any substrings of one byte array."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((data.astype(U64) + U64(1)) * _powers(n, BASE), out=self.sums[1:])
        self.back = _powers(n + 1, BASE_INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray = _SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and the total): maximal runs of bytes that are no breaks."""
    solid = ~breaks[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    begin, stop = solid.copy(), solid.copy()
    if len(data):
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        stop[:-1] &= ~solid[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each text and the total)."""
    starts, ends, first = words(data, offsets)
    h = Prefix(data).of(starts, ends)
    return mix(h ^ (ends - starts).astype(U64)), first


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words of one text; a shorter text is one run."""
    n = len(hashes)
    if not n:
        return hashes
    k = min(size, n)
    h = np.full(n - k + 1, U64(k), U64)
    for i in range(k):
        h = h * BASE + hashes[i : n - k + 1 + i]
    return np.unique(mix(h))

"""Word splitting and hashing over Arrow text columns, vectorised with numpy.

A word is a maximal run of bytes outside ``[\\x20\\x09-\\x0D]`` (these bytes never occur inside a
multi-byte UTF-8 character). Work goes in slices of about ``SLICE`` bytes, which fit the cache, so memory is bounded by
the slice or by one document, whichever is larger. Null texts count as empty.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # glibc only
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(1, 2**63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTES.copy()
_LOWER[ord("A"):ord("Z") + 1] = _BYTES[ord("a"):ord("z") + 1]
_PLACE = np.uint64(0x9E3779B97F4A7C15)
_STEPS = _rng.integers(1, 2**63, 4096, np.uint64) * np.uint64(2) + np.uint64(1)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class Words:
    """The words of some documents: byte spans, document number, and 64-bit hashes on demand."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        """``data``: the concatenated UTF-8 texts; ``offsets``: n+1 document borders within it."""
        self.data, self.offsets = data, offsets
        n = len(data)
        inside = np.empty(n + 1, bool)
        np.logical_not(_SPACE[data], out=inside[:n])
        inside[n] = False
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        borders = offsets[:-1]
        borders = borders[borders < n]
        first[borders] = inside[borders]
        last = inside[:n].copy()
        last[:-1] &= ~inside[1:n] | first[1:n]
        self.starts = np.flatnonzero(first)
        self.ends = np.flatnonzero(last) + 1
        self.first = np.searchsorted(self.starts, offsets)  # n+1: first word of each document
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word's bytes (``lower``: A-Z counted as a-z): the sum of a mixed value of each
        byte and its place, however far it is. A polynomial would give regular words equal sums."""
        if not len(self.starts):
            return np.empty(0, np.uint64)
        lo, hi = self.starts[0], self.ends[-1]
        gaps = np.diff(self.starts, append=hi)
        value = np.arange(lo, hi, dtype=np.uint64)
        value -= np.repeat(self.starts.astype(np.uint64), gaps)
        value *= _PLACE
        value += (_LOWER if lower else _BYTES)[self.data[lo:hi]]
        value ^= value >> np.uint64(32)
        value *= np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(29)
        borders = np.stack([self.starts, self.ends], 1).ravel()[:-1] - lo       # each word, then what follows it
        sums = np.add.reduceat(value, borders)[::2]
        return mix64(sums + (self.ends - self.starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def docs(self) -> np.ndarray:
        """The document number of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive word hashes, borders between documents ignored."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out += hashes[i:i + n] * _STEPS[i]
    return mix64(out)


def prefix_hash(hashes: np.ndarray) -> np.uint64:
    """One hash for a whole sequence of word hashes, any length."""
    n = len(hashes)
    weights = mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    return mix64(np.array([(hashes * weights).sum() + np.uint64(n)], np.uint64))[0]


def give_back() -> None:
    """Returns freed memory to the system: workers live on between tasks, beside the executor's heap."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def binary(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as large_binary without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    return column.cast(pa.large_string()).cast(pa.large_binary())


def slices(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) for runs of rows of about ``size`` bytes."""
    column = binary(column)
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, end, data[offsets[at]:offsets[end]], offsets[at:end + 1] - offsets[at]
        at = end
    give_back()

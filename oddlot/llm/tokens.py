"""Words, word hashes and shingles of whole Arrow text columns, computed with numpy on the UTF-8 bytes.

A word is ``[^\\x20\\x09-\\x0D]+``. Hashes are 64 bits wide, depend on the bytes alone and are equal in
every task. Texts are worked through in slices of a quarter of a megabyte, so memory does not follow the size
of an Arrow batch; one text longer than a slice makes a slice of its own.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 18

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_PLAIN = np.arange(256, dtype=np.uint8)
_LOWER = _PLAIN.copy()
_LOWER[65:91] += 32
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def number_mix(x: int) -> np.uint64:
    return mix(np.array([x & 0xFFFFFFFFFFFFFFFF], dtype=np.uint64))[0]


def _power_tables(size: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < size:
        size = max(size, SLICE_BYTES + 1)
        for i, base in enumerate((_BASE, _INVERSE)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[i] = np.cumprod(table, dtype=np.uint64)
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of consecutive texts: byte spans into ``data`` and the first word of each text."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        """One 64-bit hash per word; ``lower`` folds A-Z first."""
        out = np.empty(len(self.starts), dtype=np.uint64)
        table = (_LOWER if lower else _PLAIN).astype(np.uint64) + np.uint64(1)
        i = 0
        while i < len(out):
            begin = self.starts[i]
            j = max(i + 1, int(np.searchsorted(self.ends, begin + SLICE_BYTES, "right")))
            block = table[self.data[begin : self.ends[j - 1]]]
            up, down = _power_tables(len(block) + 1)
            sums = np.zeros(len(block) + 1, dtype=np.uint64)
            np.cumsum(block * up[: len(block)], out=sums[1:])
            s, e = self.starts[i:j] - begin, self.ends[i:j] - begin
            out[i:j] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Words of the texts ``data[offsets[i]:offsets[i + 1]]``."""
    inside = ~_SPACE[data]
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        edges = offsets[(offsets > 0) & (offsets < len(data))]
        start[edges] = inside[edges]
        end[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(start)
    return Words(data, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))


def flat(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Give what this worker holds free back to the system: an executor's idle workers share its memory."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def slices(column: pa.Array | pa.ChunkedArray, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows from and to, their bytes, and offsets into these; null texts are empty."""
    column = flat(column).fill_null("").cast(pa.large_string())
    if not len(column):
        return
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        j = min(j, len(column))
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j
    release()


_FACTORS = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingle_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all ``k``-word shingles of one text; the whole sequence as one if it is shorter."""
    n = len(hashes)
    if not n:
        return hashes
    width = min(n, k)
    total = np.full(n - width + 1, number_mix(width), dtype=np.uint64)
    for j in range(width):
        total += hashes[j : n - width + 1 + j] * _FACTORS[j]
    return mix(total)


def all_shingles(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of consecutive texts, in order, and the first shingle of each text."""
    sizes = np.diff(first)
    counts = np.where(sizes >= k, sizes - k + 1, (sizes > 0).astype(np.int64))
    begin = np.concatenate(([0], np.cumsum(counts)))
    at = np.arange(begin[-1]) + np.repeat(first[:-1] - begin[:-1], counts)
    padded = np.append(hashes, np.zeros(k, dtype=np.uint64))
    total = np.full(len(at), number_mix(k), dtype=np.uint64)
    for j in range(k):
        total += padded[at + j] * _FACTORS[j]
    out = mix(total)
    for d in np.flatnonzero((sizes > 0) & (sizes < k)):
        out[begin[d]] = shingle_hashes(hashes[first[d] : first[d + 1]], k)[0]
    return out, begin


def int64s(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def lists(parts: list[np.ndarray]) -> pa.Array:
    """Arrays of 64-bit numbers as one list column."""
    offsets = np.zeros(len(parts) + 1, dtype=np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    values = np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))

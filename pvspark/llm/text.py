"""Vectorised text helpers that run inside tasks, on one Arrow batch at a time.

Texts are handled as UTF-8 bytes. All helpers treat a null text as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text and rows that a task handles at once; a longer document is a chunk of its own.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096

_BASE = 0x9E3779B97F4A7C15 | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)

#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes of words in [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing).
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

#: Bytes of words in [^\x20\x09-\x0D]+.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[9:14] = NOT_SPACE[32] = False

_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse, modulo 2**64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1024)
        with np.errstate(over="ignore"):
            _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)], dtype=np.uint64) for b in (_BASE, _BASE_INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task's function that gives the memory it freed back to the system when it ends; Python workers live on, one stage's beside the next one's."""

    def tidied(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
                trim(0)

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as one byte array and the offsets of its rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of at most CHUNK_ROWS rows and `limit` bytes of text; a row over that comes alone. No row is left out."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(size), 0
    while start < len(size):
        end = int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right"))
        end = min(max(end, start + 1), start + CHUNK_ROWS)
        yield batch.slice(start, end - start)
        start = end


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (exclusive) and rows of the maximal runs of bytes of a kind; no run crosses rows."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = kind[data]
    begins, stops = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    stops[:-1] &= ~inside[1:]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    begins[edge] = inside[edge]
    stops[edge - 1] = inside[edge - 1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    return starts, ends, np.searchsorted(offsets[1:], starts, "right")


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs; equal runs have equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        up, down = powers(len(data))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])


def words(column: pa.Array, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased (A-Z) words of each row, in order, and their rows."""
    data, offsets = flat(column)
    data = LOWER[data]
    starts, ends, rows = spans(data, offsets, kind)
    return hashes(data, starts, ends), rows


def lower(text: str) -> str:
    """A-Z to a-z; every other character, and so every offset, stays."""
    return text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")

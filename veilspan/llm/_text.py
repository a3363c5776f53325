"""Vectorised text kernels over Arrow string columns.

Everything here works on the raw UTF-8 bytes of a batch: one ``uint8`` array for
all rows and an offset array, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes of text that the kernels look at together; bounds the working memory.
SLICE_BYTES = 1 << 20
#: Units covered by one table of powers.
BLOCK = 1 << 17

_B = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1

#: ASCII white space: tab to carriage return, and the space.
_NONSPACE = np.ones(256, bool)
_NONSPACE[[9, 10, 11, 12, 13, 32]] = False

#: Bytes with A-Z lower-cased.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_tables: dict[int, np.ndarray] = {}


def byte_table(seed: int) -> np.ndarray:
    """256 pseudo-random odd 64-bit values; the same for the same seed everywhere."""
    if seed not in _tables:
        _tables[seed] = np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return _tables[seed]


_pows: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, n of each at least."""
    if base not in _pows or len(_pows[base][0]) < n:
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n, b, np.uint64)
            x[0] = 1
            out.append(np.multiply.accumulate(x))
        _pows[base] = (out[0], out[1])
    return _pows[base]


def tidied(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """Gives freed memory back when a task ends: workers live on between tasks, and share the executor's limit."""

    @functools.wraps(run)
    def out(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL("libc.so.6").malloc_trim(0)
            except (OSError, AttributeError):  # another C library
                pass

    return out


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that low and high bits are usable alone."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``limit`` bytes of text, a row at least."""
    if not batch.num_rows:
        return
    _, offsets = string_bytes(batch.column(batch.schema.get_field_index(column)))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and where each row begins; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def mask_runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True bytes; a run ends where a row ends."""
    starts, ends = inside.copy(), inside.copy()
    if len(inside):
        full = offsets[1:] > offsets[:-1]
        first, last = offsets[:-1][full], offsets[1:][full] - 1
        starts[1:] &= ~inside[:-1]
        starts[first] = inside[first]
        ends[:-1] &= ~inside[1:]
        ends[last] = inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of non-space bytes, and the first word of each row (one more than rows)."""
    starts, ends = mask_runs(_NONSPACE[data], offsets)
    return starts, ends, np.searchsorted(starts, offsets)


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """64-bit hashes of byte spans that are in order and don't overlap."""
    out = np.empty(len(starts), np.uint64)
    table, n = byte_table(seed), len(starts)
    k = 0
    while k < n:
        a = int(starts[k])
        k2 = int(np.searchsorted(ends, a + BLOCK, "right"))
        if k2 <= k:  # a span of more than a block
            out[k] = xxhash.xxh64_intdigest(data[a : int(ends[k])].tobytes(), seed=seed)
            k += 1
            continue
        b = int(ends[k2 - 1])
        up, down = _powers(_B, BLOCK + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(table[data[a:b]] * up[: b - a], out=sums[1:])
        s, e = starts[k:k2] - a, ends[k:k2] - a
        out[k:k2] = mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = k2
    return out


def window_hash(units: np.ndarray, n: int, positions: np.ndarray | None = None, base: int = _B) -> np.ndarray:
    """64-bit hashes of n consecutive units, from every position or from the given ascending ones."""
    last = len(units) - n
    if positions is None:
        positions = np.arange(max(0, last + 1))
    out = np.empty(len(positions), np.uint64)
    k = 0
    while k < len(positions):
        a = int(positions[k])
        k2 = int(np.searchsorted(positions, a + BLOCK, "left"))
        b = int(positions[k2 - 1]) + n
        up, down = _powers(base, BLOCK + n + 1)
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(units[a:b] * up[: b - a], out=sums[1:])
        at = positions[k:k2] - a
        out[k:k2] = (sums[at + n] - sums[at]) * down[at]
        k = k2
    return mix(out)


def stretch_hash(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray, longest: int, base: int = _B) -> np.ndarray:
    """64-bit hashes of stretches of units, in order of start; they can overlap, and have ``longest`` units at most."""
    out = np.empty(len(starts), np.uint64)
    up, down = _powers(base, BLOCK + longest + 1)
    k = 0
    while k < len(starts):
        a = int(starts[k])
        k2 = int(np.searchsorted(starts, a + BLOCK, "left"))
        s, e = starts[k:k2] - a, starts[k:k2] - a + lengths[k:k2]
        b = a + int(e.max())
        sums = np.zeros(b - a + 1, np.uint64)
        np.cumsum(units[a:b] * up[: b - a], out=sums[1:])
        out[k:k2] = mix((sums[e] - sums[s]) * down[s] + lengths[k:k2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        k = k2
    return out


def gather(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The bytes (or other items) of the spans, one after the other."""
    total = int(lengths.sum())
    if not total:
        return data[:0]
    at = np.zeros(len(lengths), np.int64)
    np.cumsum(lengths[:-1], out=at[1:])
    index = np.repeat(starts.astype(np.int64) - at, lengths)
    index += np.arange(total)
    return data[index]


def expand(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All positions in half-open spans, in order."""
    n = ends - starts
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.zeros(len(n), np.int64)
    np.cumsum(n[:-1], out=at[1:])
    return np.repeat(starts - at, n) + np.arange(total)


def merge(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open spans given in order of start."""
    if not len(starts):
        return starts, ends
    reach = np.maximum.accumulate(ends)
    new = np.concatenate(([True], starts[1:] > reach[:-1]))
    at = np.flatnonzero(new)
    return starts[at], reach[np.concatenate((at[1:] - 1, [len(starts) - 1]))]

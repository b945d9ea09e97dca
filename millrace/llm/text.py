"""Shared byte-level text helpers.

A word is a maximal run of bytes outside space and 0x09-0x0D; ``bytes.split()`` splits at exactly these bytes, and
they never occur inside a longer UTF-8 sequence, so words of the bytes are words of the text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute

#: Text bytes that are handled at once; one longer text is handled alone.
SLICE_BYTES = 4 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def release() -> None:
    """Give freed memory back to the system, as far as the C library can."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, with its task's memory given back at the end: Python workers are reused, and idle ones keep theirs."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release()

    return task


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a record batch into runs of rows whose texts hold at most ``limit`` bytes (one row at least)."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).cast(pa.int64()))
    ends, at = np.cumsum(lengths), 0
    while at < len(lengths):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to


def encoded(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def flat(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All bytes in one array, and the n + 1 bounds of the texts."""
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=bounds[1:])
    return np.frombuffer(b"".join(texts), np.uint8), bounds


def per_text(mask: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of a byte-wise array over each text."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the constants are those of the public splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: A value for every byte, A-Z as a-z, and the multiplier of a byte's place in its word.
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[0x41:0x5B] += np.uint64(0x20)
_BYTE = mix(_LOWER + np.uint64(1)) | np.uint64(1)
_PLACE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _places(n: int, cache: list[np.ndarray] = []) -> np.ndarray:  # noqa: B006
    """Powers of the multiplier, modulo 2**64."""
    if not cache or len(cache[0]) < n:
        cache[:] = [np.cumprod(np.concatenate([[np.uint64(1)], np.full(max(n, 256), _PLACE)]))]
    return cache[0]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts in turn, A-Z lower-cased, and the number of words of each text."""
    data, bounds = flat(texts)
    at = np.flatnonzero(~IS_SPACE[data])
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.empty(len(at), bool)
    first[0] = True
    np.greater(at[1:], at[:-1] + 1, out=first[1:])
    edges = np.searchsorted(at, bounds[:-1])
    first[edges[edges < len(at)]] = True  # a text may start right where another ends
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    h = np.add.reduceat(_BYTE[data[at]] * _places(int(sizes.max()))[place], starts)
    return mix(h + sizes.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03)), np.diff(np.searchsorted(at[starts], bounds))


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    s = np.sort(values)
    new = np.ones(len(s), bool)
    np.not_equal(s[1:], s[:-1], out=new[1:])
    return s if new.all() else s[new]

"""Numpy helpers that run inside Spark tasks, on one Arrow batch of texts at a time.

A batch is cut into slices of at most ``max_bytes`` of text (a longer document is a slice of its
own), so a worker's memory follows the slice and the longest document, not the partition.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INV = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def give_back() -> None:
    """At the end of a task: memory that the worker process holds free goes back to the machine, as the process lives on."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library than glibc
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data, offsets


def slices(offsets: np.ndarray, max_bytes: int) -> Iterator[tuple[int, int]]:
    """Row ranges of at most max_bytes each (or one longer row)."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = int(np.searchsorted(offsets, offsets[lo] + max_bytes, side="right")) - 1
        hi = min(n, max(hi, lo + 1))
        yield lo, hi
        lo = hi


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base to the powers 0 to n-1, modulo 2**64; up to 4 Mi of them are kept for the next slice."""
    if len(_POWERS.get(base, ())) < n:
        out = np.full(max(n, 1 << 16), base, dtype=U64)
        out[0] = 1
        out = np.cumprod(out, dtype=U64)
        if n > 1 << 22:
            return out[:n]
        _POWERS[base] = out
    return _POWERS[base][:n]


def word_spans(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each run without separators (ASCII white space), and the row it is in.

    data holds the rows' bytes only: offsets[0] is 0 and offsets[-1] is len(data).
    """
    n = len(data)
    solid = np.zeros(n + 2, dtype=bool)
    solid[1:-1] = ~separators[data]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    starts = np.flatnonzero(solid[1:] & (~solid[:-1] | edge))
    ends = np.flatnonzero(solid[:-1] & (~solid[1:] | edge))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by differences of one prefix polynomial."""
    n = len(data)
    prefix = np.zeros(n + 1, dtype=U64)
    np.cumsum((data.astype(U64) + U64(1)) * powers(_BASE, n), out=prefix[1:], dtype=U64)
    return mix((prefix[ends] - prefix[starts]) * powers(_INV, n + 1)[starts] + (ends - starts).astype(U64))


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of k successive words, within rows of counts[i] words.

    A row of 1 to k-1 words has one shingle of all its words. Returns (hash, row, position).
    """
    ends = np.cumsum(counts)
    firsts = ends - counts
    number = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    rows = np.repeat(np.arange(len(counts)), number)
    position = np.arange(int(number.sum())) - np.repeat(np.cumsum(number) - number, number)
    at = firsts[rows] + position
    out = np.zeros(len(at), dtype=U64)
    last = ends[rows]
    for j in range(k):
        p = at + j
        inside = p < last
        w = words[np.minimum(p, max(len(words) - 1, 0))] if len(words) else np.zeros(0, U64)
        out = np.where(inside, mix(out * U64(0x100000001B3) + w + U64(j + 1)), out)
    return out, rows, position


def documents(data: np.ndarray, offsets: np.ndarray, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of rows lo to hi and their offsets from 0."""
    return data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

"""Vectorised word splitting and hashing for Arrow batches of texts.

A batch of texts is one UTF-8 buffer plus offsets, so splitting into words is a
table lookup per byte and a comparison of neighbours. Words are then
dictionary-encoded once per batch and every distinct word is hashed once with a
128-bit hash. All functions treat a null text as empty and cut no text short.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import xxhash


def _table(stop: list[tuple[int, int]]) -> np.ndarray:
    keep = np.ones(256, dtype=bool)
    for first, last in stop:
        keep[first : last + 1] = False
    return keep


#: Bytes of `[^\x20\x09-\x0D]+`.
SPACED = _table([(0x20, 0x20), (0x09, 0x0D)])
#: Bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, for text whose A-Z are in lower case.
ALNUM = _table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def slices(texts: pa.Array, most_bytes: int = 8 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `most_bytes` of text each (one row at least)."""
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(byte_lengths(texts))
    first = 0
    while first < n:
        base = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, base + most_bytes, side="right")))
        yield first, last
        first = last


def as_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The column as one large_string array without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column.cast(pa.large_string()).fill_null("")


def _offsets(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]


def give_back() -> None:
    """Hands freed memory back to the system, as a worker outlives its task and stands by
    while other steps need the memory."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every system's library can
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def byte_lengths(texts: pa.Array) -> np.ndarray:
    """UTF-8 bytes of each text."""
    return np.diff(_offsets(texts))


class Words:
    """The words of a run of texts.

    codes: number of each word in `vocabulary`; first: for text i the words
    first[i]:first[i+1]; lower: A-Z were lower-cased before splitting; kinds: a small
    number for each byte, with words also cut between neighbours of kinds 1 and 2.
    """

    def __init__(self, texts: pa.Array, keep: np.ndarray = SPACED, lower: bool = False, kinds: np.ndarray | None = None):
        offsets = _offsets(texts)
        buffer = texts.buffers()[2]
        if buffer is None or offsets[-1] == offsets[0]:
            self.codes, self.vocabulary = np.empty(0, np.int32), []
            self.first = np.zeros(len(texts) + 1, np.int64)
            return
        data = np.frombuffer(buffer, dtype=np.uint8)[offsets[0] : offsets[-1]]
        bounds = offsets - offsets[0]
        if lower:
            data = _LOWER[data]
        inside = keep[data]
        before = np.empty_like(inside)
        before[0], before[1:] = False, inside[:-1]
        before[bounds[:-1][bounds[:-1] < len(data)]] = False
        begins = inside & ~before
        if kinds is not None:
            own = kinds[data]
            begins[1:] |= own[1:] + own[:-1] == 3
        starts = np.flatnonzero(begins)
        self.first = np.searchsorted(starts, bounds)
        # A word ends where the bytes kept so far reach the next word's start.
        kept = np.cumsum(inside)
        at = np.empty(len(starts) + 1, np.int64)
        at[:-1], at[-1] = kept[starts] - 1, kept[-1]
        packed = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(data[inside])])
        coded = packed.dictionary_encode()
        self.codes = coded.indices.to_numpy()
        self.vocabulary = coded.dictionary.to_pylist()

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self, streams: int = 1) -> list[np.ndarray]:
        """One or two independent 64-bit hashes of every word."""
        if not self.vocabulary:
            return [np.empty(0, np.uint64)] * streams
        digests = np.frombuffer(b"".join(xxhash.xxh3_128_digest(w) for w in self.vocabulary), dtype=np.uint64).reshape(-1, 2)
        return [np.ascontiguousarray(digests[:, i])[self.codes] for i in range(streams)]


def windows(hashes: np.ndarray, first: np.ndarray, n: int, stream: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of n consecutive words that lie in one text, and the
    word each starts at; in order."""
    total = len(hashes) - n + 1
    if total <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    rolled = hashes[:total].copy()
    base = _BASES[stream]
    for j in range(1, n):
        rolled *= base
        rolled += hashes[j : j + total]
    counts = np.diff(first)
    text = np.repeat(np.arange(len(counts)), counts)
    starts = np.flatnonzero(np.arange(total) + n <= first[1:][text[:total]])
    return mix(rolled[starts]), starts

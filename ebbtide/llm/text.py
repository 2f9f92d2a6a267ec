"""Words and n-grams of text columns as numpy arrays, read from Arrow buffers without Python strings.

A word is a run of bytes outside 0x20 and 0x09-0x0D, which in UTF-8 is the same as a run of `[^\\x20\\x09-\\x0D]`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SLICE_BYTES, SLICE_ROWS = 1 << 21, 4096
ODD = np.uint64(0x9E3779B97F4A7C15)
MIX_1, MIX_2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-spread bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def raw_texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column, and the n+1 offsets of the rows; NULL is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    kind = np.int64 if wide else np.int32
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = offsets.astype(np.int64)
    return np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(column: pa.Array, most: int = SLICE_BYTES, rows: int = SLICE_ROWS):
    """Consecutive rows, `rows` of them and `most` bytes together at most (one long text may exceed it): first, last,
    bytes, offsets."""
    data, offsets = raw_texts(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        last = min(last, first + rows)
        yield first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def bounded(columns: list[pa.Array], most: int):
    """First and last of consecutive rows that hold `most` bytes in these text columns; a larger row comes alone."""
    ends = sum(raw_texts(c)[1] for c in columns)
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + most, "right")) - 1)
        yield first, last
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; a row's end ends its last word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:-1]
    end[:-1] &= ~solid[1:] | edge[1:-1]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word: a polynomial of its bytes, mixed with its length."""
    out = np.zeros(len(starts), np.uint64)
    step = 1 << 17
    for a in range(0, len(starts), step):  # keeps the arrays of one byte per entry small
        s, e = starts[a : a + step], ends[a : a + step]
        at = np.arange(s[0], e[-1])
        place = np.searchsorted(s, at, "right") - 1 if len(s) < 2 else np.repeat(
            np.arange(len(s)), np.diff(np.append(s, e[-1])))
        inner = at - s[place]
        values = (data[s[0] : e[-1]].astype(np.uint64) + np.uint64(1)) * powers(ODD, int(inner.max()) + 1)[inner]
        values[at >= e[place]] = 0
        out[a : a + step] = np.add.reduceat(values, s - s[0]) + (e - s).astype(np.uint64)
    return mix(out)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word, and the n+1 positions in these arrays at which the rows begin."""
    starts, ends = word_bounds(data, offsets)
    return hash_words(data, starts, ends), starts, ends, np.searchsorted(starts, offsets)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of each `length` consecutive words, in order, across row ends too; callers drop those."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k, p in enumerate(powers(ODD, length)):
        out += hashes[k : k + n] * p
    return mix(out)

"""Texts of an Arrow column as byte arrays: words, hashes and sums without a Python loop over words.

A word is a run of bytes other than space and 0x09-0x0D. These bytes are never
part of a longer UTF-8 character, so words of bytes are words of characters.
Hashes are polynomials modulo 2^64 over a random number per byte, each finished
with a mixer. They come from prefix sums, so a word of any length costs the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BLOCK_BYTES = 2_000_000  # text worked on at once; a longer document is a block by itself

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

# Odd, so that they have inverses modulo 2^64.
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
TOKEN_BASES = (0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
_M64 = (1 << 64) - 1
_tables: dict[int, np.ndarray] = {}
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit over the 64 (the finisher of splitmix64)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64, kept between calls."""
    known = _powers.get(base)
    if known is None or len(known) < n:
        size = max(n, 1 << 16)
        with np.errstate(over="ignore"):
            known = np.full(size, U(base & _M64))
            known[0] = 1
            known = np.multiply.accumulate(known)
        _powers[base] = known
    return known[:n]


def _inverse(base: int) -> int:
    return pow(base, -1, 1 << 64)


def byte_numbers(base: int) -> np.ndarray:
    if base not in _tables:
        _tables[base] = mix(np.arange(1, 257, dtype=U) * U(base & _M64 | 1))
    return _tables[base]


def range_hashes(numbers: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of numbers[start:end] for every pair; equal runs have equal hashes wherever they start."""
    n = len(numbers)
    with np.errstate(over="ignore"):
        sums = np.zeros(n + 1, U)
        np.cumsum(numbers * powers(base, n), out=sums[1:])
        return mix((sums[ends] - sums[starts]) * powers(_inverse(base), n + 1)[starts])


def strings(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null is the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks)
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    buffers = column.buffers()
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32)
    offsets = offsets[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


class Words:
    """Words of the texts of one block. `first[i]:first[i + 1]` are the words of text i."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.offsets = offsets
        inside = ~SPACE[self.data]
        begins, lasts = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        lasts[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]  # a text's first byte begins a word, whatever the text before ends with
        at = offsets[:-1][full]
        begins[at] = inside[at]
        at = offsets[1:][full] - 1
        lasts[at] = inside[at]
        self.starts = np.flatnonzero(begins)
        self.ends = np.flatnonzero(lasts) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self, which: int = 0) -> np.ndarray:
        base = BASES[which]
        return range_hashes(byte_numbers(base)[self.data], self.starts, self.ends, base)

    def text_of(self) -> np.ndarray:
        """Index of the text of every word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def windows(words: Words, width: int) -> np.ndarray:
    """Index of the first word of every run of `width` words inside one text."""
    room = np.repeat(words.first[1:], words.counts) - np.arange(len(words))
    return np.flatnonzero(room >= width)


def text_hashes(data: np.ndarray, offsets: np.ndarray, which: int = 0) -> np.ndarray:
    return range_hashes(byte_numbers(BASES[which])[data], offsets[:-1], offsets[1:], BASES[which])


def sums_between(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values[offsets[i]:offsets[i + 1]] for every i."""
    total = np.zeros(len(values) + 1, np.int64 if values.dtype.kind in "bui" else np.float64)
    np.cumsum(values, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def slices(sizes: np.ndarray, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of rows whose sizes add up to `most` at most; a larger row stands alone."""
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        before = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield begin, end
        begin = end


def blocks(batch: pa.RecordBatch | pa.Table, column: str, most: int = BLOCK_BYTES):
    """Parts of a batch with their text bytes: (rows, data, offsets)."""
    data, offsets = strings(batch.column(column))
    for begin, end in slices(np.diff(offsets), most):
        part = offsets[begin:end + 1]
        yield batch.slice(begin, end - begin), data[part[0]:part[-1]], part - part[0]


def gathered(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs data[start:start + length] behind one another, and their offsets."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    take = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    return data[take], offsets


def binary_column(arrays) -> pa.Array:
    return pa.array([a.tobytes() if isinstance(a, np.ndarray) else a for a in arrays], pa.binary())


def string_column(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    if offsets[-1] < 2**31:
        return pa.StringArray.from_buffers(
            len(offsets) - 1, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data)))

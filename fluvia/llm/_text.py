"""Words and n-grams of Arrow text columns as numpy arrays.

Everything here works on the UTF-8 bytes of a whole batch at once: no loop over characters or words runs in Python.
Texts are whole; a batch is only cut between rows, so that memory follows the longest text and not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

#: Bytes of text that one slice of a batch holds, unless a single text is longer.
SLICE_BYTES = 1_000_000
#: Rows that one slice holds at most, so that a row's number fits in 16 bits and sorts by radix.
SLICE_ROWS = 50_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit over the output (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    """A table of 256 flags, true outside the given inclusive byte ranges."""
    table = np.ones(256, bool)
    for low, high in ranges:
        table[low : high + 1] = False
    return table


#: Word bytes: all but blank and the controls from tab to carriage return.
SPACED = byte_class((0x20, 0x20), (0x09, 0x0D))
#: Word bytes: ASCII letters, digits, and every byte of a non-ASCII character. For lower-cased text.
ALNUM = byte_class((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))

_PLAIN = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_LOWER = _PLAIN.copy()
_LOWER[ord("A") : ord("Z") + 1] = _PLAIN[ord("a") : ord("z") + 1]


class Slice(NamedTuple):
    """Rows first..last of a batch: their bytes back to back, and where each row begins (one offset more than rows)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray


class Words(NamedTuple):
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Cuts a text column (null counts as empty) between rows into pieces of about `limit` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(n, max(last, first + 1), first + SLICE_ROWS)
        yield Slice(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


class _Powers:
    """Powers of the multiplier and of its inverse, grown as longer slices come."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            size = max(n, SLICE_BYTES + 1)
            up = np.full(size, _MULTIPLIER)
            down = np.full(size, _INVERSE)
            up[0] = down[0] = 1
            cls.up, cls.down = np.cumprod(up), np.cumprod(down)
        return cls.up[:n], cls.down[:n]


def words(piece: Slice, word_bytes: np.ndarray = SPACED, lower: bool = False) -> Words:
    """Maximal runs of word bytes, in order, none across two rows, each with a 64-bit hash of its bytes.

    `lower` lets A-Z count as a-z; nothing else changes case.
    """
    data, offsets = piece.data, piece.offsets
    n = len(data)
    inside = word_bytes[data]
    if lower and not word_bytes[ord("A")]:
        inside |= (data >= ord("A")) & (data <= ord("Z"))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[edge[:n]] = False
    start = np.flatnonzero(inside & ~before)
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    after[edge[1:]] = False
    end = np.flatnonzero(inside & ~after) + 1
    row = np.searchsorted(offsets, start, side="right") - 1
    up, down = _Powers.of(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((_LOWER if lower else _PLAIN)[data] * up[:n], out=sums[1:])
    return Words(start, end, row, mix((sums[end] - sums[start]) * down[start]))


def ngrams(hashes: np.ndarray, row: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every n words in a row, and the positions (of the first word) at which they stand."""
    count = len(hashes) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:count] == row[n - 1 :])
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        total = total * _MULTIPLIER + hashes[at + k]
    return mix(total), at


def per_row(row: np.ndarray, rows: int, weights: np.ndarray | None = None) -> np.ndarray:
    """How many entries (or which sum of weights) each row has."""
    return np.bincount(row, weights, minlength=rows)


def starts(counts: np.ndarray) -> np.ndarray:
    """Offsets of runs of the given lengths, one more than there are runs."""
    out = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=out[1:])
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """The different values, in order. Sorting is far faster here than numpy's own unique."""
    values = np.sort(values)
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return values[new]

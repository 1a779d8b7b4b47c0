"""Vectorised word and shingle hashing over Arrow string columns.

A column of strings is one byte buffer with offsets.  Prefix sums of
``code[byte] * BASE**i`` (modulo 2**64) give the hash of any slice of the buffer
by a subtraction and a multiplication, so a whole batch is hashed with a handful
of numpy passes and no per-word Python.  Batches are cut into chunks of about
``CHUNK`` bytes, which bounds the temporaries whatever the size of an Arrow batch.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 18
U64 = np.uint64

_rng = np.random.Generator(np.random.PCG64(20240607))
#: A random 64-bit code for each byte value.
CODE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U64(2) + U64(1)
BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1342543DE82EF95

#: Bytes that end a word: ASCII white space, or every ASCII byte that is no letter or digit.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
PUNCT = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i < n (at least); kept for the next call."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, CHUNK + (CHUNK >> 2))
        up = np.full(size, base, np.uint64)
        down = np.full(size, pow(base, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        have = (np.multiply.accumulate(up), np.multiply.accumulate(down))
        if size <= 64 * CHUNK:
            _tables[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """splitmix64's finaliser: spreads a linear hash over all 64 bits."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(base, len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def slices(pre: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Mixed hashes of ``values[start:end]`` from their prefix sums; the length takes part."""
    raw = (pre[end] - pre[start]) * powers(base, len(pre))[1][start]
    return mix(raw + (end - start).astype(np.uint64) * U64(0xA0761D6478BD642F))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and int64 offsets (len + 1) of a string or binary array; null has length 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    large = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64 if large else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """The words of rows ``first .. first + rows`` of a batch."""

    first: int
    rows: int
    start: np.ndarray  # byte offsets within the chunk
    end: np.ndarray
    hash: np.ndarray
    bound: np.ndarray  # words before each row, len rows + 1
    row_byte: np.ndarray  # byte offset of each row within the chunk, len rows + 1
    data: np.ndarray


def chunks(column: pa.Array, breaks: np.ndarray = SPACE, limit: int = CHUNK) -> Iterator[Words]:
    """Words of the column in chunks of whole rows, ``limit`` bytes or one longer row each."""
    data, offsets = buffers(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], breaks, i)
        i = j


def words(data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, first: int = 0) -> Words:
    solid = ~breaks[data]
    opens = solid.copy()
    opens[1:] &= ~solid[:-1]
    closes = solid.copy()
    closes[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    opens[inner] |= solid[inner]
    closes[inner - 1] |= solid[inner - 1]
    start = np.flatnonzero(opens)
    end = np.flatnonzero(closes) + 1
    pre = prefix(CODE[data], BASE)
    return Words(first, len(offsets) - 1, start, end, slices(pre, start, end, BASE), np.searchsorted(start, offsets), offsets, data)


def shingles(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles and the row (in the chunk) of each.

    A row of fewer than n words (but one at least) has one shingle, of all its words.
    """
    counts = np.diff(w.bound)
    take = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(w.rows), take)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(take) - take, take)
    start = w.bound[:-1][row] + pos
    end = np.minimum(start + n, w.bound[1:][row])
    return slices(prefix(w.hash, WORD_BASE), start, end, WORD_BASE), row


try:  # arrays of 8 MB and more go back to the machine when they are freed
    _trim = ctypes.CDLL(None).malloc_trim
    ctypes.CDLL(None).mallopt(-3, 8 << 20)
except (AttributeError, OSError):  # another C library
    _trim = None


def release() -> None:
    """Gives memory that a batch has freed back to the machine: idle workers stay alive between stages, beside those of the next."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)

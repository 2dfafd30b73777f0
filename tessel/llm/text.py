"""Vectorised word splitting and hashing of whole texts with numpy.

Texts arrive as Arrow string columns.  A block of documents (a few MB of text) is
handled as one byte buffer, so the cost per document stays small and the memory
per block stays bounded; a single longer document makes a block of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
#: Odd multipliers; one pair for each independent hash of runs.
_ODD = ((U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F)), (U64(0xD6E8FEB86659FD93), U64(0xFF51AFD7ED558CCD)))
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
_LOW_BYTES = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)

#: Bytes of words: everything but space and \x09-\x0D.
NOT_SPACE = np.ones(256, dtype=bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False

#: Bytes of words: ASCII letters and digits, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the whole word."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes buf[start:end] of each span.

    Eight bytes at a time, mixed after each step: no polynomial, whose collisions some
    patterns reach whatever its base.
    """
    left = (ends - starts).astype(np.int64)
    out = mix64(left.astype(U64) * _ODD[0][0] + _ODD[1][0])
    eight = np.ndarray(len(buf) + 1, dtype="<u8", buffer=np.concatenate([buf, np.zeros(8, dtype=np.uint8)]), strides=(1,))
    own, at = np.arange(len(left)), np.asarray(starts, dtype=np.int64)
    for k in np.flatnonzero(left > LONG_WORD).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(buf[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
    some = (left > 0) & (left <= LONG_WORD)
    own, at, left = own[some], at[some], left[some]
    while len(own):
        chunk = eight[at] & _LOW_BYTES[np.minimum(left, 8)]
        out[own] = mix64((out[own] ^ chunk) * _ODD[0][1] + _ODD[1][1])
        more = left > 8
        own, at, left = own[more], at[more] + 8, left[more] - 8
    return out


def hashed(words: list[bytes]) -> np.ndarray:
    """The hashes of words, as Block.hashes gives them."""
    limits = np.cumsum([0, *map(len, words)])
    return word_hashes(np.frombuffer(b"".join(words), dtype=np.uint8), limits[:-1], limits[1:])


def run_hashes(values: np.ndarray, size: int, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each run of size consecutive values.

    Runs of 1, 2, 4, ... values are mixed pairwise, and those that make up size put together.
    """
    n = len(values) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    a, b = _ODD[which]
    part, width, taken = mix64(values.astype(U64) + a), 1, 0
    out = np.full(n, U64(size), dtype=U64) * b
    while True:
        if size & width:
            out = mix64(out * a + part[taken : taken + n])
            taken += width
        if 2 * width > size:
            return out
        part = mix64(part[:-width] * b + part[width:])
        width *= 2


class Block:
    """Consecutive rows of a batch: their words and word hashes.

    buf holds the bytes, offsets the rows' limits in it, starts and ends the words'
    limits, first the index of each row's first word (one more entry at the end).
    """

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool):
        self.buf = _LOWER[buf] if lower else buf
        self.offsets = offsets
        inside = table[self.buf]
        begin, end = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        end[:-1] &= ~inside[1:]
        full = offsets[1:] > offsets[:-1]
        at, last = offsets[:-1][full], offsets[1:][full] - 1
        begin[at] = inside[at]
        end[last] = inside[last]
        self.starts = np.flatnonzero(begin)
        self.ends = np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def hashes(self) -> np.ndarray:
        return word_hashes(self.buf, self.starts, self.ends)

    def word_rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self)), np.diff(self.first))

    def words(self, row: int) -> list[bytes]:
        lo, hi = self.first[row], self.first[row + 1]
        raw = self.buf[self.offsets[row] : self.offsets[row + 1]].tobytes()
        base = self.offsets[row]
        return [raw[a:b] for a, b in zip((self.starts[lo:hi] - base).tolist(), (self.ends[lo:hi] - base).tolist(), strict=True)]


def as_strings(column: pa.Array) -> pa.Array:
    """Strings with 64-bit offsets; null becomes empty."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(column: pa.Array, max_bytes: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows with about max_bytes of text."""
    col = as_strings(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    if not n:
        return
    _, where, data = col.buffers()
    limits = np.frombuffer(where, dtype=np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(limits, limits[lo] + max_bytes, side="right")) - 1
        hi = min(max(hi, lo + 1), n, lo + 20_000)
        yield lo, hi, raw[limits[lo] : limits[hi]], limits[lo : hi + 1] - limits[lo]
        lo = hi


def blocks(column: pa.Array, table: np.ndarray, lower: bool = False, max_bytes: int = 1 << 20) -> Iterator[tuple[int, int, Block]]:
    for lo, hi, buf, offsets in buffers(column, max_bytes):
        yield lo, hi, Block(buf, offsets, table, lower)


def long_list(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """list<int64> from concatenated 64-bit values and the size of each list."""
    offsets = np.zeros(len(sizes) + 1, dtype=np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(values).view(np.int64)))

"""Vectorised views of the texts in an Arrow batch.

Texts stay in the batch's own UTF-8 buffer. Words are found and hashed with
array operations over chunks of a bounded number of bytes; only a single text
longer than the bound makes a chunk larger.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20

#: ASCII upper case to lower case; every other byte stays.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_table(breaks: Iterator[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[list(breaks)] = False
    return table


#: Words are runs of anything but the space and the five ASCII controls 9 to 13.
SPACED = word_table([0x20, *range(0x09, 0x0E)])
#: Words are runs of digits, lower-case letters and everything beyond ASCII (upper case is lowered before).
ALNUM = word_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

_MIX = np.uint64(0xD6E8FEB86659FD93)
#: The lowest k bytes of 64 bits, for k from 0 to 8.
_BYTES = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Bytes of a run that are their own key, with their number.
OWN = 15


def mix(h: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit values over all bits."""
    h = (h ^ (h >> np.uint64(32))) * _MIX
    h = (h ^ (h >> np.uint64(29))) * _MIX
    return h ^ (h >> np.uint64(32))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, offsets and validity of a string or binary column; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    n = len(column)
    if at is None or n == 0:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    valid = np.asarray(column.is_valid()) if column.null_count else np.ones(n, bool)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), offsets, valid


def keys_of(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit keys of runs of bytes, in halves.

    A run of up to OWN bytes is its own key: its bytes and their number. A
    longer one has a BLAKE2b digest of 120 bits, marked in the last byte.
    """
    padded = np.concatenate([raw, np.zeros(24, np.uint8)])
    eight = np.ndarray(len(raw) + 16, "<u8", padded, strides=(1,))  # the 8 bytes from each position on
    size = end - start
    first = eight[start] & _BYTES[np.minimum(size, 8)]
    second = eight[start + 8 * (size > 8)] * (size > 8).astype(np.uint64) & _BYTES[np.clip(size - 8, 0, 7)]
    second |= np.minimum(size, OWN).astype(np.uint64) << np.uint64(56)
    long = np.flatnonzero(size > OWN)
    if len(long):
        view = memoryview(np.ascontiguousarray(raw))
        digests = b"".join([hashlib.blake2b(view[a:b], digest_size=16).digest() for a, b in zip(start[long].tolist(), end[long].tolist(), strict=True)])
        halves = np.frombuffer(digests, "<u8").reshape(-1, 2)
        first[long], second[long] = halves[:, 0], halves[:, 1] | np.uint64(0xFF << 56)
    return first, second


def hashes_of(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64 bits of 128-bit keys."""
    return mix(first + mix(second))


def distinct(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different ones of 128-bit values, in order; halves may be equal where values aren't."""
    order = np.argsort(first, kind="stable")
    x, y = first[order], second[order]
    same = x[1:] == x[:-1]
    other = y[1:] != y[:-1]
    if (same & other).any():
        order = np.lexsort((second, first))
        x, y = first[order], second[order]
        same, other = x[1:] == x[:-1], y[1:] != y[:-1]
    new = np.ones(len(x), bool)
    new[1:] = ~same | other
    return x[new], y[new]


def grouped(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first place of each different 128-bit value, the number of the value at each place)."""
    h = hashes_of(first, second)
    order = np.argsort(h, kind="stable")
    x, y, z = h[order], first[order], second[order]
    same = x[1:] == x[:-1]
    equal = same & (y[1:] == y[:-1]) & (z[1:] == z[:-1])
    if (same & ~equal).any():  # hashes are equal where values aren't
        order = np.lexsort((second, first))
        y, z = first[order], second[order]
        equal = (y[1:] == y[:-1]) & (z[1:] == z[:-1])
    new = np.ones(len(order), bool)
    new[1:] = ~equal
    own = np.empty(len(order), np.int64)
    own[order] = np.cumsum(new) - 1
    return order[new], own


class Known:
    """128-bit keys met before, each with a number. A key whose hash another one holds is never kept, so it is never found."""

    def __init__(self):
        self.hashes, self.first, self.second, self.number = (np.zeros(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64))

    def find(self, first: np.ndarray, second: np.ndarray) -> np.ndarray:
        """The number of each key, or -1."""
        if not len(self.hashes):
            return np.full(len(first), -1, np.int64)
        h = hashes_of(first, second)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        same = (self.hashes[at] == h) & (self.first[at] == first) & (self.second[at] == second)
        return np.where(same, self.number[at], -1)

    def add(self, first: np.ndarray, second: np.ndarray, number: np.ndarray) -> None:
        """Keep different keys that weren't found."""
        h = np.concatenate([self.hashes, hashes_of(first, second)])
        order = np.argsort(h, kind="stable")
        order = order[np.concatenate([[True], h[order][1:] != h[order][:-1]])] if len(h) else order
        self.hashes = h[order]
        self.first, self.second, self.number = (np.concatenate(x)[order] for x in ((self.first, first), (self.second, second), (self.number, number)))


@dataclass
class Words:
    """The words of consecutive texts: a chunk's lowered bytes, word bounds in it, and the first word of each text."""

    low: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # words of text i: first[i] .. first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """The 128-bit key of each word, in halves: see keys_of."""
        return keys_of(self.low, self.start, self.end)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word, the same in every process. Different words may share one; their keys differ."""
        return hashes_of(*self.keys())

    def word(self, k: int) -> bytes:
        return self.low[self.start[k] : self.end[k]].tobytes()


def split_words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool = True) -> Words:
    """Words of the texts bounded by offsets; a word never spans two texts."""
    base = offsets[0]
    low = data[base : offsets[-1]]
    if lower:
        low = LOWER[low]
    inside = table[low]
    at = offsets - base
    inner = at[(at > 0) & (at < len(low))]
    begin, close = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    begin[inner] = inside[inner]
    close[:-1] &= ~inside[1:]
    close[inner - 1] = inside[inner - 1]
    start = np.flatnonzero(begin)
    return Words(low, start, np.flatnonzero(close) + 1, np.searchsorted(start, at))


def chunks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most limit bytes each, or of one row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of values[first[i]:first[i + 1]] for each i, empty ranges included."""
    total = np.zeros(len(values) + 1, values.dtype if values.dtype.kind in "iuf" else np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


_STEP, _OTHER = np.uint64(0xA24BAED4963EE407), np.uint64(0x9E3779B97F4A7C15)


def _folded(h: np.ndarray, length: int, step: np.uint64) -> np.ndarray:
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = h[:n].copy()
    for k in range(1, length):
        total *= step
        total += h[k : n + k]
    return mix(total + np.uint64(length))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of length word hashes."""
    return _folded(h, length, _STEP)


def window_keys(first: np.ndarray, second: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits, in halves, of each run of length words, from the words' keys; the halves mix these in two ways."""
    return _folded(hashes_of(first, second), length, _STEP), _folded(mix(second * _OTHER + mix(first ^ _OTHER)), length, _OTHER)

"""Vectorised word splitting and rolling hashes over Arrow string columns.

A word is a run of bytes outside ``[\\x20\\x09-\\x0D]``. All hashes are 64-bit polynomial
hashes modulo 2**64 with an odd base, so a prefix sum and the inverse powers give the
hash of any range in constant time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_rng = np.random.default_rng(20240229)
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for k, b in enumerate((_BASE, _BASE_INV)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ np.uint64((seed * 0xD1B54A32D192ED03 + 0x632BE59BD9B4E019) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values weighted by the powers of the base; one longer than values."""
    out = np.zeros(len(values) + 1, np.uint64)
    if len(values):
        np.cumsum(values * powers(len(values))[0], out=out[1:])
    return out


def ranges(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of [start, end) from the prefix sums p."""
    return mix((p[end] - p[start]) * powers(len(p))[1][start])


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    n = len(column)
    offs = np.frombuffer(offsets, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, limit: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges holding about `limit` bytes; a longer row stands alone."""
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


class Words:
    """Words of a run of texts: byte ranges, hashes, and the words of each text."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray):
        self.buf, self.offs = buf, offs
        n = len(buf)
        self.space = space = SPACE[buf]
        first = np.zeros(n + 1, bool)
        first[offs] = True
        inside = ~space
        start = inside.copy()
        start[1:] &= space[:-1] | first[1:n]
        last = inside
        if n:
            last = inside.copy()
            last[:-1] &= space[1:] | first[1:n]
        self.start = np.flatnonzero(start)
        self.end = np.flatnonzero(last) + 1
        self.word_offs = np.searchsorted(self.start, offs)
        self.prefix = prefix(BYTE_VALUE[buf])
        self.hash = ranges(self.prefix, self.start, self.end)

    def texts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the chosen words laid end to end, and their offsets."""
        s, length = self.start[which], self.end[which] - self.start[which]
        offs = np.zeros(len(which) + 1, np.int64)
        np.cumsum(length, out=offs[1:])
        at = np.arange(offs[-1]) + np.repeat(s - offs[:-1], length)
        return self.buf[at], offs


def words_of(column: pa.Array, limit: int = 2 << 20, table: np.ndarray | None = None) -> Iterator[tuple[int, int, Words]]:
    """The words of a column, a bounded run of rows at a time; bytes are first replaced by a table, if one is given."""
    buf, offs = utf8(column)
    for i, j in chunks(offs, limit):
        part = buf[offs[i] : offs[j]]
        yield i, j, Words(part if table is None else table[part], offs[i : j + 1] - offs[i])


def windows(hashes: np.ndarray, offs: np.ndarray, size: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of `size` words that lie in one text, and their first words."""
    if len(hashes) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    p = prefix(mix(hashes, seed) if seed else hashes)
    i = np.arange(len(hashes) - size + 1)
    inside = np.searchsorted(offs, i, "right") == np.searchsorted(offs, i + size - 1, "right")
    i = i[inside]
    return ranges(p, i, i + size), i


def sums(values: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sums of the values between successive offsets."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]

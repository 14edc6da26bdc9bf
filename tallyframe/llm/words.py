"""Vectorised word hashing of Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a polynomial over a random
table of its bytes modulo 2**64, finished by a bijective mixer; equal words have equal hashes everywhere, and
the tables come from fixed seeds, so hashes agree between executors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U64 = np.uint64
BASE = U64(0x9E3779B97F4A7C15)
BASE_INVERSE = U64(pow(int(BASE), -1, 1 << 64))
TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
FOLDED = TABLE.copy()
FOLDED[ord("A") : ord("Z") + 1] = TABLE[ord("a") : ord("z") + 1]
BREAK = np.zeros(256, bool)
BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


class Powers:
    """Powers of a 64-bit odd base and of its inverse, extended as longer inputs come."""

    def __init__(self, base: np.uint64, inverse: np.uint64, least: int = 2 * CHUNK_BYTES) -> None:
        self.base, self.inverse, self.least, self.up, self.down = base, inverse, least, np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, self.least)
            for name, by in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, by, U64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


POWERS = Powers(BASE, BASE_INVERSE)


@dataclass
class Words:
    """Words of the rows ``first`` to ``last`` of a batch: hashes, byte bounds, and each row's word bounds."""

    first: int
    last: int
    data: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of a string column; null rows are empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def word_chunks(column: pa.Array, fold: bool) -> Iterator[Words]:
    """The words of every row, whole rows at a time and about ``CHUNK_BYTES`` at once; ``fold`` maps A-Z to a-z."""
    data, offsets = text_buffer(column)
    table, n, first = FOLDED if fold else TABLE, len(offsets) - 1, 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, n)
        part, at = data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        yield hash_words(part, at, first, last, table)
        first = last


def hash_words(part: np.ndarray, at: np.ndarray, first: int, last: int, table: np.ndarray) -> Words:
    n = len(part)
    solid = np.zeros(n + 1, bool)
    np.logical_not(BREAK[part], out=solid[:n])
    before = np.zeros(n + 1, bool)
    before[1:] = solid[:n]
    before[at] = False
    opens = solid & ~before
    after = np.zeros(n + 1, bool)
    after[:n] = solid[1:]
    inner = at[(at > 0) & (at <= n)]
    after[inner - 1] = False
    closes = solid & ~after
    starts, ends = np.flatnonzero(opens[:n]), np.flatnonzero(closes[:n]) + 1
    up, down = POWERS.get(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(table[part] * up[:n], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * down[starts])
    return Words(first, last, part, hashes, starts, ends, np.searchsorted(starts, at))


def rolling(hashes: np.ndarray, k: int, seed: int) -> np.ndarray:
    """A hash of every ``k`` consecutive values (row bounds are the caller's)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    factors = np.random.default_rng(seed).integers(1, 1 << 63, k, dtype=np.uint64) * U64(2) + U64(1)
    out = np.zeros(n, U64)
    for i in range(k):
        out += hashes[i : i + n] * factors[i]
    return mix(out)

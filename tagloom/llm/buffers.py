"""Whole Arrow columns of text as flat byte arrays, and hashes of pieces of them.

All hashing is done with numpy over slices of a column, so no Python object is
made per word or per byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text worked on at once; a longer text makes a slice of its own.
SLICE = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_TABLE = np.random.default_rng(20260101).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit words as numbers from 0 to below 1."""
    return (x >> U64(11)).astype(np.float64) * 2.0**-53


class Powers:
    """Powers of the hash base and of its inverse, as many as were asked for."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << (n - 1).bit_length()
            self.up, self.down = (
                np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size - 1, base, np.uint64)]))
                for base in (_BASE, _INVERSE)
            )
        return self.up, self.down


POWERS = Powers()


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums ``s`` and factors ``f``: ``(s[j] - s[i]) * f[i]`` depends on bytes i..j-1 only."""
    return prefix_sums(_TABLE[data])


def prefix_sums(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for a sequence of 64-bit numbers."""
    up, down = POWERS.upto(len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return sums, down


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string or binary column and the offsets of its rows; null counts as empty."""
    kind = column.type
    if not (pa.types.is_string(kind) or pa.types.is_binary(kind)):
        column = column.cast(pa.string() if pa.types.is_large_string(kind) else pa.binary())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    flat = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return flat[ends[0] : ends[-1]], ends - ends[0]


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes each, at least one row each."""
    at, rows = 0, len(offsets) - 1
    while at < rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield at, to
        at = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of all words: runs of bytes without ASCII white space."""
    solid = ~_SPACE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] = solid[cuts]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and row of every word."""
    starts, ends, rows = words(data, offsets)
    sums, down = prefix_hash(data)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64)), rows


def grams(hashes: np.ndarray, rows: np.ndarray, size: int, short: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and first word of every run of ``size`` words inside a row.

    ``short``: a row of fewer words gives one run of all its words.
    """
    n = len(hashes)
    if n == 0:
        return hashes, rows, np.zeros(0, np.int64)
    total = np.zeros(n, np.uint64)
    padded = np.concatenate([hashes, np.zeros(size, np.uint64)])
    for j in range(size):
        total += mix(padded[j : j + n] + U64(j + 1)) * U64(2 * j + 3)
    at = np.flatnonzero(np.concatenate([rows, np.full(size, -1)])[size - 1 : size - 1 + n] == rows)
    out, out_rows = mix(total[at]), rows[at]
    if short:
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        counts = np.diff(np.append(first, n))
        few = first[counts < size]
        if len(few):
            made = np.zeros(len(few), np.uint64)
            for j in range(size - 1):
                has = counts[counts < size] > j
                made[has] += mix(hashes[few[has] + j] + U64(j + 1)) * U64(2 * j + 3)
            out = np.concatenate([out, mix(made ^ U64(_BASE))])
            out_rows, at = np.concatenate([out_rows, rows[few]]), np.concatenate([at, few])
    return out, out_rows, at

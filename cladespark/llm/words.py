"""Words and shingles of Arrow text columns as NumPy arrays of 64-bit hashes, without a Python loop over words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for first, last in ranges:
        out[first : last + 1] = True
    return out


#: Bytes of words, by kind; the text is lower-cased (A-Z only) before.
ALPHANUMERIC = _mask((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
NON_SPACE = ~_mask((0x20, 0x20), (0x09, 0x0D))

_rng = np.random.default_rng(20260101)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = (np.ones(1, np.uint64), np.ones(1, np.uint64))


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if len(_powers[0]) < n:
        size = max(n, 1 << 20)
        made = []
        for factor in (_BASE, _INVERSE):
            steps = np.full(size, np.uint64(factor), np.uint64)
            steps[0] = 1
            made.append(np.cumprod(steps, dtype=np.uint64))
        _powers = (made[0], made[1])
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values whose output bits all depend on all input bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Words:
    """Words of the rows ``first_row ...`` of a batch: ``bounds[i]:bounds[i + 1]`` are those of row ``first_row + i``."""

    first_row: int
    bounds: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray  #: byte offsets into ``data``
    ends: np.ndarray
    data: np.ndarray  #: lower-cased bytes of these rows
    row_starts: np.ndarray  #: byte offset of each row in ``data``

    @property
    def rows(self) -> int:
        return len(self.bounds) - 1

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(self.rows), np.diff(self.bounds))


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.empty(0, np.uint8)
    return data, offsets


def words(column: pa.Array, kind: np.ndarray, chunk_bytes: int = 1 << 20) -> Iterator[Words]:
    """Words of whole texts, some rows at a time (a text longer than ``chunk_bytes`` makes a chunk of its own)."""
    if not len(column):
        return
    data, offsets = text_buffers(column)
    first = 0
    while first < len(offsets) - 1:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + chunk_bytes, "right")) - 1)
        last = min(last, len(offsets) - 1)
        yield _chunk(_LOWER[data[offsets[first] : offsets[last]]], offsets[first : last + 1] - offsets[first], kind, first)
        first = last


def _chunk(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray, first: int) -> Words:
    inside = kind[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    before = np.concatenate(([False], inside[:-1])) if len(data) else inside
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate((inside[1:], [False])) if len(data) else inside
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    power, inverse = power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * inverse[starts])
    return Words(first, np.searchsorted(starts, offsets), hashes, starts, ends, data, offsets)


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words; empty if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = 1
    for k in range(size):
        factor = factor * _INVERSE % (1 << 64)
        total += hashes[k : k + n] * np.uint64(factor)
    return mix(total)


def shingle_sets(chunk: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each row, sorted by hash in each, and their bounds; a row with fewer words than ``size``, but not none, has its whole sequence as its only shingle."""
    counts = np.diff(chunk.bounds)
    hashes = windows(chunk.hashes, size)
    at = np.arange(len(hashes))
    row = chunk.row_of()
    whole = row[at] == row[at + size - 1] if len(hashes) else np.empty(0, bool)
    hashes, row = hashes[whole], row[at][whole]
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        single = np.array([windows(chunk.hashes[chunk.bounds[r] : chunk.bounds[r + 1]], counts[r])[0] for r in short], np.uint64)
        hashes, row = np.concatenate([hashes, single]), np.concatenate([row, short])
    order = np.lexsort((hashes, row))
    hashes, row = hashes[order], row[order]
    if len(hashes):
        fresh = np.concatenate(([True], (hashes[1:] != hashes[:-1]) | (row[1:] != row[:-1])))
        hashes, row = hashes[fresh], row[fresh]
    return hashes, np.searchsorted(row, np.arange(chunk.rows + 1))

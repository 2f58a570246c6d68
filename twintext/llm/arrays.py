"""Vectorised text helpers for Arrow batches: bytes, tokens and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; a single longer text is taken alone.
BLOCK = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers = np.ones(1, np.uint64)

# Byte classes of words: ASCII letters, digits and all bytes of other characters.
WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
# In UTF-8 the no-break space and general punctuation are C2 A0 and E2 80 xx: they stay in words here.


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; nulls are empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column, ""))


def row_blocks(offsets: np.ndarray, limit: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes, or a single row."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        full = np.full(max(n, 4096), _BASE, np.uint64)
        full[0] = 1
        _powers = np.multiply.accumulate(full)
    return _powers


def mixed(h: np.ndarray, seed: int = 0) -> np.ndarray:
    """Finalises 64-bit hashes (the splitmix64 finaliser)."""
    h = h + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def tokens(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = WORD_BYTE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, start bytes and lengths of maximal runs of ``inside`` bytes; runs end with their text."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    keep = inside[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = keep.copy()
    begin[1:] &= ~keep[:-1] | first[1:-1]
    starts = np.flatnonzero(begin)
    if not len(starts):
        return np.zeros(0, np.uint64), starts, starts
    last = keep.copy()
    last[:-1] &= ~keep[1:] | first[1:-1]
    lengths = np.flatnonzero(last) + 1 - starts
    at = np.flatnonzero(keep)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    within = np.arange(len(at)) - np.repeat(begins, lengths)
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[within]
    return mixed(np.add.reduceat(terms, begins)), starts, lengths


def rows_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row in which each byte position lies."""
    return np.searchsorted(offsets, starts, "right") - 1


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values[bounds[i]:bounds[i + 1]]."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[bounds[1:]] - total[bounds[:-1]]

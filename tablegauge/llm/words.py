"""Words of many texts at once, as numpy arrays over one byte buffer.

A word is a run of bytes other than space, tab, line feed, vertical tab, form
feed and carriage return. All functions take the UTF-8 bytes of several texts in
one buffer and the offsets that part them, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLANK = np.zeros(256, dtype=bool)
BLANK[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
# Texts are handled in slices of about this many bytes, which bounds a task's memory;
# a longer text is a slice of its own.
SLICE_BYTES = 2_000_000


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a text column; a null text is empty."""
    column = column.cast(pa.large_string()) if column.type != pa.large_string() else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose texts hold about ``most`` bytes."""
    _, at = buffers(column)
    low = 0
    while low < len(column):
        high = max(low + 1, int(np.searchsorted(at, at[low] + most, side="right")) - 1)
        yield low, min(high, len(column))
        low = high


def spans(data: np.ndarray, at: np.ndarray, blank: np.ndarray = BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and per text the index of its first word (one more than texts).

    ``blank`` marks the bytes that part words.
    """
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(at), np.int64)
    inside = ~blank[data]
    edge = at[:-1][at[:-1] < len(data)]
    opens = inside.copy()
    opens[1:] &= ~inside[:-1]
    opens[edge] = inside[edge]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = at[1:][at[1:] > 0] - 1
    closes[last] = inside[last]
    starts = np.flatnonzero(opens)
    return starts, np.flatnonzero(closes) + 1, np.searchsorted(starts, at)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


_factors = np.random.default_rng(7).integers(0, 2**64, size=256, dtype=np.uint64) | np.uint64(1)


def factors(n: int) -> np.ndarray:
    """The first ``n`` numbers of one fixed pseudo-random row of odd numbers."""
    global _factors
    if n > len(_factors):
        size = 1 << int(n).bit_length()
        _factors = np.random.default_rng(7).integers(0, 2**64, size=size, dtype=np.uint64) | np.uint64(1)
    return _factors[:n]


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank: np.ndarray = BLANK) -> np.ndarray:
    """A 64-bit hash of each word's bytes (multilinear, then mixed)."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    low, high = starts[0], ends[-1]
    begins = np.zeros(high - low, dtype=np.int64)
    begins[starts - low] = np.diff(np.concatenate(([0], starts - low)))
    place = np.arange(high - low, dtype=np.int64) - np.cumsum(begins)
    row = factors(int(lengths.max()) + 1)
    # bytes between words fall past a word's end: they count nothing
    gap = blank[data[low:high]]
    place[gap] = 0
    value = (data[low:high].astype(np.uint64) + np.uint64(1)) * row[place]
    value[gap] = 0
    return mixed(np.add.reduceat(value, starts - low) + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))

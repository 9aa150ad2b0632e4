"""Batches of texts as flat numpy arrays: spans of words and their hashes.

A chunk is a byte array holding several whole texts one after the other, with
``offsets`` that say where each begins. All work on words is done for a whole chunk at
once; a text is never cut, so a chunk is as long as its longest text at least.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_ODD = 0x9E3779B97F4A7C15
#: The first 0 ... 8 bytes of eight.
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)

#: Bytes between words: space, and tab to carriage return.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of consecutive rows; null texts count as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    values = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    low = 0
    while low < n:
        high = min(n, max(low + 1, int(np.searchsorted(offsets, offsets[low] + limit, "right")) - 1))
        yield low, high, values[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low]
        low = high


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in lower case, all other bytes as they are."""
    return _LOWER[data]


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between white space, and how many words lie before each text."""
    solid = ~IS_SPACE[data]
    if not len(solid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    first[cuts] = solid[cuts]
    cuts = cuts[cuts > 0] - 1
    last[cuts] = solid[cuts]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, the same wherever the span lies.

    Each eight bytes are mixed with their place before they are added up, so no pattern of
    the bytes makes sums equal. Another seed gives an independent hash.
    """
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place on
    size = ends - starts
    keys = mixed(np.array([2 * seed + 1, 2 * seed + 2], np.uint64))
    out = mixed(eight[starts] & _FIRST[np.minimum(size, 8)] ^ keys[0])
    long = np.flatnonzero(size > 8)
    if len(long):
        more = size[long] - 1 >> 3
        place = flat_ranges(np.ones(len(long), np.int64), more)
        at = np.repeat(starts[long], more) + 8 * place
        left = np.minimum(np.repeat(ends[long], more) - at, 8)
        out[long] += np.add.reduceat(mixed(eight[at] & _FIRST[left] ^ mixed(place.astype(np.uint64) + keys[1])), np.cumsum(more) - more)
    return mixed(out + size.astype(np.uint64) * np.uint64(_ODD))


def distinct_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """Two hashes of each different span, sorted by the first, one span that has them, and which of them each span has.

    None if two different spans have the same first hash: another seed tells them apart.
    """
    one, two = span_hashes(data, starts, ends, seed), span_hashes(data, starts, ends, ~seed & 0xFFFF_FFFF)
    unique, first, back = np.unique(one, return_index=True, return_inverse=True)
    return (unique, two[first], first, back) if (two[first][back] == two).all() else None


def told_apart(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """`distinct_spans` with the first seed that will do."""
    return next(d for seed in count() if (d := distinct_spans(data, starts, ends, seed)) is not None)


def flat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one range after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    before = np.cumsum(lengths) - lengths
    return np.arange(total) + np.repeat(starts - before, lengths)

"""Words and rolling fingerprints of whole Arrow batches of text, with numpy only.

A word is a run of bytes other than 0x20 and 0x09-0x0D. No byte of a multi-byte UTF-8 character is
one of those, so splitting bytes is splitting characters.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from chartloom.llm.store import row_slices

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

BASE = 0x9E3779B97F4A7C13 | 3          # odd, so that it has an inverse mod 2^64
STEP = np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


@lru_cache(maxsize=2)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64 for i <= n."""
    up = np.full(n + 1, BASE & (2**64 - 1), dtype=np.uint64)
    down = np.full(n + 1, pow(BASE, -1, 2**64), dtype=np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def views(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, row offsets into them) for slices of a string column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    for start, stop in row_slices(np.diff(offsets), limit):
        yield start, stop, data[offsets[start]:offsets[stop]], offsets[start:stop + 1] - offsets[start]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and for each row the number of words before it."""
    n = len(data)
    space = SPACE[data]
    starts, ends = ~space, ~space
    filled = np.diff(offsets) > 0
    at_start, at_end = offsets[:-1][filled], offsets[1:][filled] - 1
    if n:
        keep_start, keep_end = starts[at_start], ends[at_end]
        starts[1:] &= space[:-1]
        ends[:-1] &= space[1:]
        starts[at_start], ends[at_end] = keep_start, keep_end
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each word."""
    n = len(data)
    up, down = _powers(max(SLICE_BYTES, 1 << max(0, n - 1).bit_length()))
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(BYTE_VALUES[data] * up[:n], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * STEP)


def rolling(words: np.ndarray, width: int) -> np.ndarray:
    """Fingerprint of each run of `width` values, by doubling; max(0, n - width + 1) of them."""
    if len(words) < width:
        return np.zeros(0, dtype=np.uint64)
    total, done, power, size, block = None, 0, int(STEP), 1, words
    left = width
    while left:
        if left & 1:
            # what is done so far covers [i, i + done); the block covers [i + done, i + done + size)
            part = block[done:]
            if total is None:
                total = part
            else:
                n = min(len(total), len(part))
                total = total[:n] * np.uint64(pow(int(STEP), size, 2**64)) + part[:n]
            done += size
        left >>= 1
        if left:
            block = block[:-size] * np.uint64(power) + block[size:] if len(block) > size else block[:0]
            power = pow(power, 2, 2**64)
            size *= 2
    return mix(total[:len(words) - width + 1] + np.uint64(width))

"""64-bit hashes of the words of many texts at once.

A word is a maximal run of bytes that a 256-entry table keeps; A-Z is
lower-cased by the same table.  The hash of a word is a polynomial in its bytes
modulo 2**64, taken as a difference of prefix sums, mixed with its length; two
different words share one with a chance near 2**-64.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


#: Bytes of words that end at space and 0x09-0x0D.
SPACED = ~np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x = x * _M2
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=3)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, _INVERSE, np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def words_of(data: np.ndarray, offsets: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, ...]:
    """``(hashes, starts, ends, per_row)`` of the words of the texts
    ``data[offsets[i]:offsets[i + 1]]``: byte positions from ``data[0]`` and each
    row's number of words.  ``offsets`` starts at 0."""
    data = lower_table()[data]
    inside = kept[data]
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    borders = offsets[(offsets > 0) & (offsets < len(data))]
    before[borders] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    after[borders - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    size = 1 << max(20, int(len(data)).bit_length())
    up, down = _powers(size)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes = mix(hashes + (ends - starts).astype(np.uint64) * _M3)
    per_row = np.diff(np.searchsorted(starts, offsets))
    return hashes, starts, ends, per_row


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each ``size`` consecutive words; one for each start that has that many after it."""
    if len(words) < size:
        return np.empty(0, np.uint64)
    if size <= 8:
        out = np.zeros(len(words) - size + 1, np.uint64)
        for i in range(size):
            out = out * _M3 + words[i : i + len(out)]
        return mix(out + np.uint64(size))
    up, down = _powers(1 << max(16, len(words).bit_length()))
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[: len(words)], out=sums[1:])
    return mix((sums[size:] - sums[:-size]) * down[: len(words) - size + 1] + np.uint64(size))

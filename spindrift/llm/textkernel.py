"""Words of UTF-8 texts and their 64-bit hashes, a whole batch of texts at a time in NumPy.

A word is a run of bytes other than 0x20 and 0x09 to 0x0D. Its hash is a polynomial over random byte
values modulo 2^64, passed through a mixer; with `fold`, A to Z count as a to z. Two different words
share a hash with probability of about 2^-64.
"""

from __future__ import annotations

import numpy as np

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_BYTE = np.random.default_rng(20240229).integers(0, 1 << 63, 256, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


class _Powers:
    def __init__(self, base: int) -> None:
        self.base, self.held = base, np.ones(1, np.uint64)

    def __call__(self, n: int) -> np.ndarray:
        if len(self.held) < n:
            size = max(n, 1 << 16)
            steps = np.full(size, self.base, np.uint64)
            steps[0] = 1
            self.held = np.multiply.accumulate(steps)
        return self.held[:n]


_power, _unpower = _Powers(_BASE), _Powers(_INVERSE)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every input bit (the finaliser of SplitMix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_bounds(data: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the words; no word crosses an offset."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~space[data] if space is not SPACE else (data != 0x20) & (data - np.uint8(0x09) > 4)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | edge[1:n]
    end[:-1] &= ~solid[1:] | edge[1:n]
    return np.flatnonzero(start), np.flatnonzero(end) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = True) -> np.ndarray:
    """A 64-bit hash of data[start:end] for each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    values = (_FOLDED if fold else _BYTE)[data]
    values *= _power(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return mix((total[ends] - total[starts]) * _unpower(len(data) + 1)[starts])


def words(data: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, end and hash of every word of a batch."""
    starts, ends = word_bounds(data, offsets)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, starts, ends, span_hashes(data, starts, ends, fold)


def occurrence(group: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each element, how many earlier elements have the same group and key."""
    n = len(key)
    if not n:
        return np.zeros(0, np.int64)
    order = np.lexsort((key, group))
    g, k = group[order], key[order]
    new = np.ones(n, bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    at = np.flatnonzero(new)
    out = np.empty(n, np.int64)
    out[order] = np.arange(n) - np.repeat(at, np.diff(np.append(at, n)))
    return out

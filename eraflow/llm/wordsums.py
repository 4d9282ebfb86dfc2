"""64-bit hashes of words and word shingles, computed on whole Arrow buffers.

A word is a run of bytes other than space and the controls 9 to 13, with A-Z in
lower case. Its hash is a polynomial with random byte values, cut out of running
sums and mixed; a shingle hash combines consecutive word hashes. Equal words have
equal hashes on every machine, and two different ones collide with a chance of
about 2**-64.
"""

from __future__ import annotations

import numpy as np

from .common import by_value

by_value(__name__)

_BASE = 0x9E3779B97F4A7C15 | 1
_SHINGLE = 0xD1342543DE82EF95


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _tables() -> tuple[np.ndarray, np.ndarray]:
    lower = np.arange(256, dtype=np.int64)
    lower[65:91] += 32
    value = mix((lower.astype(np.uint64) + np.uint64(1)) * np.uint64(_BASE))
    blank = np.zeros(256, bool)
    blank[[32, *range(9, 14)]] = True
    return value, blank


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def words(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word, and the number of words before each text.

    ``data`` holds the texts one after another, ``offsets`` where they begin. Works
    through about ``most`` bytes at a time, cut between words.
    """
    value, blank = _tables()
    n = len(data)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    space = blank[data]
    hashes, starts, at = [], [], 0
    inverse = pow(_BASE, -1, 1 << 64)
    while at < n:
        end = min(n, at + most)
        while end < n and not (space[end] or first[end]):
            end += 1
        gap, edge = space[at:end], first[at : end + 1].copy()
        edge[0] = edge[-1] = True
        solid = ~gap
        begin = solid.copy()
        begin[1:] &= gap[:-1] | edge[1:-1]
        close = solid.copy()
        close[:-1] &= gap[1:] | edge[1:-1]
        b, e = np.flatnonzero(begin), np.flatnonzero(close) + 1
        sums = np.zeros(end - at + 1, np.uint64)
        np.cumsum(value[data[at:end]] * powers(end - at, _BASE), out=sums[1:])
        raw = (sums[e] - sums[b]) * powers(end - at, inverse)[b]
        hashes.append(mix(raw + (e - b).astype(np.uint64)))
        starts.append(b + at)
        at = end
    hashed = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    place = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    return hashed, np.searchsorted(place, offsets)


def shingles(hashed: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words of one text; a shorter text is one shingle."""
    n = len(hashed)
    if not n:
        return hashed
    width = min(size, n)
    total = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        total = total * np.uint64(_SHINGLE) + hashed[k : n - width + 1 + k]
    return mix(total)

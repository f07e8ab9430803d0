"""Sets of word shingles as sorted arrays of 64-bit keys."""

from __future__ import annotations

from functools import cache

import numpy as np

WIDTH = 5
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    """Bits spread over the whole word, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def byte_values(fold: bool = True) -> np.ndarray:
    """A random value per byte; with fold A to Z share those of a to z; 0 for what separates words."""
    values = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
    if fold:
        values[65:91] = values[97:123]
    values[[32, *range(9, 14)]] = 0
    return values


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 16, 1 << n.bit_length())
        with np.errstate(over="ignore"):
            _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, x, np.uint64)])) for x in (_ODD, _BACK)]
    return _powers[0][:n], _powers[1][:n]


def words(raw: np.ndarray, of_byte: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of the bytes begin and end, and their hashes."""
    values = of_byte[raw]
    inside = np.concatenate([[False], values != 0, [False]])
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, end = edge[::2], edge[1::2]
    up, down = _power(len(raw) + 1)
    with np.errstate(over="ignore"):
        sums = np.concatenate([[np.uint64(0)], np.cumsum(values * up[:-1])])
        return begin, end, mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The distinct hashes of the word shingles of the whole text, A-Z lowered, rising; with fewer words the whole sequence
    is the one shingle; none without words."""
    _, _, own = words(np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8), byte_values())
    if not len(own):
        return np.zeros(0, np.uint64)
    n = max(1, len(own) - width + 1)
    mixed = np.full(n, np.uint64(min(len(own), width)))
    for k in range(min(len(own), width)):
        mixed = mix(mixed * _ODD + own[k : k + n])
    return np.unique(mixed)


def ordered(hashes: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Keys in the global order, rising: rare classes first, then by hash. classes: of each hash, below 128."""
    return np.sort((classes.astype(np.int64) << 56) | (hashes >> np.uint64(8)).astype(np.int64))


def least_partner(n: int, percent: int) -> int:
    """The size of the smallest set that can be similar to one of n, and how many of its elements that must share."""
    return -(-percent * n // 100)


def alike(overlap, a, b, percent: int):
    """Whether sets of sizes a and b with that overlap reach the similarity, in whole numbers."""
    return 100 * overlap >= percent * (a + b - overlap)


def least_overlap(a: int, b: int, percent: int) -> int:
    """The overlap that sets of sizes a and b need."""
    return -(-percent * (a + b) // (100 + percent))

"""Vectorised 64-bit hashes of byte strings."""

from __future__ import annotations

import numpy as np

#: Odd bases of the prefix polynomials, for one try after the other.
BASES = (0x100000001B3, 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def times(r: int, factor: int) -> np.uint64:
    """r * factor modulo 2^64."""
    return np.uint64(r * factor % (1 << 64))


def powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Prefix polynomial hashes (modulo 2^64) of a byte array."""

    def __init__(self, data: np.ndarray, base: int = BASES[0]):
        n = len(data)
        self.prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(n, base), out=self.prefix[1:])
        self.inverse = powers(n + 1, pow(base, -1, 1 << 64))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.prefix[stop] - self.prefix[start]) * self.inverse[start]

"""Vectorised fingerprints of substrings, by prefix sums of random byte values times powers of an odd number (modulo 2**64)."""

from __future__ import annotations

from functools import cache

import numpy as np

_LETTER = np.random.default_rng(20240229).integers(0, 1 << 63, (2, 256), np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = (0x9E3779B97F4A7C15 | 3, 0xC2B2AE3D27D4EB4F | 3)
#: Powers that a worker keeps.
_KEPT = 1 << 21


def _made(which: int, inverse: bool, n: int) -> np.ndarray:
    base = _BASE[which]
    base = pow(base, -1, 1 << 64) if inverse else base
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


@cache
def _kept(which: int, inverse: bool) -> np.ndarray:
    return _made(which, inverse, _KEPT)


def _powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """The first n powers at least; a worker keeps one table for each base and direction, and longer ones only while they are used."""
    return _kept(which, inverse) if n <= _KEPT else _made(which, inverse, n)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Fingerprints of data[start:end] for arrays of places, 64 bits for each of the two bases."""

    def __init__(self, data: np.ndarray, bases: int = 1):
        n = len(data) + 1
        self.back = [_powers(b, True, n) for b in range(bases)]
        self.sums = []
        for b in range(bases):
            s = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_LETTER[b][data] * _powers(b, False, n)[: len(data)], out=s[1:])
            self.sums.append(s)

    def of(self, start: np.ndarray, end: np.ndarray, base: int = 0) -> np.ndarray:
        return mixed((self.sums[base][end] - self.sums[base][start]) * self.back[base][start] + (end - start).astype(np.uint64))

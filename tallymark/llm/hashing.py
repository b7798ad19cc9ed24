"""Vectorised hashes of byte and symbol spans: prefix polynomials modulo 2**64 over random tables."""

from __future__ import annotations

import functools

import numpy as np

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
TO_LOWER = np.arange(256, dtype=np.uint8)
TO_LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (a permutation of 64-bit values)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of spans of a sequence; equal spans have equal hashes."""

    def __init__(self, seed: int) -> None:
        random = np.random.RandomState(seed)
        self.table = np.frombuffer(random.bytes(256 * 8), np.uint64)
        self.base = int.from_bytes(random.bytes(8), "little") | 1
        self.salt = np.uint64(int.from_bytes(random.bytes(8), "little") | 1)
        self.power = self.back = np.ones(0, np.uint64)

    def grow(self, n: int) -> None:
        if len(self.power) < n:
            n = 1 << n.bit_length()
            for name, b in (("power", self.base), ("back", pow(self.base, -1, 2**64))):
                f = np.full(n, b, np.uint64)
                f[0] = 1
                setattr(self, name, np.cumprod(f, dtype=np.uint64))

    def prefix(self, symbols: np.ndarray) -> np.ndarray:
        """Running sums; bytes go through the random table, other symbols are hashes already."""
        n = len(symbols)
        self.grow(n + 1)
        out = np.zeros(n + 1, np.uint64)
        values = self.table[symbols] if symbols.dtype == np.uint8 else symbols
        np.cumsum(values * self.power[:n], out=out[1:])
        return out

    def of(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[start]) * self.back[start] + (end - start).astype(np.uint64) * self.salt)


@functools.lru_cache(maxsize=8)
def spans(seed: int) -> Spans:
    return Spans(seed)


def word_bounds(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in bytes; ``cuts`` are positions where a text begins."""
    word = ~SPACES[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    last = word.copy()
    last[:-1] &= ~word[1:]
    cuts = cuts[cuts < len(data)]
    first[cuts] = word[cuts]
    before = cuts[cuts > 0] - 1
    last[before] = word[before]
    return np.flatnonzero(first), np.flatnonzero(last) + 1

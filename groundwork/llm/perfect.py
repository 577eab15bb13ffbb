"""A minimal perfect hash over distinct 128-bit hashes: levels of bit arrays, each for the keys that collided in those before."""

from __future__ import annotations

import numpy as np

SPREAD, FIRST, SECOND = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
ROOM = 1.5  # bits of a level for each of its keys


def _places(hi: np.ndarray, lo: np.ndarray, level: int, size: int) -> np.ndarray:
    """A bit of the level for each key, from both halves of its hash."""
    x = hi ^ (lo * np.uint64(SPREAD * (2 * level + 1) % 2**64))
    x = (x ^ (x >> np.uint64(30))) * FIRST
    x = (x ^ (x >> np.uint64(27))) * SECOND
    return ((x >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)


class PerfectHash:
    """Gives each key of the set it was built over a number of its own from 0 to n - 1, and any other key -1 or some number."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(bits), dtype=np.int64)])

    @classmethod
    def over(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        """``hi`` and ``lo``: the unsigned halves of distinct hashes. Keys alone on a bit of a level take it, the others go on to the next."""
        sizes, levels = [], []
        while len(hi):
            size = max(64, int(len(hi) * ROOM))
            at = _places(hi, lo, len(sizes), size)
            taken = np.bincount(at, minlength=-(-size // 64) * 64)
            levels.append(np.packbits(taken == 1, bitorder="little").view(np.uint64))
            sizes.append(size)
            rest = taken[at] != 1
            hi, lo = hi[rest], lo[rest]
        return cls(np.array(sizes, dtype=np.int64), np.concatenate([*levels, np.zeros(0, dtype=np.uint64)]))

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = np.full(len(hi), -1, dtype=np.int64)
        left, base = np.arange(len(hi)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _places(hi[left], lo[left], level, size)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            held = self.bits[word]
            here = (held >> bit) & np.uint64(1) == 1
            below = held[here] & ((np.uint64(1) << bit[here]) - np.uint64(1))
            out[left[here]] = self.before[word[here]] + np.bitwise_count(below)
            left, base = left[~here], base + -(-size // 64)
        return out

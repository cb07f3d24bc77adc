"""A minimal perfect hash of distinct 64-bit keys, in numpy, with the keys stored by slot for verification.

Fingerprinting levels (Limasset et al., "Fast and scalable minimal perfect hashing", SEA 2017): each level is a bit array;
a key that has its bit to itself stays, the others go to the next level. A key's slot is the number of bits set
before its own. Some four bits and, for verification, eight bytes a key.
"""

from __future__ import annotations

import numpy as np

#: Bits of a level for each key that comes to it.
ROOM = 2


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """slots(keys): the slot of each key, -1 where the stored key is another."""

    def __init__(self, keys: np.ndarray):
        left = np.unique(keys.astype(np.uint64))
        self.size, self.levels = len(left), []
        done = 0
        while len(left):
            bits = max(64, -(-ROOM * len(left) // 64) * 64)
            at = (mix(left, len(self.levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            words = np.packbits(alone, bitorder="little").view("<u8")
            before = done + np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]])
            self.levels.append((words, before.astype(np.int64)))
            done += int(alone.sum())
            left = left[~alone[at]]
        self.keys = np.zeros(self.size, np.uint64)
        own = np.unique(keys.astype(np.uint64))
        self.keys[self._walk(own)] = own

    def _walk(self, keys: np.ndarray) -> np.ndarray:
        out, rest = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (words, before) in enumerate(self.levels):
            at = mix(keys[rest], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            held = words[word]
            hit = (held >> bit) & np.uint64(1) == 1
            lower = held[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[rest[hit]] = before[word[hit]] + np.bitwise_count(lower)
            rest = rest[~hit]
            if not len(rest):
                break
        return out

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        out = self._walk(keys)
        met = np.flatnonzero(out >= 0)
        out[met[self.keys[out[met]] != keys[met]]] = -1
        return out

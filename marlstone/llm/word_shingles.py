"""Words and hashed word windows of whole texts, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Odd multipliers that combine the hashes of the words of a window by their place (fixed values).
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads their bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash by word (bytes), remembered up to a limit."""

    def __init__(self, limit: int = 250_000):
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh64_intdigest(word)
        if len(self) < self.limit:
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """The hash of each window of n words."""
    if len(hashes) < n:
        return np.empty(0, np.uint64)
    last = len(hashes) - n + 1
    out = np.zeros(last, np.uint64)
    for k in range(n):
        out += hashes[k : k + last] * _PLACE[k % len(_PLACE)] * np.uint64(2 * (k // len(_PLACE)) + 1)
    return mix(out)

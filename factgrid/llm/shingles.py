"""Words and hashed word windows of many texts at once, for the helpers that run inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash a Python worker keeps; beyond that it forgets them all.
MOST_WORDS = 500_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


class Words(dict):
    """The 64-bit hash of a word's bytes."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MOST_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def windows(words: np.ndarray, size: int) -> np.ndarray:
    """A hash for each window of `size` words, built from windows of half the length; window i begins at word i."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    if size == 1:
        return mixed(words)
    half = size // 2
    h = windows(words, half)
    n = len(words) - size + 1
    out = h[:n] * _STEP + (h[half : half + n] ^ np.uint64(size))
    out = mixed(out)
    if size % 2:
        out = mixed(out * _STEP + words[size - 1 : size - 1 + n])
    return out

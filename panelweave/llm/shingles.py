"""Word shingles of texts as 64-bit hashes, for tasks that work with numpy."""

from __future__ import annotations

import numpy as np
import xxhash

WORDS = 5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


class WordHash(dict):
    """64-bit hashes of words (bytes); remembers up to ``most`` of them."""

    def __init__(self, most: int = 150_000):
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but ASCII white space."""
    return (text or "").encode("utf-8", "replace").split()


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of all runs of five words; fewer words make one run, no words none."""
    n = len(words)
    if not n:
        return words
    k = min(n, WORDS)
    total = np.full(n - k + 1, n if n < WORDS else 0, np.uint64)
    for i in range(k):
        total += mixed(words[i : n - k + 1 + i] + _MIX[i]) * _MIX[i]
    return mixed(total)


def counted(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, and how often each occurs."""
    h = np.sort(hashes)
    first = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1]))) if len(h) else np.zeros(0, np.int64)
    return h[first], np.diff(first, append=len(h))


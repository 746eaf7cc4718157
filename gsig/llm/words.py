"""Words and word shingles as 64-bit hashes, inside tasks."""

from __future__ import annotations

import numpy as np
import xxhash

CACHED = 200_000
_MIX = np.uint64(0xBF58476D1CE4E5B9)
_STEPS = np.random.default_rng(11).integers(1, 1 << 63, 64, dtype=np.uint64) | np.uint64(1)


class Hashes(dict):
    """Hashes of words; emptied when full, so its size is bounded."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return h ^ (h >> np.uint64(29))


def word_hashes(text: str | None, known: Hashes) -> np.ndarray:
    """The hashes of the words of a text in order, A-Z as a-z; bytes.split() parts at the space and ASCII controls 9-13 only."""
    words = (text or "").encode().lower().split()
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int, known: Hashes) -> np.ndarray:
    """Distinct hashes of the runs of n words, sorted. A text of fewer words is one run; one without words has none."""
    w = word_hashes(text, known)
    if not len(w):
        return w
    n = min(n, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * _STEPS[i]
    return np.unique(mixed(total + np.uint64(n)))

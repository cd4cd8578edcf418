"""Word and shingle hashes of many texts at once, as flat numpy arrays."""

from __future__ import annotations

import numpy as np
import xxhash

from loomrecord.llm.common import words_of

_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class WordHashes(dict):
    """64-bit hash per distinct word, remembered up to a bound (speed only)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


WORDS = WordHashes()


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words one behind the other, and the offsets of each text (one more than texts).

    `lower` maps A-Z only.
    """
    split = [words_of(t) for t in texts]
    if lower:
        split = [[w.lower() for w in s] if not (t or "").islower() else s for s, t in zip(split, texts)]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(s) for s in split], out=offsets[1:])
    get = WORDS.__getitem__
    return np.fromiter((h for s in split for h in map(get, s)), np.uint64, offsets[-1]), offsets


def rolling(h: np.ndarray, k: int) -> np.ndarray:
    """Order-aware hash of each k neighbours (one per start; shorter input gives none)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    return mix(out)

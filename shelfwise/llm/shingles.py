"""Words of a text and hashes of runs of words, for the operators that work on word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

#: ASCII punctuation counts as white space; other characters belong to words.
_SPACES = bytes(32 if chr(c) in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" else c for c in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63], dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of uint64 whose bits all depend on all."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 400_000:
            self[word] = value
        return value

    def of(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation."""
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(_SPACES).split()


def shingles(hashes: np.ndarray, width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of all runs of width words; a shorter text is one run, one without words has none."""
    n = len(hashes)
    if not n:
        return np.empty(0, np.uint64)
    width = min(width, n)
    total = np.zeros(n - width + 1, np.uint64)
    for i in range(width):
        total += hashes[i : n - width + 1 + i] * _STEPS[i % 5] + np.uint64(i)
    return np.unique(mix(total))

"""Hashes of words and of word shingles, for operators that compare texts."""

from __future__ import annotations

import numpy as np
import xxhash

MAX_WORDS = 200_000

# Odd 64-bit factors for the places of a shingle; any odd numbers would do.
_FACTORS = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) | 1 for i in range(64)], dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over all of them."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class WordHashes(dict):
    """64-bit hash of a word as 8 bytes; a bounded memory of words seen."""

    def __missing__(self, word: str | bytes) -> bytes:
        found = xxhash.xxh3_64_digest(word if isinstance(word, bytes) else word.encode("utf-8", "surrogatepass"))
        if len(self) < MAX_WORDS:
            self[word] = found
        return found

    def of(self, words: list) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), dtype=np.uint64)


def runs(hashes: np.ndarray, length: int) -> np.ndarray:
    """One hash for each run of ``length`` words; empty if there are fewer."""
    if len(hashes) < length:
        return hashes[:0]
    count = len(hashes) - length + 1
    total = np.zeros(count, dtype=np.uint64)
    for at in range(length):
        total += hashes[at : at + count] * _FACTORS[at]
    return mixed(total)


def shingle_set(hashes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles; fewer words than ``size`` are one shingle, none have none."""
    return np.unique(runs(hashes, min(size, len(hashes)))) if len(hashes) else hashes[:0]

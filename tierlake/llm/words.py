"""Words and word windows as 64-bit numbers, for the operators that read texts in Arrow batches.

Texts come as UTF-8 bytes. `bytes.split()` cuts at the six ASCII white-space characters, so it gives exactly the
words `[^\\x20\\x09-\\x0D]+`, and `bytes.lower()` lower-cases exactly A-Z.
"""

from __future__ import annotations

import numpy as np
import xxhash

#: Words whose hash is remembered per Python worker; further words are hashed each time they come.
CACHED_WORDS = 200_000

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class WordHashes(dict):
    """A dictionary from word to 64-bit hash that fills itself up to `CACHED_WORDS` entries."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < CACHED_WORDS:
            self[word] = value
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


HASHES = WordHashes()


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit of 64-bit numbers over all bits."""
    values = values ^ (values >> np.uint64(30))
    values = values * _MIX
    return values ^ (values >> np.uint64(29))


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One 64-bit number for each window of `size` consecutive words; none if there are fewer words."""
    n = max(0, len(hashes) - size + 1)
    total = hashes[:n].copy()
    for k in range(1, size):
        total = total * _MULTIPLIER + hashes[k : n + k]
    return mixed(total)

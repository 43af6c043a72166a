"""Words of whole texts as 64-bit codes, and rolling hashes of word windows, in numpy."""

from __future__ import annotations

import numpy as np
import xxhash

#: Distinct words whose codes one worker keeps; the cache starts anew beyond it.
CACHE_WORDS = 600_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_MIX2 = np.uint64(0xBF58476D1CE4E5B9)


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        code = self[word] = xxhash.xxh3_64_intdigest(word)
        return code


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * _MIX2
    x ^= x >> np.uint64(27)
    x *= _MIX
    return x ^ (x >> np.uint64(31))


class Vocabulary:
    """Codes of words; the same in every process."""

    def __init__(self) -> None:
        self.known = _Codes()

    def codes(self, words: list[bytes]) -> np.ndarray:
        if len(self.known) > CACHE_WORDS:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, words), np.uint64, len(words))

    @staticmethod
    def windows(codes: np.ndarray, size: int) -> np.ndarray:
        """One hash for each ``size`` consecutive codes; order counts."""
        n = len(codes) - size + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        out = codes[:n].copy()
        for k in range(1, size):
            out *= _MIX
            out ^= out >> np.uint64(29)
            out += codes[k : k + n]
        return mix(out)

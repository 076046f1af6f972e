"""Word shingles of a document as sorted 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

_MIX, _FINAL = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)

_INVERSE = np.uint64(pow(int(_MIX), -1, 1 << 64))


class WordHashes(dict):
    """64-bit hash of each word; forgets all words when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * _FINAL
    return h ^ (h >> np.uint64(32))


def windows(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` word hashes (none where there are fewer)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= _MIX
        out += hashes[i : i + n]
    return mixed(out)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """As ``windows``, by a running Karp-Rabin sum: the work does not grow with ``k``."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    # x_0 + x_1 B + ... (mod 2^64); B is odd, so a window's first power can be divided out again
    up = np.cumprod(np.full(len(hashes), _MIX, np.uint64), dtype=np.uint64)
    down = np.cumprod(np.full(len(hashes), _INVERSE, np.uint64), dtype=np.uint64)
    total = np.r_[np.zeros(1, np.uint64), np.cumsum(hashes * up, dtype=np.uint64)]
    return mixed((total[k:] - total[:-k]) * down[:n])


def shingle_set(words: list[bytes], hashes: WordHashes, k: int = 5) -> np.ndarray:
    """Distinct shingles of ``k`` words, sorted; with fewer words the whole sequence is the only one."""
    if not words:
        return np.zeros(0, np.uint64)
    h = hashes.of(words)
    return np.unique(windows(h, min(k, len(words))) + np.uint64(max(0, k - len(words))))

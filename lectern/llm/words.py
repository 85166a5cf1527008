"""Words and hashes of whole texts, for tasks that work on arrays."""

from __future__ import annotations

import functools

import numpy as np
import xxhash

#: Words whose hashes a worker remembers before it starts afresh; a worker keeps them from task to task.
MEMO_WORDS = 100_000
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


@functools.cache
def _memo() -> dict[bytes, int]:
    return {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    memo = _memo()
    if len(memo) > MEMO_WORDS:
        memo.clear()
    for word in set(words):
        if word not in memo:
            memo[word] = xxhash.xxh3_64_intdigest(word)
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def windows(hashes: np.ndarray, length: int) -> np.ndarray:
    """The hash of every run of ``length`` consecutive items."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for k in range(1, length):
        total = total * _FACTOR + hashes[k : k + n]
    return mixed(total + np.uint64(length))


def shingles(text: str, size: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the shingles of ASCII-lower-cased words; all words as one if they are fewer."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(word_hashes(words), min(size, len(words))))

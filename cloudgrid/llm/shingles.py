"""Hashes of word shingles."""

from __future__ import annotations

import numpy as np
import xxhash

_ODD = [np.uint64(v) for v in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_hashes(raw: bytes, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8.

    Words are cut at the six ASCII white space characters, which is what
    bytes.split() does. A text of fewer words is one shingle; without words, none.
    """
    words = raw.split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    size = min(width, n)
    out = np.full(n - size + 1, size, np.uint64)
    for k in range(size):
        out = (out + h[k : n - size + 1 + k]) * _ODD[k % len(_ODD)]
        out ^= out >> np.uint64(29)
    return np.unique(mix(out))

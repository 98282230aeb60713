"""Word shingle sets as sorted arrays of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import xxhash

from sonospan.llm.rule_stats import mixed
from sonospan.llm.wordhash import word_hashes

SIZE = 5


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` consecutive hashes."""
    n = len(h) - size + 1
    out = np.full(n, size, dtype=np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[j : j + n])
    return out


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Distinct hashes of ``size``-word shingles, ascending; a shorter text is one shingle, a text without words has none.

    A-Z are lower-cased; a word is ``[^\\x20\\x09-\\x0D]+``.
    """
    words, _ = word_hashes((text or "").encode("utf-8", "surrogatepass").lower())
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    return np.unique(chained(words, min(size, len(words))))


def fingerprint(hashes: np.ndarray) -> int:
    """Signed 64-bit hash of a whole set."""
    h = xxhash.xxh3_64_intdigest(hashes.tobytes(), seed=len(hashes))
    return h - (1 << 64) if h >> 63 else h

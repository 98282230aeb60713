"""64-bit hashes of the words of UTF-8 texts, eight bytes of all words at a time: no word becomes a Python object.

A word is ``[^\\x20\\x09-\\x0D]+``, so words end at ASCII bytes and any cut at
one of those leaves words whole.  Every eight bytes are mixed before the next
come, so regular words collide no more than others do.
"""

from __future__ import annotations

import re

import numpy as np
import xxhash

from sonospan.llm.rule_stats import mixed

BASE = 0xD1342543DE82EF95
BASE_INVERSE = pow(BASE, -1, 1 << 64)
PIECE_BYTES = 1 << 20
#: Longer words are hashed one by one.
LONG_WORD = 256
SPACE = re.compile(rb"[\x20\x09-\x0D]")
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: The low n bytes of eight.
LOW = np.array([(1 << (8 * n)) - 1 for n in range(9)], dtype=np.uint64)
_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, n of each at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, BASE_INVERSE)):
            _powers[k] = np.cumprod(np.concatenate([np.ones(1, dtype=np.uint64), np.full(2 * n, base, dtype=np.uint64)]))
    return _powers[0], _powers[1]


def _piece(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    a = np.frombuffer(data, dtype=np.uint8)
    edge = np.diff(IS_SPACE[a].view(np.int8), prepend=1, append=1)
    start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    size = end - start
    out = mixed(size.astype(np.uint64))
    eights = np.lib.stride_tricks.sliding_window_view(np.frombuffer(data + bytes(8), dtype=np.uint8), 8)
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]])
    left = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(left):
        here = eights[start[left] + at].view(np.dtype("<u8")).reshape(-1) & LOW[np.minimum(size[left] - at, 8)]
        out[left] = mixed((out[left] ^ here) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(at + 1))
        at += 8
        left = left[size[left] > at]
    return out, start


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words, and where they begin.  Long texts are read in pieces cut at white space."""
    if len(data) <= PIECE_BYTES:
        return _piece(data)
    found, at = [], 0
    while at < len(data):
        cut = SPACE.search(data, at + PIECE_BYTES) if at + PIECE_BYTES < len(data) else None
        end = cut.start() if cut else len(data)
        h, start = _piece(data[at:end])
        found.append((h, start + at))
        at = end
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))

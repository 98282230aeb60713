"""Counts that quality rules read from one text.  A word is ``[^\\x20\\x09-\\x0D]+``."""

from __future__ import annotations

import numpy as np

SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
WINDOW = 8
#: Odd multipliers, one for each place in a window of words.
PLACES = (np.arange(1, WINDOW + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def mixed(x: np.ndarray) -> np.ndarray:
    """64 bits spread over 64 bits, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def repeated_words(words: list[bytes]) -> int:
    """Words inside a window of 8 words that occurs twice or more, its first occurrence included."""
    if len(words) <= WINDOW:
        return 0
    number: dict[bytes, int] = {}
    ids = mixed(np.array([number.setdefault(w, len(number)) for w in words], dtype=np.uint64) + np.uint64(1))
    n = len(words) - WINDOW + 1
    if len(number) > len(words) - WINDOW:  # too few repeated words for one repeated window
        return 0
    windows = np.zeros(n, dtype=np.uint64)
    for j in range(WINDOW):
        windows += ids[j : j + n] * PLACES[j]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    if not same.any():
        return 0
    starts = np.zeros(n, dtype=bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(starts)
    edges[at] += 1
    np.add.at(edges, at + WINDOW, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def rule_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """The counts of ``NAMES``; null has no words."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(map(text.count, SPACES))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return len(words), chars, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 20 or 100 * n_repeat_words > 30 * n_words

"""Deep-shallow sorting of many groups of byte strings.

Shallow: multikey quicksort.  Every open run of rows is split in three around the
median of three of its characters; the middle part goes on at the next character.
All open runs are split in one pass.  Characters are words of eight bytes, down to
``SHALLOW`` bytes, then the length of shorter strings.
Deep: what is still tied then has a long common prefix; a blind trie, which
stores branching places only and compares one string per insertion, orders it.
"""

from __future__ import annotations

import numpy as np

SHALLOW = 16


def common_prefix(a: bytes, b: bytes) -> int:
    lo, hi = 0, min(len(a), len(b))
    if a[:hi] == b[:hi]:
        return hi
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo:mid] == b[lo:mid]:
            lo = mid
        else:
            hi = mid
    return lo


class BlindTrie:
    """Inner nodes are (depth, branches by next byte, -1 for the end); leaves are lists of string numbers."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, None
        for i in range(len(strings)):
            self.insert(i)

    def insert(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [i]
            return
        node = self.root
        while type(node) is tuple:  # blind: branches are trusted, skipped characters are not read
            depth, kids = node
            node = kids.get(s[depth] if depth < len(s) else -1) or next(iter(kids.values()))
        r = self.strings[node[0]]
        same = common_prefix(s, r)
        if same == len(s) == len(r):
            node.append(i)
            return
        up, key, node = None, None, self.root
        while type(node) is tuple and node[0] < same:
            up, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        mine = s[same] if same < len(s) else -1
        if type(node) is tuple and node[0] == same:
            node[1][mine] = [i]
            return
        split = (same, {(r[same] if same < len(r) else -1): node, mine: [i]})
        if up is None:
            self.root = split
        else:
            up[1][key] = split

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if type(node) is tuple:
                stack += [node[1][k] for k in sorted(node[1], reverse=True)]
            elif node:
                out += node
        return out


def multikey_quicksort(group: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, characters), and where runs of rows equal in all of these begin.  ``chars``: a row of unsigned characters each."""
    order = np.argsort(group, kind="stable")
    own = group[order]
    lo = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(order) else np.zeros(0, dtype=np.int64)
    hi, depth, closed = np.append(lo[1:], len(order)), np.zeros(len(lo), dtype=np.int64), []
    while len(lo):
        is_open = (hi - lo > 1) & (depth < chars.shape[1])
        closed.append(lo[~is_open])
        lo, hi, depth = lo[is_open], hi[is_open], depth[is_open]
        size = hi - lo
        run = np.repeat(np.arange(len(lo)), size)
        at = np.arange(len(run)) + np.repeat(lo - (np.cumsum(size) - size), size)
        rows = order[at]
        a, b, c = (chars[order[x], depth] for x in (lo, (lo + hi) // 2, hi - 1))
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[run]
        char = chars[rows, depth[run]]
        part = 3 * run + 1 + (char > pivot) - (char < pivot)
        order[at] = rows[np.argsort(part, kind="stable")]
        count = np.bincount(part, minlength=3 * len(lo)).reshape(-1, 3)
        begin = lo[:, None] + np.cumsum(count, axis=1) - count
        deeper = depth[:, None] + np.array([0, 1, 0])
        some = count > 0
        lo, hi, depth = begin[some], (begin + count)[some], deeper[some]
    return order, np.sort(np.concatenate(closed)) if closed else lo


def deep_shallow(group: np.ndarray, strings: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the rows by (group, string), and each row's common prefix with the row before it in that order (-1 where a group begins).

    ``strings``: a row of bytes each, padded with zeros to one width of 16 or more; ``length``: bytes that count.
    """
    head = np.ascontiguousarray(strings[:, :SHALLOW]).view(">u8").astype(np.uint64)
    chars = np.stack([head[:, 0], head[:, 1], np.minimum(length, SHALLOW).astype(np.uint64)], axis=1)
    order, starts = multikey_quicksort(group, chars)
    if len(order) < 2:
        return order, np.full(len(order), -1, dtype=np.int64)
    sizes = np.diff(np.append(starts, len(order)))
    for at, size in zip(starts[sizes > 1], sizes[sizes > 1], strict=True):
        rows = order[at : at + size]
        order[at : at + size] = rows[BlindTrie([strings[r, SHALLOW : max(SHALLOW, length[r])].tobytes() for r in rows]).order()]
    a, b = order[1:], order[:-1]
    differ = strings[a] != strings[b]
    prefix = np.where(differ.any(axis=1), differ.argmax(axis=1), strings.shape[1])
    prefix = np.minimum(prefix, np.minimum(length[a], length[b]))
    return order, np.concatenate([[-1], np.where(group[a] == group[b], prefix, -1)])

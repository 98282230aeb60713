"""Packing tokenized documents into sequences by bin-completion branch and bound.

Lengths never exceed the capacity, so the corpus is a histogram of at most
``capacity`` counts, whatever its size.  The search runs on that histogram: the
largest remaining length opens a sequence, undominated fillings of the rest are
enumerated (waste first), a filling is used for as many sequences as the counts
allow, branches whose waste passes what the incumbent allows are cut, and
best-fit-decreasing gives the first incumbent.  It stops at the lower bound or
after ``nodes`` fillings, keeping the best packing found.

A packing is a short list of patterns.  Every piece gets a number among the
pieces of its length (numbered inside hash buckets of about ``BUCKET_ROWS``, so
a length that holds a third of all rows is no single task) and finds its
sequence and offset by binary search in the pattern table, whose size depends
on the capacity alone.

The search is bounded: ``nodes`` fillings in all, at each of them 400 tries and
the eight best fillings, within 64 tokens of the least waste, each with as many
sequences as the counts allow first and half as many next.  What it returns is a
full packing at any time; ``lower_bound`` says how far from the optimum it can be.

Null text counts as empty: the closing id alone, one token.  Very long texts are
cut into pieces and tokenized part by part.  Repeated rows, repeated and null ids
are packed each.  An empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm import pretokens
from sonospan.llm.common import row_count, written

CAPACITY = 2048
BUCKET_ROWS = 10_000
#: Bucket starts of up to so many rows are broadcast, some 20 MB.
BROADCAST_ROWS = 500_000
NODES = 8_000
#: Words whose ids a worker keeps.
WORDS_HELD = 400_000

Filling = tuple[tuple[int, int], ...]
Pattern = tuple[int, Filling]


def token_packer(path: str, words_held: int = WORDS_HELD):
    """A function from a text to its ids as little-endian 32-bit bytes, the closing id 0 not included."""
    tok = pretokens.tokenizer(path)
    special = [s for s in pretokens.special_strings(path) if s]

    def packed(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()

    ids = pretokens.TwoTier({}, lambda t: packed(pretokens.model_ids(tok, t)), room=words_held).__getitem__

    def encode(text: str) -> bytes:
        if any(s in text for s in special):
            return packed(tok.encode(text, add_special_tokens=False).ids)
        return b"".join(map(of_piece, pretokens.pieces(text)))

    def of_piece(piece: str) -> bytes:
        if not piece.isascii() and pretokens.UNSURE.search(piece):
            return packed(tok.encode(piece, add_special_tokens=False).ids)
        piece = pretokens.normalized_words(piece)
        split = (pretokens.WORD_PATTERN if pretokens.NOT_LATIN.search(piece) else pretokens.LATIN_WORD_PATTERN).findall
        return b"".join(map(ids, split(piece)))

    return encode


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", words_held: int = WORDS_HELD) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = token_packer(path, words_held)
        for batch in batches:
            rows, pieces, starts, lengths, sums = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append(i)
                    pieces.append(k)
                    starts.append(at // 4)
                    lengths.append(len(part) // 4)
                    sums.append(zlib.crc32(part))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), *(pa.array(x, pa.int64()) for x in (starts, lengths, sums))], ["id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, piece int, start long, length long, ids_crc32 long")


class Counts:
    """Remaining pieces by length: counts, and the lengths still there in ascending order."""

    def __init__(self, counts: dict[int, int]):
        self.of = {n: c for n, c in counts.items() if c > 0}
        self.lengths = sorted(self.of)

    def take(self, filling: Filling, times: int) -> None:
        for n, q in filling:
            self.of[n] -= q * times
            if not self.of[n]:
                del self.of[n]
                del self.lengths[bisect_left(self.lengths, n)]

    def give(self, filling: Filling, times: int) -> None:
        for n, q in filling:
            if n not in self.of:
                self.of[n] = 0
                self.lengths.insert(bisect_left(self.lengths, n), n)
            self.of[n] += q * times

    def fits(self, filling: Filling) -> int:
        return min(self.of[n] // q for n, q in filling)


def best_fit(counts: dict[int, int], capacity: int) -> list[Pattern]:
    """Best-fit decreasing on the histogram: the largest piece that still fits comes next, as often as it fits."""
    left, patterns = Counts(counts), []
    while left.lengths:
        room, used = capacity, {}
        while (at := bisect_right(left.lengths, room)) and room:
            while at and left.of[left.lengths[at - 1]] <= used.get(left.lengths[at - 1], 0):
                at -= 1
            if not at:
                break
            n = left.lengths[at - 1]
            q = min(left.of[n] - used.get(n, 0), room // n)
            used[n] = used.get(n, 0) + q
            room -= n * q
        filling = tuple(sorted(used.items(), reverse=True))
        times = left.fits(filling)
        left.take(filling, times)
        patterns.append((times, filling))
    return patterns


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """The larger of the volume bound and Martello and Toth's bound over all thresholds."""
    lengths = sorted(counts)
    best = -(-sum(n * c for n, c in counts.items()) // capacity)
    for k in [0, *(n for n in lengths if n <= capacity // 2)]:
        large = sum(c for n, c in counts.items() if n > capacity - k)
        middle = [(n, c) for n, c in counts.items() if capacity - k >= n > capacity // 2]
        small = sum(n * c for n, c in counts.items() if capacity // 2 >= n >= k)
        free = sum((capacity - n) * c for n, c in middle)
        best = max(best, large + sum(c for _, c in middle) + max(0, -(-(small - free) // capacity)))
    return best


def fillings(left: Counts, capacity: int, most: int = 8, steps: int = 400) -> list[tuple[int, Filling]]:
    """(waste, filling) of sequences opened by the largest piece, undominated ones only, least waste and fewest pieces first."""
    first = left.lengths[-1]
    found: list[tuple[int, int, Filling]] = []
    budget = steps

    def undominated(room: int, used: dict[int, int]) -> bool:
        for at in range(bisect_right(left.lengths, room)):
            if left.of[left.lengths[at]] > used.get(left.lengths[at], 0):
                return False
        for n in used:
            if n == first and used[n] == 1:
                continue
            for at in range(bisect_right(left.lengths, n), bisect_right(left.lengths, n + room)):
                if left.of[left.lengths[at]] > used.get(left.lengths[at], 0):
                    return False
        return True

    def search(room: int, top: int, used: dict[int, int]) -> None:
        nonlocal budget
        at = min(top, bisect_right(left.lengths, room) - 1)
        grown = False
        while at >= 0 and budget > 0:
            n = left.lengths[at]
            if left.of[n] > used.get(n, 0):
                budget -= 1
                grown = True
                used[n] = used.get(n, 0) + 1
                search(room - n, at, used)
                used[n] -= 1
                if not used[n]:
                    del used[n]
                if found and found[-1][0] == 0 and len(found) >= most:
                    return
            at -= 1
        if not grown and (not found or room <= min(f[0] for f in found) + 64) and undominated(room, used):
            found.append((room, sum(used.values()), tuple(sorted(used.items(), reverse=True))))

    search(capacity - first, len(left.lengths) - 1, {first: 1})
    if not found:
        used, room = {first: 1}, capacity - first
        for n in reversed(left.lengths):
            q = min(left.of[n] - used.get(n, 0), room // n)
            if q > 0:
                used[n] = used.get(n, 0) + q
                room -= q * n
        found.append((room, 0, tuple(sorted(used.items(), reverse=True))))
    return [(w, f) for w, _, f in sorted(set(found))[:most]]


def bin_completion(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[Pattern]:
    """Patterns (times, ((length, quantity), ...)) that use up ``counts`` in as few sequences as the search finds."""
    counts = {n: c for n, c in counts.items() if c > 0}
    if not counts:
        return []
    incumbent = best_fit(counts, capacity)
    fewest, least, volume = sum(t for t, _ in incumbent), lower_bound(counts, capacity), sum(n * c for n, c in counts.items())
    if fewest <= least:
        return incumbent
    left, spent = Counts(counts), 0
    path: list[Pattern] = []
    waste = 0
    #: for each depth the branches not tried yet
    stack: list[list[tuple[int, int, Filling]]] = []
    while True:
        dead = waste > (fewest - 1) * capacity - volume
        if not dead and not left.lengths:
            incumbent, fewest = list(path), sum(t for t, _ in path)
            dead = True
            if fewest <= least:
                break
        if not dead and spent < nodes:
            spent += 1
            branches = []
            for room, filling in fillings(left, capacity):
                times = left.fits(filling)
                branches.append((room, times, filling))
                if times > 1:
                    branches.append((room, times // 2, filling))
            branches.sort(key=lambda b: b[0])
            stack.append(branches[::-1])
        elif spent >= nodes and not dead:
            break
        while stack and not stack[-1]:
            stack.pop()
            if path:
                times, filling = path.pop()
                left.give(filling, times)
                waste -= times * (capacity - sum(n * q for n, q in filling))
        if not stack:
            break
        if len(path) == len(stack):
            times, filling = path.pop()
            left.give(filling, times)
            waste -= times * (capacity - sum(n * q for n, q in filling))
        room, times, filling = stack[-1].pop()
        left.take(filling, times)
        path.append((times, filling))
        waste += room * times
    return incumbent


@dataclass
class Slots:
    """Pattern table by length and first number: sequences from ``sequence`` on, ``quantity`` places each from ``offset`` on."""

    key: np.ndarray
    first: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    quantity: np.ndarray

    @classmethod
    def of(cls, patterns: list[Pattern]) -> Slots:
        rows, given, sequence = [], {}, 0
        for times, filling in patterns:
            offset = 0
            for n, q in filling:
                rows.append((n, given.get(n, 0), sequence, offset, q))
                given[n] = given.get(n, 0) + q * times
                offset += n * q
            sequence += times
        rows.sort()
        n, first, sequences, offsets, quantity = (np.array(x, dtype=np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, dtype=np.int64)] * 5
        return cls((n << 48) + first, first, sequences, offsets, quantity)

    def places(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) + number, side="right") - 1
        within = number - self.first[at]
        return self.sequence[at] + within // self.quantity[at], self.offset[at] + within % self.quantity[at] * length


def numbered(pieces: DataFrame) -> DataFrame:
    """``number``: 0, 1, ... among the pieces of a length.  ``uid`` tells rows apart."""
    counts = pieces.groupBy("length").agg(F.count("*").alias("n"))  # a row for each length, at most the capacity
    rows = pieces.join(F.broadcast(counts), "length").withColumn("bucket", F.pmod(F.xxhash64("uid"), F.ceil(F.col("n") / BUCKET_ROWS))).drop("n")
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(rows.groupBy("length", "bucket").agg(F.count("*").alias("n")).select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before")))
    starts = F.broadcast(starts) if row_count(starts) <= BROADCAST_ROWS else starts
    rank = Window.partitionBy("length", "bucket").orderBy("uid")
    return rows.withColumn("number", F.row_number().over(rank) - 1).join(starts, ["length", "bucket"]).withColumn("number", F.col("number") + F.col("before"))


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES, words_held: int = WORDS_HELD) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = written(token_pieces(docs, path, capacity, id_col, text_col, words_held).withColumn("uid", F.monotonically_increasing_id()))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = docs.sparkSession.sparkContext.broadcast(Slots.of(bin_completion(counts, capacity, nodes)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, number = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            sequence, offset = slots.value.places(length, number)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = numbered(pieces).select("id", "piece", "start", "length", "ids_crc32", "number")
    return rows.mapInArrow(place, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)

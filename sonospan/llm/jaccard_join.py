"""Exact self-join of documents on 5-word shingle Jaccard similarity, as linked groups.

1. A table of hashed shingle counts over all documents, of one size whatever
   the input, gives one global order with frequent shingles last.  Shingles of one
   document link nothing and are not posted.
2. Documents with equal sets are one node (the set's fingerprint): a task writes
   a node's prefix once, and lists hold a node once.
3. Nodes whose sets can be similar share a shingle of their prefixes.  Postings
   are dealt by ranges of (shingle, length, node), so a very common shingle is
   many tasks.  A streamed pass, cut by length and position, leaves edges that
   connect all candidates without listing the pairs; what stands near the ends of
   a task's range meets once more.  The edges' components are families, and links
   never leave a family.
4. Families meet as blocks of bounded size.  Inside a block a set is searched in
   lists cut into skip blocks by length and position, which are passed over where
   position and length leave too small an overlap.  The search keeps all sets
   that come within a slack of the bound; a highly similar set then has its
   answers derived from these, by walking only the lists of the shingles in which
   the two differ, until the slack is used up.
5. A family of one block is settled there.  In a larger one every block meets
   the first block; what that leaves outside the largest group then meets all
   blocks.

Null and empty texts link with nothing.  Repeated rows, repeated ids and null
ids are documents of their own; a group of null ids alone has a null
``component_id``, others have their smallest id.  Very long texts are hashed in
pieces.  Extra columns are not read.  Two different sets share a fingerprint with
probability about 2 ** -64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.common import bit_table, bits_for, leading, marked, row_count, written
from sonospan.llm.components import components
from sonospan.llm.shingles import SIZE, fingerprint, shingle_set

#: 80 of 100.
SIMILAR = (80, 100)
SKETCH_BITS = 26
CHUNK_BITS = 16
#: Least counts of the classes of shingles from 1 on; those of class 0 are in one document.
CLASSES = np.array([2, 3, 4, 6, 8, 11, 16, 22, 32, 45, 64, 128, 512, 4096, 32768])
#: Shingles that a task counts at a time.
CELLS_HELD = 1 << 20
BLOCK_SETS = 512
BLOCK_SHINGLES = 2_000_000
#: Rows of a posting list that a row is compared with.
REACH = 16
#: Entries of a list that are passed over together.
SKIP = 16
#: Nodes whose prefix a task remembers to have written.
NODES_HELD = 1_000_000
#: Pairs that a task makes distinct at a time.
PAIRS_HELD = 1 << 18


def least_part(n):
    """Smallest overlap that a set of n needs with any set."""
    return -(-SIMILAR[0] * n // SIMILAR[1])


def prefix_length(n):
    return n - least_part(n) + 1


def least_overlap(n, m):
    """Smallest overlap at which sets of n and m are similar."""
    return -(-SIMILAR[0] * (n + m) // (SIMILAR[0] + SIMILAR[1]))


def similar(overlap, n, m):
    return SIMILAR[1] * overlap >= SIMILAR[0] * (n + m - overlap)


def count_classes(docs: DataFrame, size: int, bits: int) -> np.ndarray:
    """Classes of the counts of hashed shingles over all documents, in 2 ** bits cells, two in a byte; 0 is a count of one at most.

    Tasks hand on the counts of the cells that they meet, a few bytes each, and never
    shingles; what is collected has half a byte for each cell.
    """
    chunk = min(CHUNK_BITS, bits)

    def planes(numbers: np.ndarray, kind: str) -> bytes:
        """First bytes, then second ones: most high bytes are 0."""
        return numbers.astype(kind).view(np.uint8).reshape(len(numbers), -1).T.tobytes()

    def of_planes(raw: bytes, kind: str) -> np.ndarray:
        return np.frombuffer(raw, dtype=np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).reshape(-1)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        """A row for each chunk: how many cells, their places as differences, and their counts."""
        cells, counts = np.unique(np.concatenate(held), return_counts=True)
        part = cells >> chunk
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        place = (cells & ((1 << chunk) - 1)).astype(np.int64)
        gap = np.diff(place, prepend=0)
        gap[starts] = place[starts]
        rows = [zstandard.compress(planes(g, "<u2") + planes(c, "<u4"), 1) for g, c in zip(np.split(gap, starts[1:]), np.split(counts, starts[1:]), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(part[starts].astype(np.int32)), pa.array(rows, pa.binary())], ["part", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch in batches:
            for text in batch.column(0):
                held.append((shingle_set(text.as_py(), size) & np.uint64((1 << bits) - 1)).astype(np.uint32))
                n += len(held[-1])
                if n >= CELLS_HELD:
                    yield packed(held)
                    held, n = [], 0
        if n:
            yield packed(held)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, row in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = zstandard.decompress(row.as_py())
                n = len(raw) // 6
                cells = total.setdefault(k, np.zeros(1 << chunk, dtype=np.uint32))
                cells[np.cumsum(of_planes(raw[: 2 * n], "<u2"), dtype=np.int64)] += of_planes(raw[2 * n :], "<u4")
        for k, cells in total.items():
            kinds = np.searchsorted(CLASSES, cells, "right").astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zstandard.compress((kinds[::2] | kinds[1::2] << 4).tobytes(), 1)], pa.binary())], ["part", "cells"])

    schema = "part int, cells binary"
    table = np.zeros((1 << (bits - chunk), 1 << (chunk - 1)), dtype=np.uint8)
    for r in docs.mapInArrow(count, schema).repartition("part").mapInArrow(add, schema).collect():  # 2 ** (bits - 1) bytes in all
        table[r["part"]] = np.frombuffer(zstandard.decompress(bytes(r["cells"])), dtype=np.uint8)
    return table.reshape(-1)


def class_of(table: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """Classes of shingles in a table of two cells a byte."""
    at = (shingles & np.uint64(2 * len(table) - 1)).astype(np.int64)
    return table[at >> 1] >> ((at & 1) << 2).astype(np.uint8) & 15


def with_sets(docs: DataFrame, classes, size: int) -> DataFrame:
    """id, t (hash of the text), n, node and the prefix: hashes in global order, as bytes, where the task has not written the node's before.

    Shingles of no other document lead the prefix and are left out.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = classes.value
        seen: set[int] = set()
        for batch in batches:
            ns, nodes, prefixes = [], [], []
            for text in batch.column(2):
                s = shingle_set(text.as_py(), size)
                node = fingerprint(s) if len(s) else None
                ns.append(len(s))
                nodes.append(node)
                if node is None or node in seen:
                    prefixes.append(None)
                    continue
                if len(seen) < NODES_HELD:
                    seen.add(node)
                kinds = class_of(table, s)
                first = np.argsort(kinds, kind="stable")[: prefix_length(len(s))]
                shared = first[kinds[first] > 0]
                prefixes.append(s[shared].astype("<u8").tobytes() if len(shared) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ns, pa.int64()), pa.array(nodes, pa.int64()), pa.array(prefixes, pa.binary())], ["id", "t", "n", "node", "prefix"])

    return docs.mapInArrow(run, f"id {kind}, t long, n long, node long, prefix binary")


def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        arrays = [np.frombuffer(p.as_py(), dtype="<i8") for p in batch.column(2)]
        counts = np.array([len(a) for a in arrays], dtype=np.int64)
        if not counts.sum():
            continue
        n, node = (np.repeat(batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64), counts) for i in (0, 1))
        # what is left of a prefix is its end
        at = prefix_length(n) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts), counts)
        for lo in range(0, len(at), 200_000):
            part = slice(lo, lo + 200_000)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(arrays)[part], n[part].astype(np.int32), node[part], at[part].astype(np.int32))], ["h", "n", "node", "at"])


POSTING = "h long, n int, node long, at int"
CANDIDATE = "u long, v long, h long, n int, at int"


def candidate_rows(u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *(pa.nulls(len(u), t) for t in (pa.int64(), pa.int32(), pa.int32()))], ["u", "v", "h", "n", "at"])


def candidate_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges that connect the candidates of a task's lists, and the rows at the ends of its range (``u`` is their node).

    Postings arrive sorted by (h, n, node) and are never held.  A row is compared
    with up to ``REACH`` rows before it in its list, by length and position; where
    the list is longer than that, with the row just before it by length alone,
    which keeps every candidate connected.  The first and last ``REACH`` rows of a
    range come out again: a list may go on in the tasks beside.
    """
    first_rows: list[np.ndarray] | None = None
    tail = [np.zeros(0, dtype=np.int64)] * 4

    def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        nonlocal tail, first_rows
        for batch in batches:
            fresh = [batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)]
            if not len(fresh[0]):
                continue
            h, node = (np.concatenate([tail[i][-1:], fresh[i]]) for i in (0, 2))
            new = (h[1:] != h[:-1]) | (node[1:] != node[:-1]) if len(tail[0]) else np.concatenate([[True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])])
            cols = [np.concatenate([t, c[new]]) for t, c in zip(tail, fresh, strict=True)]
            yield from near_pairs(cols, len(tail[0]))
            if first_rows is None or len(first_rows[0]) < REACH:
                first_rows = [np.concatenate([a, c[new]])[:REACH] for a, c in zip(first_rows or tail, fresh, strict=True)]
            tail = [c[-REACH:] for c in cols]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    for pair in pairs():
        held.append(pair)
        if sum(len(u) for u, _ in held) >= PAIRS_HELD:
            yield candidate_rows(*unequal(held))
            held.clear()
    if held:
        yield candidate_rows(*unequal(held))
    if first_rows is not None:
        for cols in (first_rows, tail):
            h, n, node, at = cols
            yield pa.RecordBatch.from_arrays([pa.array(node), pa.nulls(len(h), pa.int64()), pa.array(h), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], ["u", "v", "h", "n", "at"])


def unequal(held: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Pairs with the smaller node first, each once."""
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    return np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)]), axis=1)


def near_pairs(cols: list[np.ndarray], fresh: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows from ``fresh`` on with rows before them; rows that a chain of neighbours connects are no pair."""
    h, n, node, at = cols
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    first = np.repeat(starts, np.diff(np.append(starts, len(h))))
    ends = np.append(starts[1:], len(h))
    last = np.repeat(ends, ends - starts)
    here = np.arange(fresh, len(h))
    for back in range(1, REACH + 1):
        i = here[here - back >= first[here]]
        if not len(i):
            break
        j = i - back
        upper = np.minimum(n[i] - at[i], n[j] - at[j])  # holds at a pair's first common shingle
        ok = (node[i] != node[j]) & (n[j] >= least_part(n[i]))
        near = ok & (upper >= least_overlap(n[i], n[j]))
        if back == 1:
            # the list is long, or goes on past what has arrived
            near = near | (ok & ((last[i] - first[i] > REACH) | (last[i] == len(h)) | (first[i] == 0)))
            chain = np.ones(len(h), dtype=np.int64)
            chain[i[near]] = 0
            chain = np.cumsum(chain)
        else:
            near &= chain[i] != chain[j]
        yield node[i[near]], node[j[near]]


class Block:
    """Sets of a block, sorted by length, with skip lists over their shingles, rarest first."""

    def __init__(self, sets: list[np.ndarray]):
        order = sorted(range(len(sets)), key=lambda i: len(sets[i]))
        self.order = order
        self.sets = [sets[i] for i in order]
        self.n = np.array([len(s) for s in self.sets], dtype=np.int64)
        owner = np.repeat(np.arange(len(sets)), self.n)
        values, ids = np.unique(np.concatenate(self.sets), return_inverse=True) if len(sets) else (np.zeros(0), np.zeros(0, dtype=np.int64))
        rank = np.empty(len(values), dtype=np.int64)
        rank[np.argsort(np.bincount(ids, minlength=len(values)), kind="stable")] = np.arange(len(values))
        by_set = np.lexsort((rank[ids], owner))
        #: all sets' shingles one after another, in the block's order
        self.flat, self.from_ = rank[ids][by_set], np.concatenate([[0], np.cumsum(self.n)])
        place = np.arange(len(owner)) - self.from_[owner]
        lists = np.lexsort((place, self.n[owner], self.flat))
        self.entry, self.rest = owner[lists], (self.n[owner] - place)[lists]
        token = self.flat[lists]
        self.starts = np.searchsorted(token, np.arange(len(values) + 1))
        cut = np.flatnonzero((np.arange(len(token)) - self.starts[token]) % SKIP == 0)
        self.cut = np.append(cut, len(token))
        self.skip_starts = np.searchsorted(cut, self.starts)
        self.most_rest = np.maximum.reduceat(self.rest, cut) if len(cut) else np.zeros(0, dtype=np.int64)
        self.least_n = self.n[self.entry[cut]]
        self.mark = np.zeros(len(values), dtype=bool)

    def tokens(self, i: int) -> np.ndarray:
        return self.flat[self.from_[i] : self.from_[i + 1]]

    def hits(self, tokens: np.ndarray) -> np.ndarray:
        """For every set, how many of ``tokens`` it has."""
        return np.bincount(self.entry[spread(self.starts[tokens], self.starts[tokens + 1])[0]], minlength=len(self.n))

    def search(self, i: int, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Sets whose overlap with set i comes within ``slack`` of the bound, and these overlaps."""
        n, tokens = int(self.n[i]), self.tokens(i)
        least = max(1, -(-4 * (n - slack) // 5) - slack)
        tokens = tokens[: n - least + 1]
        blocks, of = spread(self.skip_starts[tokens], self.skip_starts[tokens + 1])
        left = n - of  # shingles from the probe's position on
        use = np.minimum(left, self.most_rest[blocks]) >= least_overlap(n, self.least_n[blocks]) - slack
        at, of = spread(self.cut[blocks[use]], self.cut[blocks[use] + 1])
        sets = self.entry[at]
        sets = np.unique(sets[np.minimum(left[use][of], self.rest[at]) >= least_overlap(n, self.n[sets]) - slack])
        self.mark[self.tokens(i)] = True
        inside, _ = spread(self.from_[sets], self.from_[sets + 1])
        overlap = np.add.reduceat(self.mark[self.flat[inside]].astype(np.int64), np.cumsum(self.n[sets]) - self.n[sets]) if len(sets) else np.zeros(0, dtype=np.int64)
        self.mark[self.tokens(i)] = False
        use = overlap >= least_overlap(n, self.n[sets]) - slack
        return sets[use], overlap[use]

    def links(self, probes: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(set, similar sets) of each probe.  Probes follow one another by similarity, so that most overlaps are derived."""
        waiting = np.zeros(len(self.n), dtype=bool)
        waiting[probes] = True
        slack, last = 0, -1
        sets = overlap = np.zeros(0, dtype=np.int64)
        for first in probes:
            now = int(first)
            while now >= 0:
                if last >= 0:
                    a, b = self.tokens(last), self.tokens(now)
                    gone, new = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                    overlap = overlap - self.hits(gone)[sets] + self.hits(new)[sets]
                elif waiting[now]:
                    slack = int(self.n[now]) // 4
                    sets, overlap = self.search(now, slack)
                else:
                    break
                waiting[now] = False
                found = sets[similar(overlap, self.n[now], self.n[sets])]
                yield now, found[found != now]
                # shingles in which the sets differ: all answers of a set that differs in no more than the slack are here
                apart = np.where(waiting[sets], self.n[now] + self.n[sets] - 2 * overlap, slack + 1)
                k = int(apart.argmin()) if len(sets) else -1
                if k >= 0 and apart[k] <= slack:
                    slack -= int(apart[k])
                    last, now = now, int(sets[k])
                else:
                    last = now = -1


def spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi, and which range each is of."""
    size = hi - lo
    of = np.repeat(np.arange(len(lo)), size)
    return np.arange(len(of)) + (lo - np.cumsum(size) + size)[of], of


def block_edges(rows: pd.DataFrame) -> pd.DataFrame:
    """Spanning edges of the links between the probes of a block and all its sets."""
    rows = rows.drop_duplicates("node").reset_index(drop=True)
    block = Block([np.frombuffer(s, dtype="<u8") for s in rows["hashes"]])
    nodes = rows["node"].to_numpy()[block.order]
    label = np.arange(len(nodes))
    u, v = [], []
    for i, found in block.links(np.flatnonzero(rows["probe"].to_numpy()[block.order])):
        other, where = np.unique(label[found], return_index=True)
        for k, w in zip(other, where, strict=True):
            if k != label[i]:
                u.append(nodes[i])
                v.append(nodes[found[w]])
                label[label == k] = label[i]
    return pd.DataFrame({"u": np.array(u, dtype=np.int64), "v": np.array(v, dtype=np.int64)})


def member_sets(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """``nodes`` with ``hashes``: the set of one document (id and hash of the text) of each node.  Of the texts, only marked ones are shuffled, equal ones once a task."""
    keys = nodes.select(F.xxhash64("id", "t"))
    bits = bits_for(row_count(nodes))
    table = texts.sparkSession.sparkContext.broadcast(bit_table(keys, bits))
    kind = texts.schema["id"].dataType.simpleString()
    own = [f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema]

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            h = batch.column(3).to_numpy()
            use = marked(table.value, leading(batch.column(3), bits))
            for i in np.flatnonzero(use):
                use[i] = h[i] not in seen
                if len(seen) < NODES_HELD:
                    seen.add(int(h[i]))
            if use.any():
                yield batch.filter(pa.array(use)).select([0, 1, 2])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                found = [shingle_set(t.as_py(), size) for t in part.column(0)]
                right = pa.array([len(s) > 0 and fingerprint(s) == node for s, node in zip(found, part.column("node").to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array([s.astype("<u8").tobytes() for s in found], pa.binary())], [*part.schema.names[1:], "hashes"]).filter(right)

    some = texts.select("id", "t", "text", F.xxhash64("id", "t").alias("h")).mapInArrow(near, f"id {kind}, t long, text string")
    met = some.alias("s").join(nodes.hint("shuffle_hash").alias("m"), (F.col("s.t") == F.col("m.t")) & F.col("s.id").eqNullSafe(F.col("m.id")))
    return met.select("s.text", *[f"m.{c}" for c in nodes.columns]).mapInArrow(hashed, ", ".join([*own, "hashes binary"]))


def block_counts(rows: DataFrame, name: str) -> DataFrame:
    return rows.groupBy("family").agg(F.count("*").alias("size"), F.greatest(F.ceil(F.count("*") / BLOCK_SETS), F.ceil(F.sum("n") / BLOCK_SHINGLES)).alias(name))


def family_links(texts: DataFrame, nodes: DataFrame, size: int) -> DataFrame:
    """Links that connect the groups of every family.  ``nodes``: node, family, id and t (of one of its documents), n."""
    nodes = written(nodes.join(block_counts(nodes, "blocks"), "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))))
    every = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    edges = written(member_sets(texts, nodes, size).select("family", "node", "hashes", F.lit(True).alias("probe"), F.explode(every).alias("part")).groupBy("family", "part").applyInPandas(block_edges, "u long, v long"))
    large = nodes.filter("blocks > 1")
    if large.isEmpty():
        return edges
    roots = components(edges.join(large.select(F.col("node").alias("u")), "u", "left_semi"))
    large = large.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = large.groupBy("family", "root").agg(F.count("*").alias("k")).groupBy("family").agg(F.max_by("root", F.struct("k", "root")).alias("main"))
    large = large.join(sizes, "family").withColumn("rest", F.col("root") != F.col("main"))
    # where nothing is left outside the largest group, nothing is left to compare
    large = written(large.join(block_counts(large.filter("rest"), "rests").drop("size"), "family"))
    if large.isEmpty():
        return edges
    sets = member_sets(texts, large.select("id", "t", "node", "family", "n", "block", "blocks", "rest", "rests"), size)
    as_probe = F.when(F.col("rest"), F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.lit(True).alias("probe"), F.pmod(F.xxhash64("node", F.lit(1)), F.col("rests")).alias("r"), k.alias("part"))))
    as_other = F.transform(F.sequence(F.lit(0), F.col("rests") - 1), lambda k: F.struct(F.lit(False).alias("probe"), k.alias("r"), F.col("block").alias("part")))
    dealt = sets.select("family", "node", "hashes", F.explode(F.concat(as_other, F.coalesce(as_probe, F.slice(as_other, 1, 0)))).alias("x")).select("family", "node", "hashes", "x.*")

    def later(rows: pd.DataFrame) -> pd.DataFrame:
        return block_edges(rows.sort_values("probe", ascending=False))

    return edges.unionByName(dealt.groupBy("family", "r", "part").applyInPandas(later, "u long, v long"))


def jaccard_groups(docs: DataFrame, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (smallest id reachable by links)."""
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("t"), F.col(text_col).alias("text"))
    classes = docs.sparkSession.sparkContext.broadcast(count_classes(texts.select("text"), size, sketch_bits))
    sets = written(with_sets(texts, classes, size))
    lists = sets.filter("prefix is not null").select("n", "node", "prefix").mapInArrow(postings, POSTING)
    found = written(lists.repartitionByRange("h", "n", "node").sortWithinPartitions("h", "n", "node").mapInArrow(candidate_edges, CANDIDATE))
    ends = found.filter("h is not null").select("h", "n", F.col("u").alias("node"), "at").repartition("h").sortWithinPartitions("h", "n", "node").mapInArrow(candidate_edges, CANDIDATE)
    edges = found.unionByName(ends).filter("v is not null").select("u", "v").distinct()
    families = components(edges)
    first = written(sets.filter("n > 0").groupBy("node").agg(F.min(F.struct("id", "t")).alias("one"), F.min("id").alias("least"), F.first("n").alias("n"), F.count("*").alias("rows")))
    nodes = families.join(first, "node").select("node", F.col("root").alias("family"), "one.id", "one.t", "n")
    groups = components(family_links(texts, nodes, size))
    in_groups = first.join(groups, "node").select("node", "root", "least")
    least = in_groups.groupBy("root").agg(F.min("least").alias("component_id"))
    linked = in_groups.join(least, "root").select("node", "component_id")
    # rows that neither have copies nor links are their own component and meet nothing
    named = first.join(linked, "node", "left").filter("rows > 1 or component_id is not null").select("node", F.coalesce("component_id", "least").alias("component_id"))
    return sets.join(written(named), "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))

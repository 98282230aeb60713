"""Hard-negative mining by dual-tree search.

Anchors and candidates lie in blocks of near directions, each with a ball tree
that parts labels before places.  Two nodes bound all inner products between
them: with centres a and b and radii r and s, they lie within |a| s + |b| r + r s
of a . b.  Two searches walk pairs of nodes, most promising first, and score leaf
pairs exactly:

* Positives: the best rows of the anchor's label.  A pair of nodes goes for all
  anchors of its group at once if its upper bound lies below the worst kth score
  among them, or if they share no label.
* Negatives: for each positive, the best rows of other labels whose score lies
  between ``low`` and ``high`` percent of the positive's.  A pair of nodes goes if
  its interval misses what every positive of the group still wants, or if both
  sides have one label, the same.

Anchor blocks are dealt to shards of candidate blocks; what an anchor has found
is carried from block to block of a task, and only the best of each task are
shuffled.  Candidates never move after they are dealt; the anchors, a stated
query set, meet them block by block.

Components become floor(scale * x), and scores are 64-bit: |floor(scale * x)| up
to 2 ** 25 at 64 components is safe.  Rows without an id or a label and vectors
that are null or hold null or non-finite components take no part; an empty vector
scores 0 with all, shorter ones count as padded with zeros.  Rows that repeat an
id or a vector are rows of their own: an anchor's candidates are all but its own
row, and a repeated anchor is mined each time.  Ties go to the smaller id.  An
anchor without a positive, and a positive without a negative in its range, give
no row.  Other columns are not read; no rows give no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm.common import row_count, written
from sonospan.llm.vector_blocks import dealt, in_runs, matrix, padded, usable

BLOCK_ROWS, ANCHOR_ROWS = 8192, 1024
LEAF, ANCHOR_LEAF = 128, 32
LEAST, MOST = np.iinfo(np.int64).min, np.iinfo(np.int64).max

ARRAYS = {"ids": "<i8", "rows": "<i8", "labels": "<i8", "exact": "<i8", "lo": "<i4", "hi": "<i4", "left": "<i4", "right": "<i4", "centres": "<f8", "radii": "<f8"}
BLOCK = "n int, dim int, " + ", ".join(f"{c} binary" for c in ARRAYS)


def grown(x: np.ndarray, labels: np.ndarray, leaf: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """A ball tree: the order of rows, and for every node its rows, children (-1: none), centre and radius."""
    order = np.arange(len(x))
    lo, hi, left, right, centres, radii = [0], [len(x)], [-1], [-1], [], []
    node = 0
    while node < len(lo):
        a, b = lo[node], hi[node]
        own = order[a:b]
        part = x[own]
        centre = part.mean(axis=0)
        off = part - centre
        away = np.einsum("ij,ij->i", off, off)
        centres.append(centre)
        radii.append(np.sqrt(away.max()) * (1 + 1e-12))
        if b - a > leaf:
            kinds = labels[own]
            if kinds.min() != kinds.max():
                by = np.argsort(kinds, kind="stable")
                cuts = np.flatnonzero(np.diff(kinds[by])) + 1
                at = int(cuts[np.abs(cuts - (b - a) // 2).argmin()])
            else:
                far = part[away.argmax()]
                gone = part - far
                by = np.argsort(part @ (part[np.einsum("ij,ij->i", gone, gone).argmax()] - far), kind="stable")
                at = (b - a) // 2
            order[a:b] = own[by]
            left[node], right[node] = len(lo), len(lo) + 1
            lo += [a, a + at]
            hi += [a + at, b]
            left += [-1, -1]
            right += [-1, -1]
        node += 1
    return order, {"lo": np.array(lo), "hi": np.array(hi), "left": np.array(left), "right": np.array(right), "centres": np.array(centres), "radii": np.array(radii)}


def blocks(rows: DataFrame, block_rows: int, leaf: int, scale: int, more: str = "") -> DataFrame:
    """Blocks with their trees.  ``rows``: v, id, row, label and, for ``more`` = "least, most", two lists of longs a row."""
    extra = [c for c in more.split(", ") if c]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, "place", block_rows):
            x = np.floor(scale * matrix(table["v"].combine_chunks()))
            labels = table["label"].to_numpy()
            order, tree = grown(x, labels, leaf)
            found = {"ids": table["id"].to_numpy()[order], "rows": table["row"].to_numpy()[order], "labels": labels[order], "exact": x[order], **tree}
            cols = [pa.array([len(order)], pa.int32()), pa.array([x.shape[1]], pa.int32())]
            cols += [pa.array([found[c].astype(t).tobytes()], pa.binary()) for c, t in ARRAYS.items()]
            for c in extra:
                lists = table[c].to_pylist()
                cols.append(pa.array([np.array([lists[i] for i in order], dtype="<i8").tobytes()], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, [c.split()[0] for c in BLOCK.split(", ")] + extra)

    return dealt(rows, block_rows).mapInArrow(run, BLOCK + "".join(f", {c} binary" for c in extra))


class Tree:
    def __init__(self, row: dict, prefix: str = ""):
        for c, kind in ARRAYS.items():
            setattr(self, c, np.frombuffer(row[prefix + c], dtype=kind))
        self.n, self.dim = row[prefix + "n"], row[prefix + "dim"]
        self.exact, self.centres = self.exact.reshape(self.n, self.dim), self.centres.reshape(len(self.lo), self.dim)
        self.least_label = np.array([self.labels[a:b].min() for a, b in zip(self.lo, self.hi, strict=True)])
        self.most_label = np.array([self.labels[a:b].max() for a, b in zip(self.lo, self.hi, strict=True)])
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.centres, self.centres))
        self.most = int(np.abs(self.exact).max(initial=0))


def product(a: Tree, b: Tree, rows: slice, cols: slice, dim: int) -> np.ndarray:
    """Exact inner products: by floating point while every sum stays exact there."""
    kind = np.float64 if a.most * b.most * max(dim, 1) < 1 << 53 else np.int64
    d = min(a.dim, b.dim)
    return (a.exact[rows, :d].astype(kind) @ b.exact[cols, :d].astype(kind).T).astype(np.int64)


def intervals(a: Tree, b: Tree) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of every pair of nodes."""
    d = min(a.dim, b.dim)
    middle = a.centres[:, :d] @ b.centres[:, :d].T
    spread = a.norms[:, None] * b.radii[None] + a.radii[:, None] * b.norms[None] + a.radii[:, None] * b.radii[None]
    spread += 1e-9 * (a.norms + a.radii)[:, None] * (b.norms + b.radii)[None] + 1e-6
    return middle - spread, middle + spread


class Search:
    """What the anchors of a block have found so far, in the order of its tree."""

    def __init__(self, anchors: Tree, slots: int, k: int):
        self.tree, self.k = anchors, k
        #: scores and ids by anchor and slot, best first; a slot that is not full ends in the least number
        self.scores = np.full((anchors.n, slots, k), LEAST)
        self.ids = np.full((anchors.n, slots, k), MOST)
        self.scored = 0

    def add(self, anchor: int, slot: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores[anchor, slot], scores]), np.concatenate([self.ids[anchor, slot], ids])
        order = best_of(scores, ids, self.k)
        self.scores[anchor, slot], self.ids[anchor, slot] = scores[order], ids[order]

    def meet(self, other: Tree) -> None:
        own = self.tree
        least, most = intervals(own, other)
        stack = [(0, 0)]
        while stack:
            a, b = stack.pop()
            rows = slice(own.lo[a], own.hi[a])
            if not self.wanted(a, b, rows, least[a, b], most[a, b], other):
                continue
            if own.left[a] < 0 and other.left[b] < 0:
                self.leaf(rows, slice(other.lo[b], other.hi[b]), other)
            else:
                wider = own.left[a] >= 0 and (other.left[b] < 0 or own.radii[a] >= other.radii[b])
                pairs = [(own.left[a], b), (own.right[a], b)] if wider else [(a, other.left[b]), (a, other.right[b])]
                stack += sorted(pairs, key=lambda p: most[p])  # the most promising is popped first


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to smaller ids."""
    return np.lexsort((ids, ~scores))[:k]  # ~x reverses the order of integers without overflow


class Positives(Search):
    def __init__(self, anchors: Tree, k: int):
        super().__init__(anchors, 1, k)

    def wanted(self, a: int, b: int, rows: slice, least: float, most: float, other: Tree) -> bool:
        own = self.tree
        if own.most_label[a] < other.least_label[b] or other.most_label[b] < own.least_label[a]:
            return False
        return most >= self.scores[rows, 0, -1].min()

    def leaf(self, rows: slice, cols: slice, other: Tree) -> None:
        own = self.tree
        scores = product(own, other, rows, cols, own.dim)
        fit = (own.labels[rows, None] == other.labels[None, cols]) & (own.rows[rows, None] != other.rows[None, cols])
        fit &= scores >= self.scores[rows, 0, -1:]
        self.scored += scores.size
        ids = other.ids[cols]
        for i in np.flatnonzero(fit.any(axis=1)):
            self.add(rows.start + i, 0, scores[i, fit[i]], ids[fit[i]])


class Negatives(Search):
    def __init__(self, anchors: Tree, least: np.ndarray, most: np.ndarray, k: int):
        """``least`` and ``most``: the scores that each anchor's positives allow; where the first is the greater there is nothing to find."""
        super().__init__(anchors, least.shape[1], k)
        self.least, self.most = np.where(least > most, MOST, least), most
        self.highest = np.where(least > most, LEAST, most).max(axis=1)

    def threshold(self, rows: slice) -> np.ndarray:
        return np.maximum(self.least[rows], self.scores[rows, :, -1])

    def wanted(self, a: int, b: int, rows: slice, least: float, most: float, other: Tree) -> bool:
        own = self.tree
        if own.least_label[a] == own.most_label[a] == other.least_label[b] == other.most_label[b]:
            return False
        return least <= self.highest[rows].max() and most >= self.threshold(rows).min()

    def leaf(self, rows: slice, cols: slice, other: Tree) -> None:
        own = self.tree
        scores = product(own, other, rows, cols, own.dim)
        differ = own.labels[rows, None] != other.labels[None, cols]
        self.scored += scores.size
        ids, threshold = other.ids[cols], self.threshold(rows)
        for slot in range(self.least.shape[1]):
            fit = differ & (scores >= threshold[:, slot, None]) & (scores <= self.most[rows, slot, None])
            for i in np.flatnonzero(fit.any(axis=1)):
                self.add(rows.start + i, slot, scores[i, fit[i]], ids[fit[i]])


FOUND = "row long, slot int, id long, score long"


def searched(batches: Iterator[pa.RecordBatch], k: int, slots: int) -> Iterator[pa.RecordBatch]:
    """Rows of an anchor block (``a_`` columns) and a candidate block -> the best of this task by anchor and slot; 0 slots search positives."""
    key, search = None, None

    def found() -> Iterator[pa.RecordBatch]:
        i, j, r = np.nonzero(search.ids != MOST)
        for lo in range(0, len(i), 10_000):
            at = slice(lo, lo + 10_000)
            cols = [search.tree.rows[i[at]], j[at].astype(np.int32), search.ids[i[at], j[at], r[at]], search.scores[i[at], j[at], r[at]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["row", "slot", "id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if key != row["a_block"]:
                if search is not None:
                    yield from found()
                key, tree = row["a_block"], Tree(row, "a_")
                if slots:
                    least, most = (np.frombuffer(row[c], dtype="<i8").reshape(tree.n, slots) for c in ("a_least", "a_most"))
                    search = Negatives(tree, least, most, k)
                else:
                    search = Positives(tree, k)
            search.meet(Tree(row))
    if search is not None:
        yield from found()


def search(anchors: DataFrame, candidates: DataFrame, k: int, slots: int, shards: int) -> DataFrame:
    """row, slot, id, score, rank: the best of all tasks."""
    far = anchors.select(*[F.col(c).alias("a_" + c) for c in anchors.columns]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    near = candidates.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards))).drop("block")
    # the anchor side comes first: a task then meets the candidate blocks of one anchor block after another
    found = far.join(near.hint("merge"), "shard").drop("shard").mapInArrow(lambda it: searched(it, k, slots), FOUND)
    best = Window.partitionBy("row", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding",
    label: str | Column = "label", block_rows: int = BLOCK_ROWS, anchor_rows: int = ANCHOR_ROWS, shards: int | None = None,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_col).alias("v"), F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"))
    rows = written(rows.filter(usable("v", nonzero=False) & F.col("id").isNotNull() & F.col("label").isNotNull()).withColumn("row", F.monotonically_increasing_id()))
    number = lambda df: written(df.withColumn("block", F.monotonically_increasing_id()))
    asked = rows.filter("asked").drop("asked")
    candidates = number(blocks(rows.drop("asked"), block_rows, LEAF, scale))
    shards = shards or max(1, min(row_count(candidates), 4 * vectors.sparkSession.sparkContext.defaultParallelism))
    first = search(number(blocks(asked, anchor_rows, ANCHOR_LEAF, scale)), candidates, positives, 0, shards)
    up, down = F.expr(f"score * {low} div 100 + if(score * {low} % 100 > 0, 1, 0)"), F.expr(f"score * {high} div 100 - if(score * {high} % 100 < 0, 1, 0)")  # `div` cuts towards zero
    found = written(first.select("row", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), up.alias("least"), down.alias("most")))
    # a slot that is not taken allows nothing
    slot = lambda c, none: F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.element_at(F.map_from_entries(F.collect_list(F.struct("slot", c))), i), F.lit(none)))
    bands = found.groupBy("row").agg(slot("least", 1).alias("least"), slot("most", 0).alias("most"))  # ``positives`` rows a group at most
    banded = asked.join(bands, "row").select("v", "id", "row", "label", "least", "most")
    second = search(number(blocks(banded, anchor_rows, ANCHOR_LEAF, scale, "least, most")), candidates, negatives, positives, shards)
    out = second.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(found, ["row", "slot"]).join(asked.select("row", F.col("id").alias("anchor_id")), "row")
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")

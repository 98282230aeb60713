"""Connected components of a distributed edge list by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.common import row_count, written

#: Edges that a task contracts at a time.
FOREST_EDGES = 1 << 18
#: A node can be heavy in a large step if it has more edges than this and than a thousandth of them all.
HEAVY = 1 << 20
STATE = "u long, v long, moved boolean, done boolean"


def forest(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest of its component, among these edges alone."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    own = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[own], nodes[label[own]]


def contracted(pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges of the same components, about one for each node of a run of ``FOREST_EDGES``."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0
    for pair in pairs:
        held.append(pair)
        size += len(pair[0])
        if size >= FOREST_EDGES:
            held = [forest(*(np.concatenate(x) for x in zip(*held, strict=True)))]
            if 2 * len(held[0][0]) >= FOREST_EDGES:
                yield held.pop()
            size = sum(len(x[0]) for x in held)
    if size:
        yield forest(*(np.concatenate(x) for x in zip(*held, strict=True)))


def rows_of(u, v, moved=False, done=False) -> pa.RecordBatch:
    flags = (np.array(np.broadcast_to(np.asarray(x, dtype=bool), len(u))) for x in (moved, done))
    return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), *map(pa.array, flags)], ["u", "v", "moved", "done"])


def numbers(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [c.to_numpy(zero_copy_only=False) for c in batch.columns]


def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (done, u, v): every larger neighbour of u goes to the smallest of u and its neighbours."""
    last = least = None
    for batch in batches:
        u, v, _, done = numbers(batch)
        if done.any():
            yield batch.filter(pa.array(done))
            u, v = u[~done], v[~done]
        if not len(u):
            continue
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        low = np.minimum(u[starts], v[starts])
        begun = np.ones(len(starts), dtype=bool)
        if u[0] == last:
            low[0], begun[0] = least, False
        last, least = u[-1], low[-1]
        m = np.repeat(low, np.diff(np.append(starts, len(u))))
        up = v > u
        root = starts[begun & (low == u[starts])]
        yield rows_of(np.concatenate([v[up], u[root]]), np.concatenate([m[up], u[root]]), np.concatenate([(m != u)[up], np.zeros(len(root), dtype=bool)]))


def small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (u, v), v up to u: u and its smaller neighbours go to the smallest of these."""
    last = least = None
    for batch in batches:
        u, v, moved, _ = numbers(batch)
        if not len(u):
            continue
        starts = np.flatnonzero(np.concatenate([[True], u[1:] != u[:-1]]))
        low = v[starts].copy()
        first = np.zeros(len(u), dtype=bool)
        first[starts] = True
        if u[0] == last:
            low[0], first[0] = least, False
        last, least = u[-1], low[-1]
        m = np.repeat(low, np.diff(np.append(starts, len(u))))
        own = first | ((v == m) & moved)
        other = (v != m) & (v != u)
        yield rows_of(np.concatenate([u[own], v[other]]), np.concatenate([m[own], m[other]]), np.concatenate([moved[own], np.ones(other.sum(), dtype=bool)]))


def heavy_nodes(edges: DataFrame, heavy: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes with too many edges for one task and their smallest neighbours: at most 2,000, by the bound on their edges."""
    total = row_count(edges)
    if total <= heavy:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    ends = edges.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
    rows = ends.groupBy("u").agg(F.count("*").alias("n"), F.min("v").alias("v")).filter(F.col("n") > max(heavy, total // 1000)).orderBy("u").collect()
    return np.array([r["u"] for r in rows], dtype=np.int64), np.array([r["v"] for r in rows], dtype=np.int64)


def both_ways(node: np.ndarray, least: np.ndarray):
    """A mapper to edges in both directions; those of heavy nodes are moved at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = numbers(batch)[:2]
            other = a != b
            u, v = np.concatenate([a, b[other]]), np.concatenate([b, a[other]])
            if len(node):
                at = np.minimum(np.searchsorted(node, u), len(node) - 1)
                own = node[at] == u
                m = np.minimum(u, least[at])
                up = own & (v > u)
                root = np.unique(u[own & (m == u)])
                yield rows_of(np.concatenate([v[up], root]), np.concatenate([m[up], root]), np.concatenate([(m != u)[up], np.zeros(len(root), dtype=bool)]), True)
                u, v = u[~own], v[~own]
            yield rows_of(u, v)

    return run


def components(edges: DataFrame, most_rounds: int = 60, heavy: int = HEAVY) -> DataFrame:
    """``u``, ``v`` edges of long ids -> ``node``, ``root`` (the smallest id reachable), a row for each node that has an edge.

    Tasks first contract the edges they hold.  A round then has one shuffle a
    step; rows come sorted, so a step streams and a node's smallest neighbour is
    its first.  Nodes with very many edges are moved by the mappers, from a table
    of at most 2,000 of them, and so are no single task.  Each round's edges go to
    the checkpoint folder.  Nulls are dropped, and so are self-loops; no edges
    give no rows.
    """

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for u, v in contracted(tuple(numbers(b)) for b in batches if b.num_rows):
            yield rows_of(u, v)

    now = written(edges.select("u", "v").dropna().filter("u <> v").mapInArrow(start, STATE))
    for _ in range(most_rounds):
        moved = now.mapInArrow(both_ways(*heavy_nodes(now, heavy)), STATE).repartition("u").sortWithinPartitions("done", "u", "v").mapInArrow(large, STATE)
        now = written(moved.repartition("u").sortWithinPartitions("u", "v").mapInArrow(small, STATE))
        if now.filter("moved").isEmpty():
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")

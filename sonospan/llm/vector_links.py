"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Vectors are scaled to length one and quantised to int8, each with its own scale
and the exact length e of what rounding took.  Two of them then differ from the
product of their integers by e1 + (1 + e1) * e2 at most.  Tiles of integers are
multiplied; a pair whose product plus bound stays below the threshold cannot be
linked, every other pair is computed anew in double precision, and that value
alone decides.

Rows lie in blocks of near directions.  A block knows its centre and its widest
angle; two blocks whose angles leave no room for a link never meet.  A block's
rows go to the block it is paired with, so a task holds two blocks at a time.
Links are counted in the tile and contracted to a forest there: a group of any
number of near copies leaves about one edge a row and task, not its pairs.

Equal vectors are one row with a weight, so copies cost nothing and count in
full.  The product is quadratic in the rows of blocks that can meet, which is the
method's nature.

Vectors that are null, empty or zero or hold null or non-finite components link
with nothing; shorter vectors count as padded with zeros.  Every row comes back,
rows that repeat an id included.  A row without an id takes part; a component's
id is the least id that there is, null if there is none, and a row without an id
is not kept.  Other columns are not read; no rows give no result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.llm.common import written
from sonospan.llm.components import FOREST_EDGES, components, forest
from sonospan.llm.vector_blocks import dealt, in_runs, matrix, padded, units, usable

BLOCK_ROWS = 2048
TILE = 1024
#: Blocks that a block meets in one task.
MEETINGS = 64
#: What single-precision scaling of an exact integer product, and rounding of bounds, can add.
SLACK = 2e-6

BLOCK = "block long, n int, dim int, nodes binary, weights binary, cells binary, scales binary, errors binary, kind string, exact binary, centre binary, angle double"


def quantised(u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 cells, scales and the lengths of the rounding errors of unit rows."""
    scale = np.abs(u).max(axis=1, initial=0) / 127
    scale = np.where(scale > 0, scale, 1)
    cells = np.rint(u / scale[:, None]).astype(np.int8)
    left = u - scale[:, None] * cells
    return cells, scale, np.sqrt(np.einsum("ij,ij->i", left, left)) * (1 + 1e-12) + 1e-15


def packed(table: pa.Table, block: int) -> pa.RecordBatch:
    x = matrix(table["v"].combine_chunks())
    u = units(x)
    # single precision where it holds the values as they are; lengths are divided out again where they are read
    with np.errstate(over="ignore"):
        small = x.astype("<f4")
    kind, exact = ("<f4", small) if (small == x).all() else ("<f8", x)
    cells, scale, error = quantised(u)
    centre = units(u.sum(axis=0)[None])[0]
    angle = float(np.arccos(np.clip((u @ centre).min(), -1, 1))) if centre.any() else math.pi
    nodes, weights = (table[c].to_numpy().astype("<i8") for c in ("node", "n"))
    row = [block, len(u), u.shape[1], *(y.tobytes() for y in (nodes, weights, cells, scale, error)), kind, exact.tobytes(), centre.tobytes(), angle]
    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 5, pa.string(), pa.binary(), pa.binary(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in BLOCK.split(", ")])


class Block:
    """A block's rows, its integers widened so that their products are exact."""

    def __init__(self, row: dict):
        n, dim = row["n"], row["dim"]
        read = lambda name, kind="<f8": np.frombuffer(row[name], dtype=kind)
        self.block, self.n, self.dim = row["block"], n, dim
        self.nodes, self.weights = read("nodes", "<i8"), read("weights", "<i8")
        self.cells = read("cells", np.int8).reshape(n, dim).astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)
        self.scales, self.errors, self.units = read("scales"), read("errors"), units(read("exact", row["kind"]).reshape(n, dim).astype(np.float64))

    def widened(self, dim: int) -> tuple[np.ndarray, np.ndarray]:
        return padded(self.cells, dim), padded(self.units, dim)


def spanned(mask: np.ndarray, rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of the same components as a dense tile of links."""
    none = np.iinfo(np.int64).max
    keep, keep_cols = mask.any(axis=1), mask.any(axis=0)
    mask, rows, cols = mask[np.ix_(keep, keep_cols)], rows[keep], cols[keep_cols]
    low, low_cols = rows.copy(), cols.copy()
    while len(rows):
        new_cols = np.minimum(low_cols, np.where(mask, low[:, None], none).min(axis=0))
        new = np.minimum(low, np.where(mask, new_cols[None], none).min(axis=1))
        if (new == low).all() and (new_cols == low_cols).all():
            break
        low, low_cols = new, new_cols
    u, v = np.concatenate([rows, cols]), np.concatenate([low, low_cols])
    return u[u != v], v[u != v]


def met(a: Block, b: Block, cosine: float, count_a: np.ndarray, count_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Forests of the links between two blocks (or within one), tile by tile; links are added to the counts by weight."""
    dim, same = max(a.dim, b.dim), a is b
    (cells_a, units_a), (cells_b, units_b) = a.widened(dim), b.widened(dim)
    scale_a, scale_b = a.scales.astype(cells_a.dtype), b.scales.astype(cells_b.dtype)
    for i in range(0, a.n, TILE):
        at = slice(i, i + TILE)
        for j in range(i if same else 0, b.n, TILE):
            to = slice(j, j + TILE)
            product = cells_a[at] @ cells_b[to].T
            product *= scale_a[at, None]
            product *= scale_b[None, to]
            least = cosine - SLACK - a.errors[at] - (1 + a.errors[at]) * b.errors[to].max()
            hit = product >= least[:, None].astype(product.dtype)
            rows = np.flatnonzero(hit.any(axis=1))
            cols = np.flatnonzero(hit[rows].any(axis=0))
            if not len(rows):
                continue
            hit = hit[np.ix_(rows, cols)]
            rows, cols = rows + i, cols + j
            if 8 * np.count_nonzero(hit) > hit.size:
                linked = units_a[rows] @ units_b[cols].T >= cosine
                if same and i == j:
                    linked &= rows[:, None] != cols[None]
                count_a[rows] += linked @ b.weights[cols]
                if not (same and i == j):
                    count_b[cols] += a.weights[rows] @ linked
                yield spanned(linked, a.nodes[rows], b.nodes[cols])
            else:
                r, c = (x[y] for x, y in zip((rows, cols), np.nonzero(hit), strict=True))
                if same and i == j:
                    r, c = r[r < c], c[r < c]
                for lo in range(0, len(r), 1 << 16):
                    p, q = r[lo : lo + (1 << 16)], c[lo : lo + (1 << 16)]
                    linked = np.einsum("ij,ij->i", units_a[p], units_b[q]) >= cosine
                    p, q = p[linked], q[linked]
                    np.add.at(count_a, p, b.weights[q])
                    np.add.at(count_b, q, a.weights[p])
                    yield forest(a.nodes[p], b.nodes[q])


FOUND = "u long, v long, n long"


def met_blocks(batches: Iterator[pa.RecordBatch], cosine: float) -> Iterator[pa.RecordBatch]:
    """Sorted rows of (owner, part, other): the owner's own block first -> counted links (v null) and edges (n null)."""
    own: Block | None = None
    key = None
    count = np.zeros(0, dtype=np.int64)
    edges: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def counted(block: Block, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        some = n > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(block.nodes[some]), pa.nulls(some.sum(), pa.int64()), pa.array(n[some])], ["u", "v", "n"])

    def joined() -> Iterator[pa.RecordBatch]:
        if edges:
            u, v = forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], ["u", "v", "n"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            if key != (row["owner"], row["part"]):
                if own is not None:
                    yield from counted(own, count)
                key, own = (row["owner"], row["part"]), Block(row)
                count = np.zeros(own.n, dtype=np.int64)
                if not row["within"]:
                    continue
            other = own if row["other"] == own.block else Block(row)
            theirs = count if other is own else np.zeros(other.n, dtype=np.int64)
            for e in met(own, other, cosine, count, theirs):
                edges.append(e)
                size += len(e[0])
                if size >= FOREST_EDGES:
                    edges = [forest(*(np.concatenate(x) for x in zip(*edges, strict=True)))]
                    size = len(edges[0][0])
                    if 2 * size >= FOREST_EDGES:
                        yield from joined()
                        edges, size = [], 0
            if other is not own:
                yield from counted(other, theirs)
    if own is not None:
        yield from counted(own, count)
    yield from joined()


def meetings(blocks: DataFrame, cosine: float) -> DataFrame:
    """owner, other, part: pairs of blocks whose angles leave room for a link, itself included, one of either kept as the owner."""
    spark = blocks.sparkSession
    shards = max(1, spark.sparkContext.defaultParallelism)
    places = blocks.select("block", "centre", "angle")
    near = places.withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    far = places.select(F.col("block").alias("to"), F.col("centre").alias("to_centre"), F.col("angle").alias("to_angle"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    reach = math.acos(min(1.0, cosine)) + 1e-6

    def can(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(3).to_numpy()
            room = batch.column(2).to_numpy() + batch.column(5).to_numpy() + reach
            keep = np.ones(len(a), dtype=bool)
            for k, (x, y) in enumerate(zip(batch.column(1), batch.column(4), strict=True)):
                p, q = np.frombuffer(x.as_py()), np.frombuffer(y.as_py())
                d = min(len(p), len(q))
                keep[k] = a[k] == b[k] or math.acos(max(-1.0, min(1.0, float(p[:d] @ q[:d])))) <= room[k]
            a, b = a[keep], b[keep]
            swap = (a ^ b) & 1 == 1
            yield pa.RecordBatch.from_arrays([pa.array(np.where(swap, b, a)), pa.array(np.where(swap, a, b))], ["owner", "other"])

    met = near.join(far.hint("merge"), "shard").filter("block <= to").select("block", "centre", "angle", "to", "to_centre", "to_angle")
    return met.mapInArrow(can, "owner long, other long").withColumn("part", F.pmod(F.xxhash64("other"), F.lit(1 + blocks.count() // MEETINGS)))


def blocks_of(classes: DataFrame, block_rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in in_runs(batches, "place", block_rows):
            yield packed(table, -1)

    blocks = dealt(classes.select("v", "node", "n"), block_rows).mapInArrow(run, BLOCK)
    # small numbers in a row, so that of two blocks either may be the odd one
    return written(blocks.withColumn("block", F.monotonically_increasing_id()).withColumn("block", F.col("block") + F.shiftright("block", 33)))


def vector_links(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per vector: id, n_links (other vectors linked directly), component_id (least id reachable), kept (the id is the component's)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"))
    classes = written(rows.filter(usable("v", nonzero=True)).groupBy("v").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    blocks = blocks_of(classes, block_rows)
    pairs = written(meetings(blocks, cosine))
    payload = blocks.drop("centre", "angle")
    firsts = pairs.groupBy("owner", "part").agg(F.max(F.col("owner") == F.col("other")).alias("within"))
    first = firsts.join(payload, F.col("owner") == F.col("block")).select("owner", "part", F.lit(0).alias("side"), F.col("owner").alias("other"), "within", *payload.columns)
    others = pairs.filter("owner <> other").join(payload, F.col("other") == F.col("block")).select("owner", "part", F.lit(1).alias("side"), "other", F.lit(True).alias("within"), *payload.columns)
    meet = first.unionByName(others).repartition("owner", "part").sortWithinPartitions("owner", "part", "side")
    found = written(meet.mapInArrow(lambda it: met_blocks(it, cosine), FOUND))
    links = found.filter("v is null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    roots = components(found.filter("v is not null").select("u", "v"))
    told = (
        classes.join(links, "node", "left").join(roots, "node", "left")
        .select("v", "least", "n", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root"))
    )
    ids = told.groupBy("root").agg(F.min("least").alias("component_id"))
    known = told.join(ids, "root").select(F.col("v").alias("w"), (F.col("links") + F.col("n") - 1).alias("links"), "component_id")
    out = rows.join(known, F.col("v") == F.col("w"), "left")
    component = F.when(F.col("w").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))

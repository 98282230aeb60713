"""Exact top-k inner-product search with vector-approximation files.

Vectors are packed into blocks of rows: ids, exact integers, and an
approximation of four bits a component (the number of its cell between the
block's least and greatest value of that component), two cells a byte.  A query
scans the bytes of a block through tables of 256 sums, which gives an upper bound
of every score, then reads exact vectors in order of their bounds, in growing
steps, until its kth exact score is above every bound that is left.  The kth
score is carried from block to block of a task, so later blocks are read little
or not at all.

Query blocks are dealt to shards of candidate blocks, so a task holds one block
of either kind at a time, and only k rows a query and task are shuffled.  Every
query meets every block: exact, and no vector is compared with another outside
the stated query set.

Components become floor(scale * x).  Vectors that are null or hold null or
non-finite components take no part, nor do rows without an id; an empty vector
scores 0 with all.  Shorter vectors count as padded with zeros.  A query's
candidates are all rows but its own: rows that repeat an id or a vector meet, and
a repeated query row is searched each time.  Ties go to the smaller id.  Scores
are 64-bit: |floor(scale * x)| up to 2 ** 25 at 64 components is safe.  Other
columns are not read; no rows give no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.llm.common import row_count, written

CELLS = 16
BLOCK_ROWS = 8192
QUERY_ROWS = 2048
STEP = 64


def integers(values: np.ndarray, scale: int) -> np.ndarray | None:
    x = np.asarray(values, dtype=np.float64)
    return np.floor(scale * x).astype(np.int64) if np.isfinite(x).all() else None


def approximated(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least values and cell widths of the components, and the packed cells, a row for each vector."""
    if not exact.size:
        return np.zeros(exact.shape[1], dtype="<i8"), np.ones(exact.shape[1], dtype="<i8"), np.zeros((len(exact), -(-exact.shape[1] // 2)), dtype=np.uint8)
    low, high = exact.min(axis=0), exact.max(axis=0)
    width = np.maximum(-(-(high - low + 1) // CELLS), 1)
    cells = ((exact - low) // width).astype(np.uint8)
    cells = np.pad(cells, ((0, 0), (0, cells.shape[1] % 2)))
    return low, width, cells[:, 0::2] << 4 | cells[:, 1::2]


FILE = "n int, dim int, ids binary, asked binary, width string, exact binary, low binary, step binary, cells binary"
TYPES = {"int": pa.int32(), "binary": pa.binary(), "string": pa.string(), "long": pa.int64()}


def record(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(list(c), TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])


def narrow(exact: np.ndarray) -> tuple[str, bytes]:
    width = "<i2" if np.abs(exact).max(initial=0) < 1 << 15 else "<i8"
    return width, exact.astype(width).tobytes()


def blocks(vectors: DataFrame, rows: int, scale: int) -> DataFrame:
    """Vector-approximation files of ``rows`` vectors at most.  ``vectors``: id, v, asked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bool, np.ndarray]] = []

        def packed() -> pa.RecordBatch:
            held.sort(key=lambda r: r[0])  # equal scores then stand in id order
            exact = np.zeros((len(held), max(len(v) for _, _, v in held)), dtype=np.int64)
            for i, (_, _, v) in enumerate(held):
                exact[i, : len(v)] = v
            low, step, cells = approximated(exact)
            ids, asked = np.array([r[0] for r in held], dtype="<i8"), np.array([r[1] for r in held], dtype="u1")
            held.clear()
            return record(FILE, [(len(ids), exact.shape[1], ids.tobytes(), asked.tobytes(), *narrow(exact), low.astype("<i8").tobytes(), step.astype("<i8").tobytes(), cells.tobytes())])

        for batch in batches:
            for id_, values, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                if id_ is None or not values.is_valid or values.values.null_count:
                    continue
                v = integers(values.values.to_numpy(zero_copy_only=False), scale)
                if v is not None:
                    held.append((id_, bool(asked), v))
                    if len(held) == rows:
                        yield packed()
        if held:
            yield packed()

    return vectors.mapInArrow(run, FILE)


QUERY = "q_block long, q_n int, q_dim int, q_ids binary, q_places binary, q_width string, q_exact binary"


def query_blocks(files: DataFrame, rows: int) -> DataFrame:
    """The query rows of every file, with their places in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                places = np.flatnonzero(np.frombuffer(r["asked"], dtype="u1"))
                exact = np.frombuffer(r["exact"], dtype=r["width"]).reshape(r["n"], r["dim"])
                for lo in range(0, len(places), rows):
                    at = places[lo : lo + rows]
                    yield record(QUERY, [(r["block"], len(at), r["dim"], np.frombuffer(r["ids"], dtype="<i8")[at].tobytes(), at.astype("<i4").tobytes(), r["width"], exact[at].tobytes())])

    return files.select("block", "n", "dim", "ids", "asked", "width", "exact").mapInArrow(run, QUERY)


class ApproximationFile:
    """A block: packed cells to scan, exact vectors to read."""

    def __init__(self, row: dict, dim: int):
        self.n, own = row["n"], row["dim"]
        self.ids = np.frombuffer(row["ids"], dtype="<i8")
        self.exact = np.frombuffer(row["exact"], dtype=row["width"]).reshape(self.n, own)
        self.low, self.step = (np.frombuffer(row[k], dtype="<i8") for k in ("low", "step"))
        self.cells = np.frombuffer(row["cells"], dtype=np.uint8).reshape(self.n, -(-own // 2))
        self.own = own
        #: exact vectors read so far
        self.read = 0

    def bounds(self, query: np.ndarray) -> np.ndarray:
        """Upper bounds of a query's scores: sums over bytes of what their two cells can reach at most."""
        q = query[: self.own]
        least = self.low[:, None] + np.arange(CELLS) * self.step[:, None]
        reach = np.where(q[:, None] > 0, q[:, None] * (least + self.step[:, None] - 1), q[:, None] * least)
        reach = np.pad(reach, ((0, self.own % 2), (0, 0)))
        tables = (reach[0::2, :, None] + reach[1::2, None, :]).reshape(-1, CELLS * CELLS)
        out = np.zeros(self.n, dtype=np.int64)
        for table, cells in zip(tables, self.cells.T, strict=True):
            out += table[cells]
        return out

    def top(self, query: np.ndarray, own: int, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, ids) of the k best among ``best`` and this file's rows, the one at ``own`` (-1 for none) left out."""
        bound = self.bounds(query)
        scores, ids = best
        least = scores[-1] if len(scores) == k else None
        near = np.arange(self.n) if least is None else np.flatnonzero(bound >= least)  # equal: a smaller id may win
        near = near[near != own]
        near = near[np.argsort(-bound[near], kind="stable")]
        at, step = 0, STEP
        while at < len(near) and (len(scores) < k or bound[near[at]] >= scores[-1]):
            part = near[at : at + step]
            self.read += len(part)
            scores = np.concatenate([scores, self.exact[part].astype(np.int64) @ query[: self.own]])
            ids = np.concatenate([ids, self.ids[part]])
            order = np.lexsort((ids, -scores))[:k]
            scores, ids = scores[order], ids[order]
            at, step = at + step, step * 2
        return scores, ids


def search(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows of a query block and a candidate block -> a task's k best for each query.  The best are carried while one query block meets its candidate blocks."""
    key, queries, ids, places, best = None, np.zeros((0, 0), dtype=np.int64), np.zeros(0), np.zeros(0), []

    def found() -> Iterator[pa.RecordBatch]:
        for lo in range(0, len(best), 1000):
            n = [len(s) for s, _ in best[lo : lo + 1000]]
            at = np.repeat(np.arange(lo, lo + len(n)), n)
            cols = [ids[at], np.full(len(at), key[0]), places[at], np.concatenate([i for _, i in best[lo : lo + 1000]]), np.concatenate([s for s, _ in best[lo : lo + 1000]])]
            yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in cols], ["query_id", "block", "place", "vec_id", "score"])

    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            dim = max(row["dim"], row["q_dim"])
            if key != (row["q_block"], row["q_places"]):
                if key is not None:
                    yield from found()
                key = row["q_block"], row["q_places"]
                queries = np.frombuffer(row["q_exact"], dtype=row["q_width"]).reshape(row["q_n"], row["q_dim"]).astype(np.int64)
                ids, places = np.frombuffer(row["q_ids"], dtype="<i8"), np.frombuffer(row["q_places"], dtype="<i4")
                best = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))] * len(ids)
            file, wide = ApproximationFile(row, dim), np.pad(queries, ((0, 0), (0, dim - queries.shape[1])))
            own = places if row["block"] == key[0] else np.full(len(ids), -1)
            best = [file.top(wide[j], own[j], best[j], k) for j in range(len(ids))]
    if key is not None:
        yield from found()


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, shards: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest scores among all other rows."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asked"))
    files = written(blocks(rows, block_rows, scale).withColumn("block", F.monotonically_increasing_id()))
    shards = shards or max(1, min(row_count(files), 4 * spark.sparkContext.defaultParallelism))
    near = files.drop("asked").withColumn("shard", F.pmod(F.xxhash64("block"), F.lit(shards)))
    far = query_blocks(files, query_rows).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    # the query side comes first: a task then meets the candidate blocks of one query block after another
    pairs = far.join(near.hint("merge"), "shard").drop("shard")
    found = pairs.mapInArrow(lambda it: search(it, k), "query_id long, block long, place long, vec_id long, score long")
    best = Window.partitionBy("query_id", "block", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

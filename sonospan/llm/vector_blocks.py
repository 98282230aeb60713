"""Vectors as arrays, dealt into blocks of near rows."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pivots that rows are dealt by; they are the fitted sample, and its bound.
PIVOTS = 64


def usable(vec: str | Column, nonzero: bool) -> Column:
    """Whether a vector is there with finite components only and, if asked, is not zero."""
    v = F.col(vec) if isinstance(vec, str) else vec
    whole = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < F.lit(math.inf)))
    return F.coalesce(whole & F.exists(v, lambda x: x != 0) if nonzero else whole, F.lit(False))


def matrix(column: pa.Array, dim: int = 0) -> np.ndarray:
    """Lists without nulls as rows of doubles; shorter ones are padded with zeros."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    width = max(dim, int(sizes.max(initial=0)))
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, zero rows left; neither large nor small components overflow."""
    most = np.abs(x).max(axis=1, initial=0, keepdims=True)
    x = x / np.where(most > 0, most, 1)
    size = np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
    return x / np.where(size > 0, size, 1)


def padded(x: np.ndarray, dim: int) -> np.ndarray:
    return x if x.shape[1] >= dim else np.pad(x, ((0, 0), (0, dim - x.shape[1])))


def dealt(rows: DataFrame, block_rows: int, pivots: int = PIVOTS) -> DataFrame:
    """``rows`` (``v`` first, usable vectors, any further columns), sorted by ``place`` and partitioned by it.

    A place holds about ``block_rows`` rows whose directions are nearest to the
    same pivot.  Pivots are the rows of least hash; a pivot with many rows has
    many places, dealt by the rows' hash, so that no group of near rows is one
    task.
    """
    sample = rows.select("v").orderBy(F.xxhash64("v")).limit(pivots).collect()  # at most ``pivots`` rows
    if not sample:
        return rows.withColumn("place", F.lit(None).cast("string"))
    held = units(matrix(pa.array([r["v"] for r in sample], pa.list_(pa.float64()))))

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column(0))
            dim = max(x.shape[1], held.shape[1])
            near = (units(padded(x, dim)) @ padded(held, dim).T).argmax(axis=1) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], [*batch.schema.names, "pivot"])

    near = rows.mapInArrow(nearest, ", ".join(f"`{n}` {t}" for n, t in [*rows.dtypes, ("pivot", "int")]))
    counts = {r["pivot"]: r["n"] for r in near.groupBy("pivot").agg(F.count("*").alias("n")).collect()}  # at most ``pivots`` rows
    parts = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, max(1, -(-n // block_rows)))])[F.col("pivot")]
    place = F.concat_ws(".", "pivot", F.pmod(F.xxhash64(*[c for c in rows.columns if c != "v"]), parts))
    return near.withColumn("place", place).drop("pivot").repartition("place").sortWithinPartitions("place")


def in_runs(batches: Iterator[pa.RecordBatch], column: str, most: int) -> Iterator[pa.Table]:
    """Rows of a sorted stream in tables of one value each, of at most ``most`` rows."""
    held: list[pa.RecordBatch] = []
    size, value = 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(batch.schema.get_field_index(column)).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and key[lo] != value:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            value = key[lo]
            while lo < hi:
                part = batch.slice(lo, min(hi - lo, most - size))
                held.append(part)
                lo, size = lo + part.num_rows, size + part.num_rows
                if size == most:
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)

"""Helpers that several operators share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def written(df: DataFrame) -> DataFrame:
    """``df`` computed once and read back from the shared checkpoint folder, so later readers don't depend on this plan or on one executor.

    The cluster names the folder in spark.checkpoint.dir; only a local master (tests) may leave it unset and gets a folder of its machine.
    """
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if folder is None and not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return df.checkpoint()


def n_words(col):
    """Number of words of a text column; null has none."""
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def row_count(df: DataFrame) -> int:
    """Rows of a written table, by one number a task and no shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([sum(b.num_rows for b in batches)], pa.int64())], ["n"])

    return sum(r["n"] for r in df.select(F.lit(1).alias("one")).mapInArrow(count, "n long").collect())


def bits_for(rows: int, most: int = 27) -> int:
    """Bits of a table of marks for so many keys: about one in sixteen is set, up to 16 MB."""
    return min(most, max(12, rows.bit_length() + 4))


def bit_table(hashes: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits, packed: those that the leading bits of a long column name are set.

    Tasks and the driver see tables of that size, whatever the number of rows.
    """

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, dtype=bool)
        for batch in batches:
            table[leading(batch.column(0), bits)] = True
        parts = np.packbits(table).reshape(64, -1)
        full = np.flatnonzero(parts.any(axis=1))
        if len(full):
            yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array([parts[k].tobytes() for k in full], pa.binary())], ["part", "marks"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, m in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                total[k] = total.get(k, np.uint8(0)) | np.frombuffer(m.as_py(), dtype=np.uint8)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([m.tobytes() for m in total.values()], pa.binary())], ["part", "marks"])

    found = np.zeros((64, (1 << bits) // 512), dtype=np.uint8)
    for r in hashes.mapInArrow(mark, "part int, marks binary").repartition("part").mapInArrow(add, "part int, marks binary").collect():  # 2 ** bits bits in all
        found[r["part"]] = np.frombuffer(r["marks"], dtype=np.uint8)
    return found.reshape(-1)


def leading(hashes: pa.Array, bits: int) -> np.ndarray:
    return hashes.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)


def marked(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether bits of a packed table are set."""
    return (table[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0

"""Arrow wrappers: one row of samples in, frames or measures out, one NumPy pass per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def power_rows(df: DataFrame, key: str, samples: str) -> DataFrame:
    """Power spectrum of each row's samples: key, bin, power."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spectra = [np.abs(np.fft.rfft(np.asarray(x.values, dtype=np.float64))) ** 2 for x in batch.column(1)]
            sizes = [len(s) for s in spectra]
            rows = np.repeat(np.arange(len(sizes)), sizes)
            bins = np.concatenate([np.arange(n) for n in sizes]) if sizes else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(bins.astype(np.int32)), pa.array(np.concatenate(spectra) if sizes else np.zeros(0))], [key, "bin", "power"])

    return df.select(key, F.col(samples)).mapInArrow(run, f"{key} {kind}, bin int, power double")


def chunked(audio: DataFrame, seconds: float, frame_seconds: float, hop_seconds: float, key: str = "bundle_id") -> DataFrame:
    """Recordings cut for kernels that look at one frame at a time: about ``seconds`` each, overlapping so that every frame is whole in one of them.

    ``first`` is the number of a piece's first sample; ``analysed`` adds it to the times.
    """
    rate, n = F.col("sample_rate"), F.size("samples")
    frame, hop = F.round(F.lit(frame_seconds) * rate).cast("int"), F.greatest(F.round(F.lit(hop_seconds) * rate).cast("int"), F.lit(1))
    each = F.greatest(F.floor(F.lit(seconds) * rate / hop).cast("int"), F.lit(1))  # frames a piece
    pieces = F.sequence(F.lit(0), F.greatest(n - frame, F.lit(0)), each * hop)
    cut = audio.select(key, "sample_rate", "samples", (each * hop - hop + frame).alias("_size"), F.explode(pieces).alias("first"))
    return cut.select(key, "sample_rate", F.slice("samples", F.col("first") + 1, F.col("_size")).alias("samples"), "first").repartition(key, "first")


def analysed(audio: DataFrame, kernel: Callable[[np.ndarray, int], dict[str, np.ndarray | list]], schema: str, key: str = "bundle_id") -> DataFrame:
    """Frames of every recording.  ``audio``: key, sample_rate, samples (mono).

    ``kernel`` gets samples and rate and returns columns of equal length, named
    as in ``schema``.  A recording is one row, so a path over all its frames (a
    Viterbi search, a global maximum) is found in one call; pieces of ``chunked``
    recordings have a column ``first`` and get their times shifted.
    """
    kind = audio.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                made = kernel(np.asarray(batch.column(2)[i].values, dtype=np.float64), batch.column(1)[i].as_py())
                if batch.num_columns > 3:
                    made["t"] = made["t"] + batch.column(3)[i].as_py() / batch.column(1)[i].as_py()
                n = len(next(iter(made.values())))
                if n:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(n, i))), *[v if isinstance(v, pa.Array) else pa.array(v) for v in made.values()]], [key, *made])

    first = ["first"] if "first" in audio.columns else []
    return audio.select(key, F.col("sample_rate").cast("int"), "samples", *first).mapInArrow(run, f"{key} {kind}, {schema}")

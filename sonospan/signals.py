"""Signals that rules name without storing them: ``f0`` and ``intensity``, computed from a corpus's audio where it is asked for."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonospan.functions import dsp
from sonospan.sources import formats
from sonospan.store import Corpus

FRAME_SECONDS, HOP_SECONDS, VOICING = 0.025, 0.010, 0.45
BUILT_IN = ("f0", "intensity")


def touched(corpus: Corpus, rois: DataFrame) -> DataFrame:
    """bundle_id, first, n: the samples of the level frames whose times lie in ``rois`` (bundle_id, start, end), stretches that overlap as one."""
    rate = F.col("sample_rate")
    size, hop = F.round(FRAME_SECONDS * rate).cast("long"), F.greatest(F.round(HOP_SECONDS * rate).cast("long"), F.lit(1))
    known = corpus.table("bundle").select(F.col("id").alias("bundle_id"), "sample_rate", "n_frames")
    frame = lambda t: (F.col(t) * rate - size / 2) / hop
    # one frame more on either side: which frames count is decided by their times
    begin = F.greatest(F.floor(frame("start")) - 1, F.lit(0)) * hop
    end = F.least((F.ceil(frame("end")) + 1) * hop + size, F.col("n_frames"))
    spans = rois.join(known, "bundle_id").select("bundle_id", begin.alias("begin"), end.alias("stop")).filter("stop > begin").distinct()
    before = Window.partitionBy("bundle_id").orderBy("begin", "stop").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy("bundle_id").orderBy("begin", "stop")
    marked = spans.withColumn("new", F.coalesce(F.col("begin") > F.max("stop").over(before), F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(upto))
    return marked.groupBy("bundle_id", "island").agg(F.min("begin").alias("first"), (F.max("stop") - F.min("begin")).alias("n")).select("bundle_id", "first", "n")


def audio_spans(corpus: Corpus, spans: DataFrame) -> DataFrame:
    """bundle_id, sample_rate, first, samples (mono) of stretches (bundle_id, first, n) of the corpus's recordings.

    Only audio of the bundles asked for is read, and of that only the stretches are
    decoded and moved.  Samples that a live recording lost are zeros.
    """
    asked = spans.groupBy("bundle_id").agg(F.sort_array(F.collect_list(F.struct("first", "n"))).alias("asked"))
    parts = corpus.table("audio").select("bundle_id", F.coalesce("first_frame", F.lit(0)).alias("begin"), "content").join(asked, "bundle_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bundle, begin, content, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                rate, channels, samples = formats.decode_wav(content.as_py())
                mono = samples.reshape(-1, channels).mean(axis=1).astype("<f4") if channels > 1 else samples
                for s in asked:
                    lo, hi = max(s["first"], begin), min(s["first"] + s["n"], begin + len(mono))
                    if hi > lo:
                        cols = [pa.array([bundle]), pa.array([rate], pa.int32()), pa.array([s["first"]]), pa.array([s["n"]]), pa.array([lo - s["first"]]), pa.array([mono[lo - begin : hi - begin].astype("<f4").tobytes()], pa.binary())]
                        yield pa.RecordBatch.from_arrays(cols, ["bundle_id", "sample_rate", "first", "n", "at", "piece"])

    pieces = parts.mapInArrow(cut, "bundle_id long, sample_rate int, first long, n long, at long, piece binary")
    whole = pieces.groupBy("bundle_id", "sample_rate", "first", "n").agg(F.collect_list(F.struct("at", "piece")).alias("pieces"))

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                x = np.zeros(batch.column(3)[i].as_py(), dtype="<f4")
                for p in batch.column(4)[i].as_py():
                    own = np.frombuffer(p["piece"], dtype="<f4")
                    x[p["at"] : p["at"] + len(own)] = own
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(i, 1) for k in range(3)), pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))], ["bundle_id", "sample_rate", "first", "samples"])

    return whole.mapInArrow(joined, "bundle_id long, sample_rate int, first long, samples array<float>")


def computed(corpus: Corpus, name: str, rois: DataFrame, whole: bool) -> DataFrame:
    """bundle_id, t, v of a built-in signal over ``rois``; over all of their bundles if ``whole``.

    Levels look at one frame at a time, so those of a stretch are those of the whole
    track.  ``f0`` is a path over the recording, so a bundle that is asked for is
    taken as a whole; unvoiced frames are left out.
    """
    if whole or name == "f0":
        known = corpus.table("bundle").filter("n_frames > 0").join(rois.select(F.col("bundle_id").alias("id")).distinct(), "id", "left_semi")
        spans = known.select(F.col("id").alias("bundle_id"), F.lit(0).cast("long").alias("first"), F.col("n_frames").alias("n"))
    else:
        spans = touched(corpus, rois)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                rate, first, x = batch.column(1)[i].as_py(), batch.column(2)[i].as_py(), np.asarray(batch.column(3)[i].values, dtype=float)
                if name == "f0":
                    made = dsp.pitch(x, rate)
                    keep = made["voicing"] >= VOICING
                    t, v = made["t"][keep], made["hz"][keep]
                else:
                    made = dsp.intensity(x, rate, FRAME_SECONDS, HOP_SECONDS)
                    t, v = made["t"], made["db"]
                if len(t):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.full(len(t), i))), pa.array(t + first / rate), pa.array(np.asarray(v, dtype=float))], ["bundle_id", "t", "v"])

    return audio_spans(corpus, spans).mapInArrow(run, "bundle_id long, t double, v double")

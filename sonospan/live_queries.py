"""Registered queries that run streams: the events of each user are replayed as chunks of a live session."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonospan import workflow
from sonospan.corpus_queries import new_corpus
from sonospan.plans import projections as view
from sonospan.queries import register, rounded
from sonospan.store import Corpus
from sonospan.streaming import live


def incoming(c: Corpus, sf_dir: str, shape: list[float], rate: int, part: int) -> DataFrame:
    """Half of the events (by time) as chunks of a few samples; every eleventh is lost, every thirteenth comes twice.  The second half brings the ends."""
    n = len(shape)
    place = F.row_number().over(Window.partitionBy("bundle_id").orderBy("t", "id")) - 1
    rows = view.points(c.spark, sf_dir).withColumn("first", (place * n).cast("long"))
    at = lambda t: F.timestamp_micros((t * 1e6).cast("long"))
    half = rows.agg(F.max("t")).first()[0] / 2
    mine = rows.filter((F.col("t") <= half) if part == 0 else (F.col("t") > half)).filter("id % 11 <> 3")
    times = F.when(F.col("id") % 13 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    samples = F.array(*[(F.col("v") / 1000 * x).cast("float") for x in shape])
    session = F.concat(F.lit("u"), "bundle_id").alias("session_id")
    chunks = mine.withColumn("_", F.explode(times)).select(session, "first", F.lit(rate).alias("sample_rate"), samples.alias("samples"), at(F.col("t")).alias("at"), F.lit(False).alias("last"))
    if part == 1:
        ends = rows.groupBy("bundle_id").agg((F.count("*") * n).alias("first"))
        chunks = chunks.unionByName(ends.select(session, "first", F.lit(rate).alias("sample_rate"), F.array().cast("array<float>").alias("samples"), at(F.lit(2 * half)).alias("at"), F.lit(True).alias("last")))
        # a session without samples moves the event time on, so that what is missing before the ends counts as lost
        clock = c.spark.range(1).select(F.lit("clock").alias("session_id"), F.lit(0).cast("long").alias("first"), F.lit(rate).alias("sample_rate"), F.array().cast("array<float>").alias("samples"), at(F.lit(4 * half)).alias("at"), F.lit(True).alias("last"))
        chunks = chunks.unionByName(clock)
    return chunks


def replayed(c: Corpus, sf_dir: str, shape: list[float], rate: int, run) -> None:
    """``run`` on the first half, and after a restart on the second."""
    path = f"{c.root}/_incoming"
    for part in (0, 1):
        incoming(c, sf_dir, shape, rate, part).write.parquet(f"{path}/part-{part}")
        run(c.spark.readStream.schema(live.CHUNK).option("recursiveFileLookup", "true").parquet(path)).awaitTermination()


CHUNKS = "k AS (SELECT bundle_id, v, id % 11 = 3 AS gone, row_number() OVER (PARTITION BY bundle_id ORDER BY t, id) AS k FROM p)"
LONG = 60.0 * 86_400


@register(f"""+ {CHUNKS}, s AS (SELECT bundle_id, round_even(greatest(least(unnest([v / 1000, v / 1000 * -0.5, v / 1000 * 0.25, v / 1000 * 0])::FLOAT::DOUBLE, 1), -1) * 32767, 0) / 32768 AS y FROM k WHERE NOT gone)
SELECT 'u' || bundle_id AS name, n.n_frames, n.dropped_samples, 'live_recording' AS kind, round(max(abs(y)), 6) AS peak, round(sqrt(avg(y * y)), 6) AS rms, 0::BIGINT AS parts_left
FROM s JOIN (SELECT bundle_id, 4 * count(*) AS n_frames, 4 * count(*) FILTER (gone) AS dropped_samples FROM k GROUP BY 1) n USING (bundle_id) GROUP BY ALL""")
def live_recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions recorded by a stream that is stopped and started again, then committed as bundles; what their audio and runs say."""
    c = new_corpus(spark)
    replayed(c, sf_dir, [1.0, -0.5, 0.25, 0.0], 8, lambda chunks: live.record(c, chunks, "mic", idle_seconds=LONG))
    square = F.aggregate("samples", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    heard = workflow.load_audio(c).groupBy("bundle_id").agg(F.max(F.array_max(F.transform("samples", F.abs))).cast("double").alias("peak"), F.sqrt(F.sum(square) / F.sum(F.size("samples"))).alias("rms"))
    runs = c.table("processing_run").select("bundle_id", "kind", F.get_json_object("parameters", "$.dropped_samples").cast("long").alias("dropped_samples"))
    bundles = c.table("bundle").select(F.col("id").alias("bundle_id"), "name", "n_frames")
    left = c.table("recording_part").count()
    return rounded(bundles.join(runs, "bundle_id").join(heard, "bundle_id").select("name", "n_frames", "dropped_samples", "kind", "peak", "rms", F.lit(left).cast("long").alias("parts_left")))


SHAPE = [1.0, -1.0, 0.5, -0.5, 0.25, -0.25, 0.125, -0.125, 0.0, 0.0]


@register(f"""+ {CHUNKS}, e AS (SELECT bundle_id, k, list_sum(list_transform({SHAPE}, lambda x: pow((v / 1000 * x)::FLOAT::DOUBLE, 2))) AS e FROM k WHERE NOT gone),
f AS (SELECT bundle_id, k, e + lead(e) OVER w + lead(e, 2) OVER w AS e, lead(k, 2) OVER w AS k2 FROM e WINDOW w AS (PARTITION BY bundle_id ORDER BY k))
SELECT 'u' || bundle_id AS session_id, round((k - 1) / 100 + 0.015, 6) AS t, round(sqrt(e / 30), 6) AS rms, round(greatest(CASE WHEN e > 0 THEN 20 * log10(sqrt(e / 30)) ELSE -200 END, -200), 6) AS db FROM f WHERE k2 = k + 2""")
def live_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels of the frames that a stream makes as chunks arrive; frames that lost samples touch are left out."""
    c = new_corpus(spark)
    sink = live.FrameTable(c, "levels")
    replayed(c, sf_dir, SHAPE, 1000, lambda chunks: live.start(live.hop_frames(chunks, idle_seconds=LONG, measures=("level",)), sink, f"{c.root}/_streams/levels"))
    return rounded(sink.read().select("session_id", "t", "rms", "db"))

"""Interval algebra: relations, range joins, gaps, islands, clips and grids.

Tiers are DataFrames keyed by ``bundle_id``.  Every range join has the bundle as
its equality key; ``bucket_seconds`` adds a time bucket, so that one very long
bundle spreads over tasks.  Matches are kept in the bucket where they first meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-9


def contains(outer_start: Column, outer_end: Column, start: Column, end: Column) -> Column:
    """Containment with a tolerance of 1e-9 at both ends."""
    return (start >= outer_start - EPS) & (end <= outer_end + EPS)


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Strict overlap: touching intervals do not."""
    return (a_start < b_end) & (b_start < a_end)


def overlap_seconds(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    return F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0.0))


def bucketed(df: DataFrame, start: str, end: str, seconds: float, pad: float = 0.0) -> DataFrame:
    """A row for each time bucket that an interval touches."""
    first, last = (F.floor((F.col(c) + p) / seconds) for c, p in ((start, -pad), (end, pad)))
    return df.withColumn("_bucket", F.explode(F.sequence(first, last)))


def range_join(a: DataFrame, b: DataFrame, condition: Column, how: str = "inner", bucket_seconds: float | None = None, a_span: tuple[str, str] = ("a_start", "a_end"), b_span: tuple[str, str] = ("b_start", "b_end")) -> DataFrame:
    """Join on ``bundle_id`` and a residual condition; semi joins may use buckets too, since a repeated hit changes nothing."""
    if bucket_seconds is None:
        return a.join(b.withColumnRenamed("bundle_id", "_b"), (F.col("bundle_id") == F.col("_b")) & condition, how).drop("_b")
    x, y = bucketed(a, *a_span, bucket_seconds, EPS), bucketed(b, *b_span, bucket_seconds, EPS).withColumnsRenamed({"bundle_id": "_b", "_bucket": "_c"})
    on = (F.col("bundle_id") == F.col("_b")) & (F.col("_bucket") == F.col("_c")) & condition
    if how in ("left_semi", "semi"):
        return x.join(y, on, "left_semi").drop("_bucket").distinct()
    first = F.greatest(F.floor((F.col(a_span[0]) - EPS) / bucket_seconds), F.floor((F.col(b_span[0]) - EPS) / bucket_seconds))
    return x.join(y, on, how).filter(F.col("_bucket") == first).drop("_b", "_c", "_bucket")


def within(tier: DataFrame, outer: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Intervals of ``tier`` that lie in an interval of ``outer``; nothing if there is none."""
    o = outer.select("bundle_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return range_join(tier, o, contains(F.col("b_start"), F.col("b_end"), F.col("start"), F.col("end")), "left_semi", bucket_seconds, ("start", "end"))


def overlapping(tier: DataFrame, other: DataFrame, bucket_seconds: float | None = None) -> DataFrame:
    """Intervals of ``tier`` that overlap an interval of ``other``."""
    o = other.select("bundle_id", F.col("start").alias("b_start"), F.col("end").alias("b_end"))
    return range_join(tier, o, overlaps(F.col("start"), F.col("end"), F.col("b_start"), F.col("b_end")), "left_semi", bucket_seconds, ("start", "end"))


def overlap_pairs(tier: DataFrame, keys: list[str]) -> DataFrame:
    """``n_overlaps`` by key: pairs of a tier's own intervals that overlap by more than 1e-9.

    Counted in one sorted pass: an interval overlaps those before it that have
    not ended, so pairs = sum over intervals of (starts so far) - (ends so far).
    """
    events = tier.select(*keys, F.explode(F.array(F.struct((F.col("end") - EPS).alias("at"), F.lit(0).alias("open")), F.struct(F.col("start").alias("at"), F.lit(1).alias("open")))).alias("e")).select(*keys, "e.*")
    w = Window.partitionBy(*keys).orderBy("at", "open").rowsBetween(Window.unboundedPreceding, -1)
    running = events.withColumn("alive", F.coalesce(F.sum(F.when(F.col("open") == 1, 1).otherwise(-1)).over(w), F.lit(0)))
    return running.groupBy(*keys).agg(F.sum(F.when(F.col("open") == 1, F.greatest("alive", F.lit(0))).otherwise(0)).alias("n_overlaps"))


def fill_gaps(tier: DataFrame, key: str = "bundle_id") -> DataFrame:
    """Intervals with empty ones put where a gap of more than 1e-9 precedes them; an overlap raises an error.  No trailing pad."""
    w = Window.partitionBy(key).orderBy("start", "id")
    prior = F.coalesce(F.lag("end").over(w), F.lit(0.0))
    rows = tier.select(key, "id", "start", "end", "label", prior.alias("_prior"))
    rows = rows.withColumn("start", F.when(F.col("start") < F.col("_prior") - EPS, F.raise_error(F.lit("overlapping intervals")).cast("double")).otherwise(F.col("start")))
    gap = F.when(F.col("start") > F.col("_prior") + EPS, F.struct(F.lit(None).cast("long").alias("id"), F.col("_prior").alias("start"), F.col("start").alias("end"), F.lit("").alias("label")))
    own = F.struct("id", "start", "end", F.coalesce("label", F.lit("")).alias("label"))
    return rows.select(key, F.explode(F.filter(F.array(gap, own), lambda x: x.isNotNull())).alias("x")).select(key, "x.*")


def islands(frames: DataFrame, qualifies: Column, key: str = "bundle_id", time: str = "t", end: str | None = None) -> DataFrame:
    """Maximal runs of qualifying frames, as (key, start, end, n_frames)."""
    w = Window.partitionBy(key).orderBy(time)
    marked = frames.withColumn("_ok", F.coalesce(qualifies, F.lit(False)))
    marked = marked.withColumn("_new", (F.col("_ok") & ~F.coalesce(F.lag("_ok").over(w), F.lit(False))).cast("int"))
    marked = marked.withColumn("_run", F.sum("_new").over(w)).filter("_ok")
    return marked.groupBy(key, "_run").agg(F.min(time).alias("start"), F.max(end or time).alias("end"), F.count("*").alias("n_frames")).drop("_run")


def clip(tokens: DataFrame, context: DataFrame, key: str = "bundle_id", bucket_seconds: float | None = None) -> DataFrame:
    """Context intervals cut to token windows; pieces of 1e-9 or less are dropped.  ``tokens``: key, token, start, end."""
    t = tokens.select(F.col(key).alias("_k"), "token", F.col("start").alias("t_start"), F.col("end").alias("t_end"))
    lo, hi = F.greatest("start", "t_start"), F.least("end", "t_end")
    on = (F.col(key) == F.col("_k")) & (F.col("start") < F.col("t_end")) & (F.col("t_start") < F.col("end"))
    if bucket_seconds is not None:  # a pair counts in the first bucket that both touch
        context, t = bucketed(context, "start", "end", bucket_seconds), bucketed(t, "t_start", "t_end", bucket_seconds).withColumnRenamed("_bucket", "_c")
        on = on & (F.col("_bucket") == F.col("_c")) & (F.col("_bucket") == F.floor(F.greatest("start", "t_start") / bucket_seconds))
    return context.join(t, on).filter(hi - lo > EPS).select(key, "token", F.col("id"), lo.alias("clip_start"), hi.alias("clip_end"), "label")


def frame_grid(extents: DataFrame, step: float, key: str = "bundle_id") -> DataFrame:
    """Frame centres (k + 0.5) * step for k < ceil(extent / step)."""
    n = F.ceil(F.col("extent") / step)
    return extents.filter("extent > 0").select(key, F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("k")).withColumn("t", (F.col("k") + 0.5) * step)


def label_at(grid: DataFrame, tier: DataFrame, name: str, key: str = "bundle_id", bucket_seconds: float | None = None) -> DataFrame:
    """Label of the first interval (by start, id) with start <= t < end for each grid point; the gap category elsewhere, and for null labels."""
    s = tier.select(F.col(key).alias("_k"), "id", "start", "end", "label")
    on = (F.col(key) == F.col("_k")) & (F.col("start") <= F.col("t")) & (F.col("t") < F.col("end"))
    if bucket_seconds is not None:  # a point lies in one bucket
        s, grid = bucketed(s, "start", "end", bucket_seconds), grid.withColumn("_c", F.floor(F.col("t") / bucket_seconds))
        on = on & (F.col("_bucket") == F.col("_c"))
    hit = grid.join(s, on, "left")
    return hit.groupBy(key, "k", "t").agg(F.coalesce(F.min(F.when(F.col("_k").isNotNull(), F.struct("start", "id", "label")))["label"], F.lit("∅")).alias(name))


def merge_tiers(tiers: list[DataFrame]) -> DataFrame:
    """Tiers put together, in order of (start, end, source, id); nothing is removed."""
    both = [t.select("bundle_id", F.lit(i).alias("source"), "id", "start", "end", "label") for i, t in enumerate(tiers)]
    out = both[0]
    for x in both[1:]:
        out = out.unionByName(x)
    return out.withColumn("position", F.row_number().over(Window.partitionBy("bundle_id").orderBy("start", "end", "source", "id")))


def retimed(tokens: DataFrame, gap: float = 0.0) -> DataFrame:
    """Tokens laid end to end in (bundle, start) order: ``at`` is the sum of the lengths and gaps before.

    One running sum over all tokens: partial sums by bundle first, so that the
    window without a partition holds a row for each bundle and not for each token.
    """
    each = F.col("end") - F.col("start") + gap
    of_bundle = tokens.groupBy("bundle_id").agg(F.sum(each).alias("_length"))
    before = of_bundle.withColumn("_before", F.coalesce(F.sum("_length").over(Window.orderBy("bundle_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_length")
    own = F.coalesce(F.sum(each).over(Window.partitionBy("bundle_id").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return tokens.withColumn("_own", own).join(before, "bundle_id").withColumn("at", F.col("_before") + F.col("_own")).drop("_before", "_own")

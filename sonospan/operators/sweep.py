"""Sorted sweeps over time: piecewise-constant tiers, and reductions of samples in intervals, without exploded time buckets.

Rows are dealt by (bundle, slice).  A bundle has one slice while it is small; one
with more than ``SLICE_ROWS`` rows is cut into equal spans of time, as many as its
rows need, so that a very long bundle is many tasks.  What crosses a border is
carried over it: running values come from one row a slice, and an interval that
runs into later slices gets their samples.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GAP = "∅"
#: Rows of a bundle from which it is cut.
SLICE_ROWS = 200_000
#: Samples that a task reduces at a time.
GATHERED = 1 << 20


def spans(times: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame | None:
    """bundle_id, _low, _width, _parts of every bundle that is cut; None if none is.  ``times``: bundle_id, t."""
    extents = times.groupBy("bundle_id").agg(F.count("*").alias("_n"), F.min("t").alias("_low"), F.max("t").alias("_high")).filter((F.col("_n") > slice_rows) & (F.col("_high") > F.col("_low")))
    parts = F.ceil(F.col("_n") / slice_rows).cast("int")
    cut = extents.select("bundle_id", "_low", ((F.col("_high") - F.col("_low")) / parts).alias("_width"), parts.alias("_parts"))
    return None if cut.isEmpty() else cut


def slice_of(t: Column) -> Column:
    """The slice of a time, for rows joined with ``spans``; 0 where the bundle is not cut."""
    return F.coalesce(F.least(F.greatest(F.floor((t - F.col("_low")) / F.col("_width")).cast("int"), F.lit(0)), F.col("_parts") - 1), F.lit(0))


def sliced(rows: DataFrame, cut: DataFrame | None, t: Column) -> DataFrame:
    """``rows`` with ``_slice``."""
    if cut is None:
        return rows.withColumn("_slice", F.lit(0))
    return rows.join(cut, "bundle_id", "left").withColumn("_slice", slice_of(t)).drop("_low", "_width", "_parts")


def carried(rows: DataFrame, keys: list[str], values: dict[str, Column], over) -> DataFrame:
    """``rows`` with what earlier slices of their keys hand on: ``values`` by slice, ``over(column, window)`` of all slices before."""
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    known = rows.groupBy(*keys, "_slice").agg(*[v.alias(c) for c, v in values.items()])
    return rows.join(known.withColumns({c: over(c, before) for c in values}), [*keys, "_slice"])


def first_cover(tiers: DataFrame, cut: DataFrame | None) -> DataFrame:
    """Where each interval is the first (by start, id) that covers a time: bundle_id, side, start, end, label.

    An interval is covered by earlier ones up to the greatest end among them, and
    from there on is the first itself, so a running maximum finds the part that
    is its own.
    """
    rows = sliced(tiers.filter("start < end"), cut, F.col("start"))
    own = Window.partitionBy("bundle_id", "_slice", "side").orderBy("start", "id").rowsBetween(Window.unboundedPreceding, -1)
    if cut is None:
        rows = rows.repartition("bundle_id").withColumn("_ended", F.max("end").over(own))
    else:
        rows = carried(rows, ["bundle_id", "side"], {"_before": F.max("end")}, lambda c, w: F.max(c).over(w)).repartition("bundle_id", "_slice")
        rows = rows.withColumn("_ended", F.greatest(F.max("end").over(own), "_before"))
    begin = F.greatest("start", "_ended")
    return rows.select("bundle_id", "side", begin.alias("start"), "end", "label").filter("start < end")


def centres_before(t: Column, step: float) -> Column:
    """How many frame centres (k + 0.5) * step, k >= 0, lie before a time; as exact as comparing the centres."""
    k = F.ceil(t / step - 0.5)
    centre = lambda c: (c + 0.5) * step
    return F.greatest(F.when(centre(k - 1) >= t, k - 1).when(centre(k) >= t, k).otherwise(k + 1), F.lit(0))


def frame_pairs(a: DataFrame, b: DataFrame, step: float, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """bundle_id, a, b, n: how many frames up to the last end have these two labels.

    Both tiers are piecewise constant, so frames are counted by stretches between
    two changes, and no frame is a row; a bundle may give several rows with the
    same labels.  Null labels and gaps are one category.
    """
    both = a.select("bundle_id", F.lit(0).alias("side"), "id", "start", "end", "label").unionByName(b.select("bundle_id", F.lit(1).alias("side"), "id", "start", "end", "label"))
    cut = spans(both.select("bundle_id", F.col("start").alias("t")), slice_rows)
    own = first_cover(both, cut)
    change = lambda t, on: F.struct(F.col(t).alias("t"), F.lit(on).alias("on"))
    label = F.when(F.col("e.on") == 1, F.coalesce("label", F.lit(GAP))).otherwise(GAP)
    events = own.select("bundle_id", "side", "label", F.explode(F.array(change("start", 1), change("end", 0))).alias("e"))
    events = events.select("bundle_id", F.col("e.t").alias("t"), F.col("e.on").alias("on"), F.when(F.col("side") == 0, label).alias("a"), F.when(F.col("side") == 1, label).alias("b"))
    if cut is None:
        events = events.withColumn("_slice", F.lit(0))
    else:
        events = sliced(events, cut, F.col("t"))
        latest = lambda c: F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("t", "on")))
        events = carried(events, ["bundle_id"], {"_a": latest("a"), "_b": latest("b"), "_seen": F.max("t")}, lambda c, w: F.last(c, ignorenulls=True).over(w))
        starts = events.groupBy("bundle_id", "_slice").agg(F.min("t").alias("_first"))
        after = Window.partitionBy("bundle_id").orderBy("_slice").rowsBetween(1, Window.unboundedFollowing)
        events = events.join(starts.withColumn("_next", F.min("_first").over(after)).drop("_first"), ["bundle_id", "_slice"]).repartition("bundle_id", "_slice")
    w = Window.partitionBy("bundle_id", "_slice").orderBy("t", "on")
    here = lambda c: F.last(c, ignorenulls=True).over(w)
    now, following, preceding = [here(c) for c in "ab"], F.lead("t").over(w), F.lag("t").over(w)
    if cut is not None:
        now, following, preceding = [F.coalesce(x, F.col(f"_{c}")) for x, c in zip(now, "ab", strict=True)], F.coalesce(following, F.col("_next")), F.coalesce(preceding, F.col("_seen"))
    known = events.select("bundle_id", "t", *[F.coalesce(x, F.lit(GAP)).alias(c) for x, c in zip(now, "ab", strict=True)], following.alias("_following"), preceding.alias("_preceding"))
    before = centres_before(F.col("t"), step)
    # frames after the last change, which is the last end, and before the first are gaps on both sides
    stretch = lambda a, b, n: F.struct(a.alias("a"), b.alias("b"), n.alias("n"))
    own_frames = stretch(F.col("a"), F.col("b"), F.when(F.col("_following").isNull(), F.greatest(F.ceil(F.col("t") / step), F.lit(0))).otherwise(centres_before(F.col("_following"), step)) - before)
    lead_in = F.when(F.col("_preceding").isNull(), F.array(stretch(F.lit(GAP), F.lit(GAP), before), own_frames)).otherwise(F.array(own_frames))
    return known.select("bundle_id", F.explode(lead_in).alias("s")).select("bundle_id", "s.*").filter("n > 0")


def overlapped(rows: DataFrame, cut: DataFrame, start: str, end: str) -> DataFrame:
    """``rows`` once for each slice that they touch."""
    known = rows.join(cut, "bundle_id", "left")
    touched = F.sequence(slice_of(F.col(start)), F.greatest(slice_of(F.col(end)), slice_of(F.col(start))))
    return known.withColumn("_slice", F.explode(touched)).drop("_low", "_width", "_parts")


def with_samples(intervals: DataFrame, samples: DataFrame, cut: DataFrame) -> DataFrame:
    """Samples by the slices that need them: their own, and earlier ones with an interval that runs on to them."""
    reach = intervals.groupBy("bundle_id", "_slice").agg(F.max("end").alias("_reach")).join(cut, "bundle_id")
    onwards = F.sequence(F.col("_slice"), F.greatest(slice_of(F.col("_reach")), F.col("_slice")))
    wanted = reach.select("bundle_id", F.col("_slice").alias("_to"), "_reach", F.explode(onwards).alias("_own"))
    short = samples.join(cut.select("bundle_id"), "bundle_id", "left_anti").withColumn("_slice", F.lit(0))
    long = sliced(samples.join(cut.select("bundle_id"), "bundle_id", "left_semi"), cut, F.col("t")).withColumnRenamed("_slice", "_own")
    return short.unionByName(long.join(wanted, ["bundle_id", "_own"]).filter("t <= _reach").select(*samples.columns, F.col("_to").alias("_slice")))


REDUCERS = ("mean", "max", "min", "range", "median", "std", "argmax", "argmin")


def crossed(times: np.ndarray, values: np.ndarray, of: np.ndarray, at: np.ndarray, which: str, direction: str | None, threshold: float) -> np.ndarray:
    """Where the values of each run first or last cross a threshold, on the line between two samples; NaN where they do not."""
    a, b, t0, t1 = values[:-1], values[1:], times[:-1], times[1:]
    up, down = (a < threshold) & (b >= threshold), (a > threshold) & (b <= threshold)
    hit = (of[:-1] == of[1:]) & {"rising": up, "falling": down, None: up | down}[direction]
    with np.errstate(divide="ignore", invalid="ignore"):
        where = t0 + (threshold - a) / (b - a) * (t1 - t0)
    none = np.inf if which == "first_crossing" else -np.inf
    best = (np.minimum if which == "first_crossing" else np.maximum).reduceat(np.append(np.where(hit, where, none), none), at)
    return np.where(np.isfinite(best), best, np.nan)


def measures(t: np.ndarray, v: np.ndarray, lo: np.ndarray, hi: np.ndarray, wanted: list[str | tuple]) -> dict[str | tuple, np.ndarray]:
    """Reductions of samples ``lo`` to ``hi`` of each interval, which holds one at least; t ascends, and v where t is equal.

    NaN makes a mean, a median's upper part and a deviation NaN, never wins an
    extreme and crosses nothing; ties go to the earliest time.  A crossing is
    (which, direction, threshold).
    """
    n = hi - lo
    at = np.concatenate([[0], np.cumsum(n)[:-1]])
    take = np.arange(n.sum()) - np.repeat(at - lo, n)
    values, times, of = v[take], t[take], np.repeat(np.arange(len(n)), n)
    out: dict[str | tuple, np.ndarray] = {}
    mean = np.add.reduceat(values, at) / n
    out["mean"] = mean
    for crossing in (r for r in wanted if isinstance(r, tuple)):
        out[crossing] = crossed(times, values, of, at, *crossing)
    if "std" in wanted:
        off = values - mean[of]
        out["std"] = np.sqrt(np.add.reduceat(off * off, at) / n)
    if "median" in wanted:
        order = np.lexsort((values, of))
        ranked = values[order]
        out["median"] = (ranked[at + (n - 1) // 2] + ranked[at + n // 2]) / 2
    if {"max", "min", "range", "argmax", "argmin"} & set(wanted):
        real = ~np.isnan(values)
        some = np.logical_or.reduceat(real, at)
        top, low = np.maximum.reduceat(np.where(real, values, -np.inf), at), np.minimum.reduceat(np.where(real, values, np.inf), at)
        for name, best in (("argmax", top), ("argmin", low)):
            first = np.minimum.reduceat(np.where(real & (values == best[of]), times, np.inf), at)
            out[name] = np.where(some, first, np.nan)
        out["max"], out["min"] = np.where(some, top, np.nan), np.where(some, low, np.nan)
        out["range"] = np.where(some, top - low, np.nan)
        out["_none"] = ~some
    return out


class Sweep:
    """Intervals and samples of one (bundle, slice) in order of time: an interval is reduced when time has passed its end."""

    def __init__(self, wanted: list[tuple[str, str | tuple]]):
        self.wanted = wanted  # (output column, reducer); "samples" gives the (t, v) themselves
        self.open: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []
        self.t, self.v = np.zeros(0), np.zeros(0)

    def add(self, rows: pa.RecordBatch, start: np.ndarray, end: np.ndarray, t: np.ndarray, v: np.ndarray) -> None:
        if rows.num_rows:
            self.open.append((rows, start, np.where(np.isnan(end), -np.inf, end)))
        if len(t):
            self.t, self.v = np.concatenate([self.t, t]), np.concatenate([self.v, v])

    def close(self, now: float) -> Iterator[pa.RecordBatch]:
        """Intervals that end before ``now``; samples that no open interval can hold go."""
        left = []
        for rows, start, end in self.open:
            done = end < now
            if done.any():
                yield from self.reduced(rows.filter(pa.array(done)), start[done], end[done])
            if not done.all():
                left.append((rows.filter(pa.array(~done)), start[~done], end[~done]))
        self.open = left
        first = min((s.min() for _, s, _ in left), default=now)
        keep = np.searchsorted(self.t, first, "left")
        if keep:
            self.t, self.v = self.t[keep:], self.v[keep:]

    def reduced(self, rows: pa.RecordBatch, start: np.ndarray, end: np.ndarray) -> Iterator[pa.RecordBatch]:
        lo, hi = np.searchsorted(self.t, start, "left"), np.searchsorted(self.t, end, "right")
        hi = np.maximum(hi, lo)
        size = np.cumsum(hi - lo)
        at = 0
        while at < len(lo):  # runs of intervals with so many samples in all, one at least
            to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + GATHERED, "right")))
            yield self.part(rows.slice(at, to - at), lo[at:to], hi[at:to])
            at = to

    def part(self, rows: pa.RecordBatch, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
        some = hi > lo
        found = measures(self.t, self.v, lo[some], hi[some], [r for _, r in self.wanted]) if some.any() else {}
        cols = list(rows.columns)
        for _, reducer in self.wanted:
            if reducer == "samples":
                offsets = np.concatenate([[0], np.cumsum(hi - lo)]).astype(np.int32)
                take = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - lo, hi - lo)
                pairs = pa.StructArray.from_arrays([pa.array(self.t[take]), pa.array(self.v[take])], ["t", "v"])
                cols.append(pa.ListArray.from_arrays(pa.array(offsets), pairs, mask=pa.array(~some)) if len(lo) else pa.array([], pa.list_(pairs.type)))
                continue
            whole, null = np.zeros(len(lo)), ~some
            if some.any():
                whole[some] = found[reducer]
                if isinstance(reducer, tuple):
                    null |= np.isnan(whole)
                elif reducer in ("max", "min", "range", "argmax", "argmin"):
                    null[np.flatnonzero(some)[found["_none"]]] = True
            cols.append(pa.array(whole, mask=null))
        return pa.RecordBatch.from_arrays(cols, [*rows.schema.names, *[c for c, _ in self.wanted]])


def swept(batches: Iterator[pa.RecordBatch], wanted: list[tuple[str, str]]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (bundle, slice, at, v): the columns of intervals, then _slice, at, v (null for intervals)."""
    sweep, key = Sweep(wanted), None
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        bundles = batch.column(batch.schema.get_field_index("bundle_id")).dictionary_encode().indices.to_numpy(zero_copy_only=False)
        slices = batch.column(n_columns := batch.num_columns - 3).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero((bundles[1:] != bundles[:-1]) | (slices[1:] != slices[:-1])) + 1).tolist(), n]
        own = batch.select(range(n_columns))
        at, v = (batch.column(n_columns + k).to_numpy(zero_copy_only=False) for k in (1, 2))
        sample = batch.column(n_columns + 2).is_valid().to_numpy(zero_copy_only=False)
        start, end = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("start", "end"))
        for lo, hi in zip(edges, edges[1:], strict=False):
            here = (batch.column(batch.schema.get_field_index("bundle_id"))[lo].as_py(), slices[lo])
            if key != here:
                yield from sweep.close(np.inf)
                sweep, key = Sweep(wanted), here
            mine = sample[lo:hi]
            rows = np.flatnonzero(~mine) + lo
            sweep.add(own.take(pa.array(rows)), start[rows], end[rows], at[lo:hi][mine], v[lo:hi][mine])
        yield from sweep.close(at[n - 1])
    yield from sweep.close(np.inf)


def reduced_in(intervals: DataFrame, samples: DataFrame, wanted: list[tuple[str, str | tuple]], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """``intervals`` (bundle_id, start, end and more) with a column for each (name, reducer) over the samples (bundle_id, t, v) in their closed span.

    An interval without a sample gets nulls.  ``samples`` as a reducer gives the
    (t, v) in order.  State of a task: intervals that are open and the samples
    since the first of these began.
    """
    samples = samples.select("bundle_id", "t", "v").filter("v is not null and t is not null")
    cut = spans(samples, slice_rows)
    placed = sliced(intervals, cut, F.col("start"))
    given = samples.withColumn("_slice", F.lit(0)) if cut is None else with_samples(placed, samples, cut)
    nothing = [F.lit(None).cast(t).alias(c) for c, t in intervals.dtypes if c != "bundle_id"]
    rows = placed.select(*intervals.columns, "_slice", F.col("start").alias("_at"), F.lit(None).cast("double").alias("_v"))
    points = given.select("bundle_id", *nothing, "_slice", F.col("t").cast("double").alias("_at"), F.col("v").cast("double").alias("_v"))
    points = points.select(*rows.columns)
    both = rows.unionByName(points).repartition(*(["bundle_id"] if cut is None else ["bundle_id", "_slice"])).sortWithinPartitions("bundle_id", "_slice", "_at", "_v")
    kinds = [*intervals.dtypes, *[(c, "array<struct<t: double, v: double>>" if r == "samples" else "double") for c, r in wanted]]
    return both.mapInArrow(lambda it: swept(it, wanted), ", ".join(f"`{c}` {t}" for c, t in kinds))

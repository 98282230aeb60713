"""Greedy one-to-one matching of two tiers, without a bundle's pairs in one task.

A greedy choice by a strict order takes exactly the pairs that are the best of
both their sides, then those that are the best of what is left, and so on, in any
order of places.  So places that cannot see each other are matched apart:

* Intervals overlap within islands, runs of intervals that touch in time; islands
  are dealt to tasks and matched in streams.  Only an island of more rows than a
  task should hold is matched by rounds over the cluster, each of which moves the
  pairs that are still free.
* Points are matched in slices of time.  A pair is taken if it is nearer than
  anything beyond the slice's borders can be; what stays free meets again in
  wider slices, until one holds it all.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonospan.checkpoints import settled
from sonospan.operators.sweep import SLICE_ROWS, carried, overlapped, slice_of, sliced, spans

#: Rounds of vectors before a heap takes over, for chains that free one pair a round.
ROUNDS = 40


def ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(i, j) for every i and every j from lo[i] to hi[i] - 1."""
    n = np.maximum(hi - lo, 0)
    i = np.repeat(np.arange(len(n)), n)
    return i, np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - lo, n)


def dominant(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the greedy's pairs among pairs (a, b) in its order."""
    left, taken = np.arange(len(a)), []
    for _ in range(ROUNDS):
        if not len(left):
            break
        first = []
        for side in (a[left], b[left]):
            _, at, of = np.unique(side, return_index=True, return_inverse=True)
            first.append((at[of] == np.arange(len(left)), of))
        now = first[0][0] & first[1][0]
        taken.append(left[now])
        gone = [np.isin(of, of[now]) for _, of in first]
        left = left[~(gone[0] | gone[1])]
    used_a: set[int] = set()
    used_b: set[int] = set()
    for k in left.tolist():  # a chain
        if a[k] not in used_a and b[k] not in used_b:
            used_a.add(a[k])
            used_b.add(b[k])
            taken.append(np.array([k]))
    return np.sort(np.concatenate(taken)) if taken else np.zeros(0, dtype=np.int64)


# ---- intervals


INTERVAL = ("a_id", "a_start", "a_end", "a_label", "b_id", "b_start", "b_end", "b_label")


def matched_islands(table: pa.Table) -> pa.RecordBatch:
    """Whole islands in order (bundle, start) -> their matched pairs.  Columns: bundle_id, side, id, start, end, label, _new."""
    table = table.combine_chunks()
    side, ids, start, end = (table[c].to_numpy() for c in ("side", "id", "start", "end"))
    island = np.cumsum(table["_new"].to_numpy(zero_copy_only=False))
    rows = [np.flatnonzero(side == s) for s in (0, 1)]
    rows = [r[np.lexsort((ids[r], start[r], island[r]))] for r in rows]
    order = [np.rec.fromarrays([island[r], start[r]]) for r in rows]
    at = lambda side_, place, t: _search(order[side_], place, t)
    ra, rb = rows
    # b begins within a, or a begins within b after it
    i1, j1 = ranges(at(1, island[ra], start[ra]), at(1, island[ra], end[ra]))
    j2, i2 = ranges(at(0, island[rb], np.nextafter(start[rb], np.inf)), at(0, island[rb], end[rb]))
    i, j = ra[np.concatenate([i1, i2])], rb[np.concatenate([j1, j2])]
    overlap = np.minimum(end[i], end[j]) - np.maximum(start[i], start[j])
    some = overlap > 0
    i, j, overlap = i[some], j[some], overlap[some]
    by = np.lexsort((ids[j], start[j], ids[i], start[i], -overlap))
    i, j, overlap = i[by], j[by], overlap[by]
    took = dominant(i, j)
    i, j = pa.array(i[took]), pa.array(j[took])
    cols = [table["bundle_id"].take(i)]
    cols += [table[c].take(k) for k in (i, j) for c in ("id", "start", "end", "label")]
    return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols] + [pa.array(overlap[took])], ["bundle_id", *INTERVAL, "overlap"])


def _search(order: np.recarray, place: np.ndarray, t: np.ndarray) -> np.ndarray:
    """First position in ``order`` (place, t ascending) that is not before (place, t)."""
    begin, stop = np.searchsorted(order.f0, place, "left"), np.searchsorted(order.f0, place, "right")
    times = order.f1
    while True:  # a binary search of every row at once, each in the run of its place
        open_ = begin < stop
        if not open_.any():
            return begin
        middle = (begin + stop) // 2
        before = open_ & (times[np.minimum(middle, len(times) - 1)] < t) if len(times) else np.zeros(len(begin), dtype=bool)
        begin, stop = np.where(before, middle + 1, begin), np.where(open_ & ~before, middle, stop)


def in_islands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream of islands; the last of a batch waits for the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.flatnonzero(batch.column(batch.schema.get_field_index("_new")).to_numpy(zero_copy_only=False))
        if len(new):
            held.append(batch.slice(0, new[-1]))
            table = pa.Table.from_batches(held)
            if table.num_rows:
                yield matched_islands(table)
            held = [batch.slice(new[-1])]
        else:
            held.append(batch)
    if held and sum(b.num_rows for b in held):
        yield matched_islands(pa.Table.from_batches(held))


def rounds(pairs: DataFrame) -> DataFrame:
    """The greedy's pairs by rounds over the cluster: those that are the best of both sides are taken, the free ones go on."""
    order = F.struct((-F.col("overlap")).alias("o"), "a_start", "a_id", "b_start", "b_id")
    left, taken = settled(pairs), None
    while not left.isEmpty():
        ranked = left.withColumn("_a", F.min(order).over(Window.partitionBy("bundle_id", "a_id"))).withColumn("_b", F.min(order).over(Window.partitionBy("bundle_id", "b_id")))
        ranked = settled(ranked.withColumn("_took", (F.col("_a") == order) & (F.col("_b") == order)).drop("_a", "_b"))
        now = ranked.filter("_took").drop("_took")
        taken = now if taken is None else taken.unionByName(now)
        left = ranked.filter("not _took").drop("_took")
        for side in ("a_id", "b_id"):
            left = left.join(now.select("bundle_id", side), ["bundle_id", side], "left_anti")
        left = settled(left.select(*pairs.columns))
    return pairs.limit(0) if taken is None else taken


def match_intervals(a: DataFrame, b: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Greedy one-to-one matching by (overlap descending, a, b) in each bundle: bundle_id, a_id, b_id, labels, times, overlap.

    Order of a and b is (start, id); only overlaps count.
    """
    both = a.select("bundle_id", F.lit(0).alias("side"), "id", "start", "end", "label").unionByName(b.select("bundle_id", F.lit(1).alias("side"), "id", "start", "end", "label")).filter("start < end")
    kind = {c: both.schema[c].dataType.simpleString() for c in ("bundle_id", "id", "label")}
    schema = f"bundle_id {kind['bundle_id']}, " + ", ".join(f"{s}_id {kind['id']}, {s}_start double, {s}_end double, {s}_label {kind['label']}" for s in "ab") + ", overlap double"
    cut = spans(both.select("bundle_id", F.col("start").alias("t")), slice_rows)
    before = Window.partitionBy("bundle_id", "_slice").orderBy("start", "side", "id").rowsBetween(Window.unboundedPreceding, -1)
    if cut is None:  # no island is larger than a bundle, and no bundle is large
        rows = both.repartition("bundle_id").withColumn("_slice", F.lit(0))
        rows = rows.withColumn("_new", F.coalesce(F.col("start") >= F.max("end").over(before), F.lit(True))).drop("_slice")
        return rows.mapInArrow(in_islands, schema)
    rows = carried(sliced(both, cut, F.col("start")), ["bundle_id"], {"_ended": F.max("end")}, lambda c, w: F.max(c).over(w))
    rows = rows.repartition("bundle_id", "_slice").withColumn("_new", F.coalesce(F.col("start") >= F.greatest(F.max("end").over(before), "_ended"), F.lit(True)))
    latest = F.max(F.when(F.col("_new"), F.col("start")))
    rows = carried(rows.drop("_ended"), ["bundle_id"], {"_begun": latest}, lambda c, w: F.max(c).over(w))
    upto = Window.partitionBy("bundle_id", "_slice").orderBy("start", "side", "id")
    rows = settled(rows.repartition("bundle_id", "_slice").withColumn("_island", F.coalesce(F.max(F.when(F.col("_new"), F.col("start"))).over(upto), "_begun")).drop("_begun", "_slice"))
    large = settled(rows.groupBy("bundle_id", "_island").agg(F.count("*").alias("_n")).filter(F.col("_n") > slice_rows).drop("_n"))
    small = rows.join(large, ["bundle_id", "_island"], "left_anti").repartition("bundle_id", "_island").sortWithinPartitions("bundle_id", "_island", "start", "side", "id")
    out = small.select("bundle_id", "side", "id", "start", "end", "label", "_new").mapInArrow(in_islands, schema)
    if large.isEmpty():
        return out
    wide = rows.join(large, ["bundle_id", "_island"], "left_semi").select("bundle_id", "side", "id", "start", "end", "label")
    x, y = (overlapped(wide.filter(F.col("side") == k), cut, "start", "end").select("bundle_id", "_slice", *[F.col(c).alias(f"{s}_{c}") for c in ("id", "start", "end", "label")]) for k, s in enumerate("ab"))
    met = x.join(y, ["bundle_id", "_slice"]).filter("a_start < b_end and b_start < a_end")
    begun = sliced(met.withColumnRenamed("_slice", "_met"), cut, F.greatest("a_start", "b_start"))
    pairs = begun.filter("_slice = _met").withColumn("overlap", F.least("a_end", "b_end") - F.greatest("a_start", "b_start")).filter("overlap > 0")
    return out.unionByName(rounds(pairs.select(*out.columns)))


# ---- points


def nearest(place: np.ndarray, side: np.ndarray, t: np.ndarray, low: np.ndarray, high: np.ndarray, final: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows (of side 0, of side 1) that the greedy takes, as far as can be told.

    Rows are in order (place, t, side, id).  Beyond ``low`` and ``high`` of a place
    there may be points that are not here; ``final`` places have none.
    """
    new = np.ones(len(t), dtype=bool)
    new[1:] = (place[1:] != place[:-1]) | (t[1:] != t[:-1]) | (side[1:] != side[:-1])
    at = np.flatnonzero(new)  # instants: the points of one side at one time
    n, next_row = np.diff(np.append(at, len(t))), at.copy()
    p, s, x = place[at], side[at], t[at]
    room = np.minimum(x - low[at], high[at] - x) - 1e-9 * np.maximum(np.abs(x), 1)
    live = np.arange(len(at))
    out: list[tuple[np.ndarray, np.ndarray]] = []

    def take(i: np.ndarray, j: np.ndarray) -> None:
        """The first free points of these pairs of instants, in order."""
        k = np.minimum(n[i], n[j])
        of, step = ranges(np.zeros(len(k), dtype=np.int64), k)
        out.append((next_row[i][of] + step, next_row[j][of] + step))
        for y in (i, j):
            n[y] -= k
            next_row[y] += k

    for _ in range(ROUNDS):
        m = len(live)
        if m < 2:
            break
        q, ls, lx = p[live], s[live], x[live]
        index = np.arange(m)
        best, far = np.full(m, -1), np.full(m, np.inf)
        for k in (0, 1):
            mine, others = ls == k, ls != k
            left = np.maximum.accumulate(np.where(others, index, -1))
            right = np.minimum.accumulate(np.where(others, index, m)[::-1])[::-1]
            for near, ok in ((left, left >= 0), (right, right < m)):
                near = np.clip(near, 0, m - 1)
                ok = ok & mine & (q[near] == q)
                d = np.where(ok, np.abs(lx - lx[near]), np.inf)
                better = ok & (d < far)  # the left one is the smaller in order, and comes first
                best[better], far[better] = near[better], d[better]
        mutual = (best >= 0) & (best[np.maximum(best, 0)] == index) & (ls == 0)
        mutual &= (far < room[live]) & (far < room[live[np.maximum(best, 0)]])
        if not mutual.any():
            return _joined(out)
        take(live[mutual], live[best[mutual]])
        live = live[n[live] > 0]
    else:
        if final:  # a chain that frees a pair a round
            _chain(live, p, s, x, n, take)
    return _joined(out)


def _joined(out: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(o[k] for o in out)]) for k in (0, 1))


def _chain(live: np.ndarray, p: np.ndarray, s: np.ndarray, x: np.ndarray, n: np.ndarray, take) -> None:
    """A heap of neighbouring instants of different sides: the nearest pair that is left is always one of them."""
    after = dict(zip(live.tolist(), [*live[1:].tolist(), -1], strict=True))
    before = dict(zip(live.tolist(), [-1, *live[:-1].tolist()], strict=True))
    heap: list[tuple] = []

    def push(i: int, j: int) -> None:
        if i >= 0 and j >= 0 and p[i] == p[j] and s[i] != s[j]:
            a, b = (i, j) if s[i] == 0 else (j, i)
            heapq.heappush(heap, (abs(x[i] - x[j]), a, b))

    for i in live.tolist():
        push(i, after[i])
    while heap:
        _, a, b = heapq.heappop(heap)
        if not (n[a] and n[b]):
            continue
        take(np.array([a]), np.array([b]))
        for i in (a, b):
            if not n[i]:
                i0, i1 = before[i], after[i]
                if i0 >= 0:
                    after[i0] = i1
                if i1 >= 0:
                    before[i1] = i0
                push(i0, i1)


POINT = ("a_id", "b_id", "a_t", "b_t", "a_label", "b_label")


def in_slices(batches: Iterator[pa.RecordBatch], final: bool) -> Iterator[pa.RecordBatch]:
    """Points in order (bundle, slice, t, side, id) -> matched pairs (side 2) and, unless ``final``, free points."""
    held: list[pa.RecordBatch] = []

    def run(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        bundle = table["bundle_id"].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        part, side, t = (table[c].to_numpy() for c in ("_slice", "side", "t"))
        place = np.cumsum(np.concatenate([[0], (bundle[1:] != bundle[:-1]) | (part[1:] != part[:-1])]))
        low, high = (table[c].to_numpy() for c in ("_from", "_to"))
        i, j = nearest(place, side, t, low, high, final)
        free = np.ones(len(t), dtype=bool)
        free[i] = free[j] = False
        rest = np.zeros(0, dtype=np.int64) if final else np.flatnonzero(free)
        x, y = pa.array(np.concatenate([i, rest])), pa.array(np.concatenate([j, np.full(len(rest), -1)]))
        y = pc.if_else(pc.greater_equal(y, 0), y, pa.scalar(None, pa.int64()))
        cols = [table["bundle_id"].take(x), pa.array(np.concatenate([np.full(len(i), 2), side[rest]]).astype(np.int32))]
        cols += [table[c].take(k) for c in ("id", "t", "label") for k in (x, y)]
        return pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in cols], ["bundle_id", "side", "a_id", "b_id", "a_t", "b_t", "a_label", "b_label"])

    for batch in batches:
        if not batch.num_rows:
            continue
        part = batch.column(batch.schema.get_field_index("_slice")).to_numpy()
        bundle = batch.column(batch.schema.get_field_index("bundle_id")).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        edge = np.flatnonzero((part[1:] != part[:-1]) | (bundle[1:] != bundle[:-1])) + 1
        if len(edge):
            yield run(pa.Table.from_batches([*held, batch.slice(0, edge[-1])]))
            held = [batch.slice(edge[-1])]
        elif held and (held[0].column(held[0].schema.get_field_index("bundle_id"))[0] != batch.column(batch.schema.get_field_index("bundle_id"))[0] or held[0].column(held[0].schema.get_field_index("_slice"))[0] != batch.column(batch.schema.get_field_index("_slice"))[0]):
            yield run(pa.Table.from_batches(held))
            held = [batch]
        else:
            held.append(batch)
    if held:
        yield run(pa.Table.from_batches(held))


def match_points(a: DataFrame, b: DataFrame, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Greedy one-to-one nearest matching over all pairs of a bundle, by (distance, a, b); order of a and b is (t, id)."""
    free = a.select("bundle_id", F.lit(0).alias("side"), "id", "t", "label").unionByName(b.select("bundle_id", F.lit(1).alias("side"), "id", "t", "label")).filter("t is not null")
    kind = {c: free.schema[c].dataType.simpleString() for c in ("bundle_id", "id", "label")}
    schema = f"bundle_id {kind['bundle_id']}, side int, a_id {kind['id']}, b_id {kind['id']}, a_t double, b_t double, a_label {kind['label']}, b_label {kind['label']}"
    found = None
    while True:
        cut = spans(free.select("bundle_id", "t"), slice_rows)
        ends = {"_from": F.lit(-np.inf), "_to": F.lit(np.inf)}
        if cut is None:
            rows = free.withColumns({"_slice": F.lit(0), **ends}).repartition("bundle_id")
        else:
            own = free.join(cut, "bundle_id", "left").withColumn("_slice", slice_of(F.col("t")))
            border = lambda k: F.col("_low") + k * F.col("_width")
            first, last = F.coalesce(F.col("_slice") == 0, F.lit(True)), F.coalesce(F.col("_slice") == F.col("_parts") - 1, F.lit(True))
            rows = own.withColumns({"_from": F.when(first, -np.inf).otherwise(border(F.col("_slice"))), "_to": F.when(last, np.inf).otherwise(border(F.col("_slice") + 1))})
            rows = rows.drop("_low", "_width", "_parts").repartition("bundle_id", "_slice")
        rows = rows.sortWithinPartitions("bundle_id", "_slice", "t", "side", "id")
        made = rows.mapInArrow(lambda it, final=cut is None: in_slices(it, final), schema)
        made = made if cut is None else settled(made)
        taken = made.filter("side = 2").select("bundle_id", *POINT)
        found = taken if found is None else found.unionByName(taken)
        if cut is None:
            return found
        free = made.filter("side < 2").select("bundle_id", "side", F.col("a_id").alias("id"), F.col("a_t").alias("t"), F.col("a_label").alias("label"))
        slice_rows *= 2


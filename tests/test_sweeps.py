"""Sweeps over time and greedy matching against brute force, with bundles whole and cut into slices."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonospan.operators import agreement, matching, sweep

INTERVAL = "bundle_id long, id long, start double, end double, label string"
POINT = "bundle_id long, id long, t double, label string"
SLICES = (sweep.SLICE_ROWS, 25, 5)


def intervals(seed, n, longest=3.0):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        start = r.choice([r.uniform(-2, 60), float(r.randint(0, 60))])
        rows.append((r.choice([1, 2, 2, 2, 3]), i, start, start + r.choice([0.5, 1.0, 1.0, 2.0, r.uniform(0.01, longest)]), r.choice(["a", "b", "c", None])))
    return rows


def greedy_intervals(a, b):
    out = []
    for bundle in {x[0] for x in a + b}:
        pairs = sorted((max(x[2], y[2]) - min(x[3], y[3]), x[2], x[1], y[2], y[1]) for x in a for y in b if x[0] == y[0] == bundle and min(x[3], y[3]) > max(x[2], y[2]))
        used_a, used_b = set(), set()
        for _, _, i, _, j in pairs:
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((bundle, i, j))
    return sorted(out)


@pytest.mark.parametrize(("seed", "longest"), [(0, 3.0), (1, 25.0)])
def test_interval_matching_is_greedy(spark, seed, longest):
    a, b = intervals(seed, 120, longest), intervals(seed + 10, 110, longest)
    want = greedy_intervals(a, b)
    for slice_rows in SLICES:  # in the last one whole islands are matched by rounds
        got = matching.match_intervals(spark.createDataFrame(a, INTERVAL), spark.createDataFrame(b, INTERVAL), slice_rows)
        assert sorted((r.bundle_id, r.a_id, r.b_id) for r in got.collect()) == want


def greedy_points(a, b):
    out = []
    for bundle in {x[0] for x in a + b}:
        x, y = (sorted((p for p in side if p[0] == bundle), key=lambda p: (p[2], p[1])) for side in (a, b))
        used_a, used_b = set(), set()
        for _, i, j in sorted((abs(p[2] - q[2]), i, j) for i, p in enumerate(x) for j, q in enumerate(y)):
            if i not in used_a and j not in used_b:
                used_a.add(i)
                used_b.add(j)
                out.append((bundle, x[i][1], y[j][1]))
    return sorted(out)


@pytest.mark.parametrize("kind", ["ties", "chain"])
def test_point_matching_is_greedy_in_any_slices(spark, kind):
    r = random.Random(3)
    a, b = ([(r.choice([1, 2, 2, 2, k]), i, float(r.choice([r.randint(0, 40), r.uniform(0, 40)])), "x") for i in range(n)] for n, k in ((90, 3), (100, 4)))
    if kind == "chain":  # every distance is a little longer than the one before: a pair is freed at a time
        t, d = 0.0, 1.0
        for i in range(300):
            (a if i % 2 else b).append((9, 1000 + i, t, "x"))
            t, d = t + d, d * 1.002
    want = greedy_points(a, b)
    for slice_rows in SLICES:
        got = matching.match_points(spark.createDataFrame(a, POINT), spark.createDataFrame(b, POINT), slice_rows)
        assert sorted((r.bundle_id, r.a_id, r.b_id) for r in got.collect()) == want


def test_matching_of_nothing(spark):
    none_i, none_p = spark.createDataFrame([], INTERVAL), spark.createDataFrame([], POINT)
    some_i, some_p = spark.createDataFrame(intervals(0, 5), INTERVAL), spark.createDataFrame([(1, 1, 0.5, "x")], POINT)
    assert matching.match_intervals(none_i, some_i).collect() == matching.match_intervals(some_i, none_i).collect() == []
    assert matching.match_points(none_p, some_p).collect() == matching.match_points(some_p, none_p).collect() == []


@pytest.mark.parametrize("step", [0.1, 0.37])
def test_frames_are_counted_without_a_grid(spark, step):
    a, b = intervals(5, 80), intervals(6, 60, 20.0)
    want = Counter()

    def label(rows, bundle, t):
        hits = sorted((x[2], x[1], x[4]) for x in rows if x[0] == bundle and x[2] <= t < x[3])
        return sweep.GAP if not hits or hits[0][2] is None else hits[0][2]

    for bundle in {x[0] for x in a + b}:
        extent = max(x[3] for x in a + b if x[0] == bundle)
        for k in range(max(0, math.ceil(extent / step))):
            want[(bundle, label(a, bundle, (k + 0.5) * step), label(b, bundle, (k + 0.5) * step))] += 1
    for slice_rows in SLICES:
        got = Counter()
        for r in sweep.frame_pairs(spark.createDataFrame(a, INTERVAL), spark.createDataFrame(b, INTERVAL), step, slice_rows).collect():
            got[(r.bundle_id, r.a, r.b)] += r.n
        assert got == want


def test_frames_on_the_edges_of_intervals(spark):
    """Centres that lie on a start belong to the interval, those on an end do not."""
    rows = [(1, 1, 0.015, 0.035, "a"), (1, 2, 0.035, 0.055, "b"), (2, 1, -3.0, -1.0, "a")]
    got = Counter()
    for r in sweep.frame_pairs(spark.createDataFrame(rows, INTERVAL), spark.createDataFrame([], INTERVAL), 0.01).collect():
        got[(r.bundle_id, r.a, r.b)] += r.n
    assert got == {(1, "∅", "∅"): 2, (1, "a", "∅"): 2, (1, "b", "∅"): 2}


def test_reductions_of_samples_in_intervals(spark):
    r = random.Random(8)
    rows = intervals(8, 60, 20.0)
    rows += [(1, 900, 100.0, 101.0, "empty"), (7, 901, 0.0, 1.0, "no samples"), (2, 902, None, 3.0, "null"), (2, 903, 3.0, None, "null"), (2, 904, 5.0, 5.0, "instant")]
    samples = [(r.choice([1, 2, 2, 2, 3]), float(r.choice([r.uniform(0, 60), r.randint(0, 60)])), float(r.choice([r.randint(0, 5), r.gauss(0, 1)]))) for _ in range(300)] + [(2, 5.0, 1.0), (2, 5.0, float("nan")), (2, 30.0, None), (3, 7.0, float("nan"))]
    wanted = [(x, x) for x in sweep.REDUCERS] + [("pairs", "samples")]

    def reduced(row):
        own = sorted(((t, v) for b, t, v in samples if v is not None and b == row[0] and row[2] is not None and row[3] is not None and row[2] <= t <= row[3]), key=lambda s: (s[0], math.isnan(s[1]), s[1]))
        if not own:
            return [None] * 9
        v = [x for _, x in own]
        real = [(x, t) for t, x in own if not math.isnan(x)]
        ranked = sorted(v, key=lambda x: (math.isnan(x), x))
        top, low = (max(x for x, _ in real), min(x for x, _ in real)) if real else (None, None)
        return [np.mean(v), top, low, top - low if real else None, (ranked[(len(v) - 1) // 2] + ranked[len(v) // 2]) / 2, np.std(v), min(t for x, t in real if x == top) if real else None, min(t for x, t in real if x == low) if real else None, own]

    for slice_rows in SLICES:
        got = sweep.reduced_in(spark.createDataFrame(rows, INTERVAL), spark.createDataFrame(samples, "bundle_id long, t double, v double"), wanted, slice_rows).collect()
        assert len(got) == len(rows)
        for x in got:
            want = reduced(next(y for y in rows if y[1] == x["id"] and y[0] == x["bundle_id"]))
            for (name, _), value in zip(wanted, want, strict=True):
                if name == "pairs":
                    assert value is None and x[name] is None or np.array_equal(np.array([tuple(p) for p in x[name]]), np.array(value), equal_nan=True)
                else:
                    assert x[name] is None if value is None else x[name] == pytest.approx(value, abs=1e-9, nan_ok=True), (name, x["id"])


def test_reductions_in_small_parts(spark, monkeypatch):
    monkeypatch.setattr(sweep, "GATHERED", 7)
    s = sweep.Sweep([("n", "mean"), ("x", "max")])
    import pyarrow as pa

    start, end = np.arange(20.0), np.arange(20.0) + np.arange(20) % 5
    s.add(pa.RecordBatch.from_arrays([pa.array(np.arange(20))], ["id"]), start, end, np.arange(0, 20, 0.5), np.arange(40.0))
    got = {r["id"]: (r["n"], r["x"]) for b in s.close(math.inf) for r in b.to_pylist()}
    assert got == {i: (np.mean(v := np.arange(2 * i, min(2 * (i + i % 5), 39) + 1)), v.max()) for i in range(20)}


def test_kappa_from_margins(spark):
    r = random.Random(1)
    pairs = [(k, r.choice("abc"), r.choice(["a", "b", None])) for k in (1, 2, 3) for _ in range(40)] + [(4, "a", "a")] * 3 + [(5, "a", "b")]
    got = {x.k: x for x in agreement.cohen_kappa(spark.createDataFrame(pairs, "k long, a string, b string"), ["k"]).collect()}
    for k, x in got.items():
        own = [(a, b) for q, a, b in pairs if q == k]
        po = sum(a == b for a, b in own) / len(own)
        pe = sum(sum(a == label for a, _ in own) * sum(b == label for _, b in own) for label in {y for p in own for y in p}) / len(own) ** 2
        assert (x.n, x.percent_agreement) == (len(own), pytest.approx(po))
        assert x.kappa == pytest.approx(1.0 if pe == 1 else (po - pe) / (1 - pe))
    weighted = spark.createDataFrame(pairs, "k long, a string, b string").groupBy("k", "a", "b").agg(F.count("*").alias("w"))
    assert {x.k: (x.n, pytest.approx(x.kappa)) for x in agreement.cohen_kappa(weighted, ["k"], weight="w").collect()} == {k: (x.n, x.kappa) for k, x in got.items()}


@pytest.mark.parametrize("scope", ["", ", file"])
def test_crossings_of_numbers_and_of_expressions_agree(spark, scope):
    """A plain number is found in the sweep, any other threshold in an array of samples."""
    from sonospan.plans import expr, rules

    r = random.Random(2)
    samples = [(b, "x", float(t), float(r.choice([r.randint(-3, 3), r.gauss(0, 2)]))) for b in (1, 2) for t in range(60)] + [(1, "x", 7.0, None)]
    spans = [(b, i, float(s), float(s + r.randint(0, 20))) for i, (b, s) in enumerate((r.choice([1, 2, 3]), r.randint(0, 60)) for _ in range(25))]
    for which in ("first", "last"):
        for direction in ("", ", rising", ", falling"):
            plain, other = (expr.parse(f"{which}_crossing(x, {threshold}{scope}{direction})") for threshold in ("-1", "0 - 1"))
            wanted = [*expr.reductions(plain), *expr.reductions(other)]
            made = rules.reduced(spark.createDataFrame(spans, "bundle_id long, id long, start double, end double"), spark.createDataFrame(samples, "bundle_id long, signal string, t double, v double"), wanted)
            found = rules.values(wanted, F.col("start"), F.col("end"))
            got = made.select(*[expr.column(n, found, F.col("start"), F.col("end")).alias(c) for c, n in (("a", plain), ("b", other))]).collect()
            assert len(got) == 25 and any(x.a is not None for x in got)
            assert [x.a for x in got] == pytest.approx([x.b for x in got])

"""The corpus engine: expressions, rules, agreement, formats, kernels, streaming and the store."""

import math
import os
from datetime import datetime, timedelta

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sonospan import queries
from sonospan.functions import align, clinical, columns, dsp, swipe
from sonospan.operators import agreement, campaign, intervals, refdist
from sonospan.plans import expr, rules
from sonospan.sources import formats, readers
from sonospan.store import Corpus, StoreError
from sonospan.streaming import live

SMALL = "/root/testdata/sf0.001"
TIER = "bundle_id long, tier string, id long, start double, end double, label string"
SIDE = "bundle_id long, id long, start double, end double, label string"


def rows_of(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)


def evaluated(spark, source, t=(0.0, 1.0, 2.0, 3.0), v=(10.0, 20.0, 30.0, 40.0), context=(1.0, 2.0)):
    node = expr.parse(source)
    tier = spark.createDataFrame([(1, 1, *context)], "bundle_id long, id long, start double, end double")
    signal = spark.createDataFrame([(1, "x", a, b) for a, b in zip(t, v, strict=True)], "bundle_id long, signal string, t double, v double")
    wanted = expr.reductions(node)
    made = rules.reduced(tier, signal, wanted)
    return made.select(expr.column(node, rules.values(wanted, F.col("start"), F.col("end")), F.col("start"), F.col("end"))).first()[0]


def test_random_assignment_of_bundles_as_lists(spark):
    rows = [(b, 10 * b + k, float(-k), "done" if k == 4 else "unassigned") for b in (1, 2, 3) for k in range(b + 2)]
    made = campaign.assign_randomly(spark.createDataFrame(rows, "bundle_id long, id long, start double, status string"), ["x", "y"], 7)
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().optimizedPlan().toString()  # no pandas call a bundle
    want = set()
    for b in (1, 2, 3):
        ids = [i for _, i in sorted((t, i) for c, i, t, status in rows if c == b and status == "unassigned")]
        want |= {(b, i, "xy"[k % 2]) for k, i in enumerate(campaign.shuffled(ids, 7))}
    assert set(map(tuple, made.collect())) == want


def test_whole_spans_keep_their_ends(spark):
    start, end = 3723.015834, 21003.701843
    assert start + 1.0 * (end - start) != end
    tiers = spark.createDataFrame([(1, "phones", 1, start, end, "a")], "bundle_id long, tier string, id long, start double, end double, label string")
    for emit in ({"kind": "span"}, {"kind": "span", "from": 0, "to": 2}):
        assert tuple(rules.evaluate(rules.Rule.from_json({"select": {"tier": "phones"}, "emit": emit}), tiers).first()) == (1, 1, start, end, "a")


def test_a_mean_that_equals_its_bound_is_not_above_it(spark):
    tiers = spark.createDataFrame([(b, "phones", 1, 0.5, 1.5, "a") for b in (1, 2)], "bundle_id long, tier string, id long, start double, end double, label string")
    rule = rules.Rule.from_json({"select": {"tier": "phones"}, "where": "mean(x) > mean(x, file)", "emit": {"kind": "span"}})
    values = {1: [0.1] * 10, 2: [0.3, 0.2, 0.1, 0.2, 0.2]}
    for each in (lambda v: v, lambda v: v[::-1]):
        points = spark.createDataFrame([(b, "x", float(t), x) for b, v in values.items() for t, x in enumerate(each(v))], "bundle_id long, signal string, t double, v double").coalesce(1)
        made = {r.bundle_id: r.m for r in points.groupBy("bundle_id").agg(rules.mean(F.col("v")).alias("m")).collect()}
        assert made == {1: 0.1, 2: 0.2}
        assert rules.evaluate(rule, tiers, points).count() == 0
    odd = {1: [1e-30, 3e-30], 2: [1e300, 3e300], 3: [1.0, math.nan], 4: [None, 2.0], 5: [None]}
    points = spark.createDataFrame([(b, x) for b, v in odd.items() for x in v], "bundle_id long, v double")
    made = {r.bundle_id: r.m for r in points.groupBy("bundle_id").agg(rules.mean(F.col("v")).alias("m")).collect()}
    assert math.isnan(made.pop(3)) and made == {1: pytest.approx(2e-30, rel=1e-12), 2: 2e300, 4: 2.0, 5: None}


def test_reductions(spark):
    made = {s: evaluated(spark, s) for s in ("mean(x)", "max(x)", "min(x)", "range(x)", "argmax(x)", "argmin(x)", "mean(x, file)", "max(x, file)", "median(x)", "std(x)")}
    assert made == {"mean(x)": 25, "max(x)": 30, "min(x)": 20, "range(x)": 10, "argmax(x)": 2.0, "argmin(x)": 1.0, "mean(x, file)": 25, "max(x, file)": 40, "median(x)": 25, "std(x)": 5}


@pytest.mark.parametrize(("source", "want"), [("first_crossing(x, 15, file, rising)", 0.5), ("first_crossing(x, 15, file, falling)", 2.5), ("first_crossing(x, 100, file, rising)", None), ("last_crossing(x, 15, file)", 2.5)])
def test_crossings(spark, source, want):
    assert evaluated(spark, source, v=(10.0, 20.0, 20.0, 10.0)) == want


@pytest.mark.parametrize("source", ["mean(x)", "mean(x) + 1", "mean(x) > 0", "mean(x) > 0 or true", "not (mean(x) > 0 and false)", "1 / 0", "1 / 0 > 2 and false"])
def test_undefined_goes_through(spark, source):
    assert evaluated(spark, source, t=(0.0, 5.0), v=(1.0, 2.0)) is None


@pytest.mark.parametrize(("source", "want"), [("1 + 2 * 3", 7), ("-(2 - 5) / 2", 1.5), ("start + 30%", 1.3), ("20ms", 0.02), ("duration == 1", True), ("not (1 < 2) or 2 >= 2", True)])
def test_arithmetic(spark, source, want):
    assert evaluated(spark, source) == pytest.approx(want)


@pytest.mark.parametrize("source", ["1 +", "mean(", "bogus(x)", "1 = 2", "(1 + 2", "mean(f0 over interval)", "true + 1", "1 and 2", "nope", "1 < 2 < 3", "not 1"])
def test_what_does_not_parse(source):
    with pytest.raises(expr.ExpressionError):
        expr.parse(source)


PHONES = [(1, "phones", 1, 0.0, 0.1, "a"), (1, "phones", 2, 0.1, 0.2, "b"), (1, "phones", 3, 0.5, 0.6, "a"), (1, "words", 4, 0.0, 0.2, "w"), (1, "phones", 5, 0.7, 0.8, None)]


def test_rules(spark):
    tiers = spark.createDataFrame(PHONES, TIER)
    run = lambda body: rows_of(rules.evaluate(rules.Rule.from_json(body), tiers).select("id", "start", "end", "label"))
    assert [r[0] for r in run({"select": {"tier": "phones", "label_any": ["a"]}, "emit": {"kind": "point", "at": 0.5}})] == [1, 3]
    assert [r[0] for r in run({"select": {"tier": "phones"}, "within": {"tier": "words"}, "emit": {"kind": "span"}})] == [1, 2]
    assert [r[0] for r in run({"select": {"tier": "phones"}, "overlaps": {"tier": "none"}, "emit": {"kind": "span"}})] == []
    assert run({"select": {"tier": "phones", "label_regex": "^$"}, "emit": {"kind": "span", "from": -1, "to": 0.5}, "label": "z"}) == [(5, 0.7, 0.75, "z")]
    assert run({"select": {"tier": "words"}, "emit": {"kind": "span_expr", "from": "end", "to": "start"}}) == []


@pytest.mark.parametrize("bucket", [None, 0.05, 10.0])
def test_range_joins_do_not_depend_on_buckets(spark, bucket):
    r = np.random.default_rng(1)
    make = lambda n: [(int(b), i, float(s), float(s + d), "x") for i, (b, s, d) in enumerate(zip(r.integers(0, 3, n), r.random(n), r.random(n) / 4, strict=True))]
    a, b = make(60), make(50)
    x, y = spark.createDataFrame(a, SIDE), spark.createDataFrame(b, SIDE)
    want = sorted(p[1] for p in a if any(q[0] == p[0] and p[2] < q[3] and q[2] < p[3] for q in b))
    assert sorted(q.id for q in intervals.overlapping(x, y, bucket).collect()) == want


A = [(1, 1, 0.0, 0.1, "a"), (1, 2, 0.1, 0.2, "b"), (1, 3, 0.2, 0.3, "a")]


def test_agreement(spark):
    a = spark.createDataFrame(A, SIDE)
    same = agreement.compare_intervals(a, a).first()
    assert (same.n_matched, same.percent_label_agreement, same.cohen_kappa, same.mean_abs_diff, same.frame_kappa) == (3, 1, 1, 0, 1)
    other = agreement.compare_intervals(a, spark.createDataFrame([*A[:2], (1, 3, 0.2, 0.3, "c")], SIDE)).first()
    assert other.n_matched == 3 and other.percent_label_agreement == pytest.approx(2 / 3) and other.cohen_kappa < 1 and other.mean_abs_diff == 0
    assert agreement.compare_intervals(spark.createDataFrame([], SIDE), spark.createDataFrame([], SIDE)).collect() == []


def test_point_matching_is_greedy(spark):
    schema = "bundle_id long, id long, t double, label string"
    for seed in range(4):
        r = np.random.default_rng(seed)
        a, b = ([(1, i, float(t), "x") for i, t in enumerate(r.integers(0, 20, n))] for n in (15, 12))
        x, y = (sorted(s, key=lambda p: (p[2], p[1])) for s in (a, b))
        want, ua, ub = [], set(), set()
        for _, i, j in sorted((abs(p[2] - q[2]), i, j) for i, p in enumerate(x) for j, q in enumerate(y)):
            if i not in ua and j not in ub:
                ua.add(i)
                ub.add(j)
                want.append((x[i][1], y[j][1]))
        got = agreement.match_points(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()
        assert sorted((g.a_id, g.b_id) for g in got) == sorted(want)


def test_summaries(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 6)], "v double")
    s = refdist.summary(df, "v").first()
    assert (s.median, s.p25, s.n, s.sd) == (3, 2, 5, pytest.approx(math.sqrt(2.5)))
    assert refdist.summary(df.limit(1), "v").first().sd == 0 and refdist.summary(df.limit(0), "v").collect() == []
    h = refdist.histogram(spark.createDataFrame([(float(i),) for i in range(5)], "v double"), "v", 4).orderBy("bin").collect()
    assert [x.n for x in h] == [1, 1, 1, 2]
    h = refdist.histogram(spark.createDataFrame([(2.0,)] * 3, "v double"), "v", 4).collect()
    assert len(h) == 1 and h[0].n == 3 and h[0].high - h[0].low == 1
    with pytest.raises(Exception, match="null in v"):
        spark.createDataFrame([(None,)], "v double").select(refdist.column_double(df, "v")).collect()


def test_gaps_and_overlaps(spark):
    t = spark.createDataFrame([(1, 1, 0.5, 1.0, "a"), (1, 2, 1.0, 2.0, "b"), (1, 3, 3.0, 4.0, None)], SIDE)
    assert [(r.start, r.end, r.label) for r in intervals.fill_gaps(t).orderBy("start").collect()] == [(0, 0.5, ""), (0.5, 1, "a"), (1, 2, "b"), (2, 3, ""), (3, 4, "")]
    with pytest.raises(Exception, match="overlapping"):
        intervals.fill_gaps(spark.createDataFrame([(1, 1, 0.0, 2.0, "a"), (1, 2, 1.0, 3.0, "b")], SIDE)).collect()
    many = spark.createDataFrame([(1, i, float(i % 4), float(i % 4 + 1 + i % 3), "x") for i in range(12)], SIDE)
    rows = many.collect()
    want = sum(min(a.end, b.end) - max(a.start, b.start) > 1e-9 for i, a in enumerate(rows) for b in rows[:i])
    assert intervals.overlap_pairs(many, ["bundle_id"]).first().n_overlaps == want


def test_seeded_shuffle_is_a_permutation():
    a = campaign.shuffled(list(range(100)), 42)
    assert sorted(a) == list(range(100)) and a == campaign.shuffled(list(range(100)), 42) != campaign.shuffled(list(range(100)), 43)


def test_labels_and_names(spark):
    df = spark.createDataFrame([("a", None), ("b", '{"k": 1}'), ("x {json:1} y", "2")], "label string, extra string")
    back = df.select("label", "extra", columns.decode_label(columns.encode_label(F.col("label"), F.col("extra"))).alias("d")).collect()
    assert all((r.d.label, r.d.extra) == (r.label, r.extra) == formats.decode_label(formats.encode_label(r.label, r.extra)) for r in back)


def test_textgrid_round_trip(spark, tmp_path):
    tiers = [("phones", "interval", [(0.1, 0.2, 'say "hi"'), (0.2, 0.5, "[b] 2")]), ("marks", "point", [(0.25, 0.25, "p")])]
    text = formats.write_textgrid(tiers, 1.0)
    (tmp_path / "a.TextGrid").write_text(text)
    got = [(r["tier"], r["start"], r["end"], r["label"]) for r in formats.parse_textgrid(text)]
    assert got == [("phones", 0.0, 0.1, ""), ("phones", 0.1, 0.2, 'say "hi"'), ("phones", 0.2, 0.5, "[b] 2"), ("marks", 0.25, 0.25, "p")]
    assert readers.read_textgrid(spark, str(tmp_path)).count() == 4
    short = 'File type = "ooTextFile"\nObject class = "TextGrid"\n\n0\n1\n<exists>\n1\n"TextTier"\n"m"\n0\n1\n1\n0.5\n"x"\n'
    assert [(r["start"], r["label"]) for r in formats.parse_textgrid(short)] == [(0.5, "x")]
    with pytest.raises(ValueError, match="overlapping"):
        formats.write_textgrid([("t", "interval", [(0.0, 1.0, "a"), (0.5, 2.0, "b")])], 2.0)


def test_eaf_round_trip(spark, tmp_path):
    text = formats.write_eaf([("words", None, [(0.0, 0.5, "w")]), ("points", "words", [(0.25, 0.25, "p")])])
    (tmp_path / "a.eaf").write_text(text)
    got = {(r.tier, r.kind, r.start, r.end, r.label) for r in readers.read_eaf(spark, str(tmp_path)).collect()}
    assert got == {("words", "interval", 0.0, 0.5, "w"), ("points", "point", 0.25, 0.251, "p")}


def test_audio_files(spark, tmp_path):
    x = np.sin(np.arange(4000) / 7) * 0.5
    (tmp_path / "a.wav").write_bytes(formats.encode_wav(np.repeat(x, 2), 8000, 2))
    probe = readers.probe_wav(spark, str(tmp_path)).first()
    assert (probe.sample_rate, probe.channels, probe.n_frames, probe.duration_seconds) == (8000, 2, 4000, 0.5)
    audio = readers.to_mono(readers.read_wav(spark, str(tmp_path)))
    assert np.abs(np.array(audio.first().samples) - x).max() < 1e-4
    assert [len(r.samples) for r in readers.split_chunks(audio, 0.2).orderBy("chunk").collect()] == [1600, 1600, 800]


def test_tables_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, "phones", "interval", 0.0, 0.5, 'a "q"\nb'), (1, "phones", "interval", 0.5, 0.9, None)], "bundle_id long, tier_name string, tier_type string, start_seconds double, end_seconds double, label string")
    readers.write_annotations_csv(rows, str(tmp_path / "csv"))
    assert rows_of(readers.read_annotations_csv(spark, str(tmp_path / "csv")).select(*rows.columns)) == rows_of(rows)
    samples = spark.createDataFrame([(i, float(i)) for i in range(50)], "i long, value double").repartition(4)
    readers.write_dense(samples, str(tmp_path / "dense"))
    assert [r.t for r in readers.read_dense(spark, str(tmp_path / "dense"), 10.0).orderBy("i").collect()] == [i / 10 for i in range(50)]
    with pytest.raises(Exception, match="exist"):
        readers.write_dense(samples, str(tmp_path / "dense"))


def harmonic(f0, rate=16_000, seconds=0.6):
    t = np.arange(int(rate * seconds)) / rate
    return sum(np.sin(2 * np.pi * f0 * k * t) / k for k in range(1, 16)) * 0.1


@pytest.mark.parametrize("method", dsp.PITCH)
def test_pitch(method):
    for f0 in (110.0, 220.0):
        p = dsp.pitch(harmonic(f0), 16_000, method)
        good = p["hz"][p["voicing"] > 0.45] if method not in ("pyin", "swipe") else p["hz"][p["voicing"] > 0.3] if method == "swipe" else p["hz"]
        assert abs(np.median(good) / f0 - 1) < 0.02


def test_mfcc_of_closed_form_tones():
    t = np.arange(8000) / 16_000
    x = sum(a * np.sin(2 * np.pi * f * t) for f, a in ((220, 0.5), (1700, 0.3), (3500, 0.1)))
    c = dsp.mfcc(x, 16_000)
    assert c.shape == (51, 13) and np.isfinite(c).all() and dsp.mfcc(x, 16_000, method="kaldi").shape == (48, 13) and dsp.mfcc(x, 16_000, n_mfcc=14, method="praat").shape == (46, 14)
    m = dsp.log_mel_whisper(x, 16_000)
    assert m.max() - m.min() <= 2 + 1e-9


def test_prediction_and_formants():
    r = np.random.default_rng(0)
    x = r.normal(size=4000)
    y = np.zeros(4000)
    for i in range(2, 4000):  # one resonance at 1 kHz
        y[i] = x[i] + 2 * 0.98 * np.cos(2 * np.pi * 1000 / 8000) * y[i - 1] - 0.98**2 * y[i - 2]
    for method in (dsp.lpc_burg, dsp.lpc_autocorrelation):
        a = method(y[None], 2)[0]
        assert a[1] == pytest.approx(-2 * 0.98 * np.cos(2 * np.pi / 8), abs=0.05) and a[2] == pytest.approx(0.96, abs=0.05)
    f = dsp.formants(y, 8000, 1, pre=0.0)["frequencies"]
    assert abs(np.median([v[0] for v in f if v]) - 1000) < 60


def test_windows_and_levels():
    for n in (0, 1, 2, 33):
        for w in (columns.hann(n), columns.hamming(n), columns.blackman(n), columns.gaussian(n, 5.0), columns.kaiser(n, 6.0)):
            assert len(w) == n
    assert np.allclose(columns.kaiser(21, 8.0), np.kaiser(21, 8.0)) and np.allclose(columns.hann(16), np.hanning(16))
    level = dsp.intensity(np.zeros(1000), 1000)
    assert (level["db"] == -200).all()
    assert np.allclose(dsp.resample(harmonic(200), 16_000, 8_000)[100:-100], harmonic(200, 8_000)[100:-100], atol=0.02)


def test_voice_measures():
    m = {k: v[0] for k, v in clinical.measures(harmonic(150, 22_050, 1.0), 22_050).items()}
    assert m["jitter_local"] < 0.01 and m["shimmer_local"] < 0.02 and m["hnr_db"] > 20 and abs(m["f0"] - 150) < 2 and abs(m["h1_h2_db"] - 6) < 1.5
    noise = {k: v[0] for k, v in clinical.measures(np.random.default_rng(1).normal(0, 0.1, 22_050), 22_050).items()}
    assert not noise["hnr_db"] > 10
    assert math.isnan(clinical.measures(np.zeros(100), 16_000)["jitter_local"][0])


def test_alignment():
    assert align.syllabify(list("katapult")) == [(0, 2), (2, 4), (4, 8)] and align.syllabify([]) == [] and align.syllabify(list("st")) == [(0, 2)]
    assert align.tokenize("tʃa", {"t": 1, "tʃ": 2, "a": 3}) == [2, 3]
    with pytest.raises(ValueError, match="x"):
        align.tokenize("ax", {"a": 1})
    e = np.full((6, 3), -5.0)
    e[[0, 1], 1] = e[[2, 3], 0] = e[[4, 5], 2] = -0.01
    assert [s[:3] for s in align.forced_align(e, [1, 2])] == [(1, 0, 4), (2, 4, 6)]
    with pytest.raises(ValueError, match="frames"):
        align.forced_align(e[:2], [1, 1])
    assert [(s.label, s.first, s.end, s.token) for s in align.forced_align(e, [1, 2], min_silence_frames=2)] == [(1, 0, 2, 0), (0, 2, 4, -1), (2, 4, 6, 1)]
    assert [(s.first, s.end, s.token) for s in align.forced_align(e, [1, 2], silence_mask=[True] + [False] * 5)] == [(0, 1, -1), (1, 4, 0), (4, 6, 1)]
    with pytest.raises(ValueError, match="mask"):
        align.forced_align(e, [1, 2], silence_mask=[True])
    with pytest.raises(ValueError, match="range"):
        align.forced_align(e, [1, 3])


def emissions(rows, n):
    return np.array([[np.log(0.8 if c == hot else 0.2 / (n - 1)) for c in range(n)] for hot in rows])


def test_tiers_of_a_transcript(spark):
    ids = {"h": 1, "ə": 2, "l": 3, "o": 4, "ʊ": 5}
    rows = align.align_transcript(emissions([1] * 3 + [2] * 3 + [3] * 3 + [4] * 3 + [5] * 3, 6), [("hello", "həloʊ")], ids, frame_rate=100.0)
    assert [r[3] for r in rows if r[0] == "phones"] == list("həloʊ") and [r[3] for r in rows if r[0] == "words"] == ["hello"]
    assert [(round(r[1], 9), r[3]) for r in rows if r[0] == "syllables"] == [(0.0, "hə"), (0.06, "loʊ")]
    e = emissions([0, 0, 0, 1, 1, 2, 2, 0, 0, 0], 3)
    utterances = spark.createDataFrame([(7, e.tolist(), [("ba", "ba")])], "bundle_id long, emissions array<array<double>>, words array<struct<text: string, ipa: string>>")
    got = align.aligned(utterances, {"b": 1, "a": 2}, frame_rate=100.0, min_silence_frames=2).collect()
    assert [r.label for r in got if r.tier == "phones"] == ["", "b", "a", ""] and [r.label for r in got if r.tier == "words"] == ["", "ba", ""] and {r.bundle_id for r in got} == {7}
    with pytest.raises(ValueError, match="x"):
        align.align_transcript(e, [("x", "x")], {"b": 1})
    with pytest.raises(ValueError, match="no phones"):
        align.align_transcript(e, [("", "")], {"b": 1})


def test_swipe_splines_and_published_medians():
    x = np.arange(9.0)
    assert np.allclose(swipe.spline((x**3 - 2 * x)[:, None], 1.0, np.array([0.3, 4.5, 7.9]))[:, 0], [v**3 - 2 * v for v in (0.3, 4.5, 7.9)])
    assert swipe.primes(20).tolist() == [2, 3, 5, 7, 11, 13, 17, 19] and swipe.primes(0).tolist() == []
    t = np.arange(8000) / 16_000
    for f0, median in ((150, 150.101407), (220, 220.0789), (330, 330.341525)):  # medians of the authors' own program
        tone = sum(np.sin(2 * np.pi * h * f0 * t) / h for h in range(1, 11))
        p = swipe.pitch_swipe(tone / np.abs(tone).max(), 16_000, 100.0, 600.0)
        assert abs(np.median(p["hz"][p["voicing"] >= 0.3]) - median) < 0.05
    assert len(swipe.pitch_swipe(np.zeros(0), 16_000)["t"]) == 0 and not swipe.pitch_swipe(np.zeros(4000), 16_000)["voicing"].any()


@pytest.mark.parametrize("size", [160, 700, 5000])
def test_live_frames_do_not_depend_on_chunks(spark, tmp_path, size):
    x = harmonic(150, 8_000).astype("f4")
    rows = [("s", i, 8_000, x[i : i + size].tolist(), datetime(2024, 1, 1) + timedelta(seconds=i / 8_000), False) for i in range(0, len(x), size)]
    for k, part in enumerate((rows[1::2], rows[::2])):  # the second file brings what the first one lacks
        if part:
            spark.createDataFrame(part, live.CHUNK).coalesce(1).write.parquet(str(tmp_path / "in" / f"part{k}"))
    source = spark.readStream.schema(live.CHUNK).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = []
    live.start(live.hop_frames(source), lambda df, _: got.extend(df.collect()), str(tmp_path / "ck")).awaitTermination()
    want = live.frames_of(x.astype(float), 0, 8_000, 75.0, 500.0)
    assert np.allclose(sorted(r.t for r in got), want["t"]) and np.allclose([r.rms for r in sorted(got, key=lambda r: r.t)], want["rms"], atol=1e-6)
    assert all(np.allclose(r.frequencies, f) for r, f in zip(sorted(got, key=lambda r: r.t), want["frequencies"], strict=True))
    assert live.meter(spark.createDataFrame(rows, live.CHUNK)).agg(F.sum("n")).first()[0] == len(x)


def test_large_tables_are_not_broadcast(spark, tmp_path, monkeypatch):
    from sonospan import store

    monkeypatch.setattr(store, "LARGE_ROWS", 3, raising=False)
    monkeypatch.setattr(store, "LARGE_BYTES", 1, raising=False)
    c = Corpus(spark, str(tmp_path))
    c.add("bundle", [{"name": "b", "audio_relative_path": "b.wav", "sample_rate": 1, "channels": 1, "n_frames": 1}])
    few = c.append("target", spark.range(9).selectExpr("1L as bundle_id", "0d as start_seconds", "1d as end_seconds", "'x' as label", "'unassigned' as status"))
    c.append("assignment", c.table("target").filter("id % 2 = 0").selectExpr("id as target_id", "'ann' as annotator", "'assigned' as status"))
    c.update("target", F.col("id") > 6, {"note": F.lit("n")})
    c.delete("assignment", F.col("target_id") == 8)
    rows = c.table("target").join(c.assignments().select(F.col("target_id").alias("id"), "annotator"), "id", "left")
    want = {k: ("n" if k > 6 else None, "assigned" if k in (2, 4, 6) else "unassigned", "ann" if k in (2, 4, 6) else None) for k in range(1, 10)}
    assert {r.id: (r.note, r.status, r.annotator) for r in rows.collect()} == want
    for plan in (rows, c.violations("target", few), c.violations("assignment", c.staged(c.table("assignment")))):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        joins = [x for x in text.splitlines() if "Join " in x and "_part" not in x]
        assert joins and all("strategy=merge" in x for x in joins), text


def test_store(spark, tmp_path):
    c = Corpus(spark, str(tmp_path), "ann", lambda: "2024-01-01T00:00:00.000Z")
    b = c.add("bundle", [{"name": "one", "audio_relative_path": "a.wav"}])[0]
    t = c.add("tier", [{"bundle_id": b, "name": "phones", "type": "interval"}])[0]
    c.add("annotation_interval", [{"tier_id": t, "start_seconds": 1.0, "end_seconds": 2.0, "label": "b"}, {"tier_id": t, "start_seconds": 0.0, "end_seconds": 1.0, "label": "a"}])
    assert [r.label for r in c.query(t).collect()] == ["a", "b"]
    for name, bad in (("annotation_interval", {"tier_id": t, "start_seconds": 2.0, "end_seconds": 2.0}), ("tier", {"bundle_id": b, "name": "phones", "type": "interval"}), ("tier", {"bundle_id": 99, "name": "x", "type": "interval"}), ("tier", {"bundle_id": b, "name": "x", "type": "bogus"}), ("annotation_point", {"tier_id": t, "time_seconds": 1.0})):
        with pytest.raises(StoreError):
            c.add(name, [bad])
    assert c.set_proposals(b, "phones", spark.createDataFrame([(0.5, 0.5, "x")], "start double, end double, label string")) == 1
    target = c.add("target", [{"bundle_id": b, "start_seconds": 0.0, "end_seconds": 1.0, "status": "unassigned"}])[0]
    a = c.add("assignment", [{"target_id": target, "annotator": "ann"}])[0]
    assert c.table("target").first().status == "assigned"
    c.delete("assignment", F.col("id") == a)
    assert c.table("target").first().status == "unassigned"
    assert c.delete("bundle", F.col("id") == b) == 1
    assert all(c.table(n).isEmpty() for n in ("tier", "annotation_interval", "annotation_point", "target"))
    assert c.table("audit_log").filter("op = 'delete' and table_name = 'annotation_interval'").count() == 2
    assert c.add("bundle", [{"name": "two", "audio_relative_path": "b.wav"}])[0] > b


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from read_parquet('{SMALL}/{name}')")
    return con


def values(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    return sorted(tuple("" if not isinstance(x, (list, tuple)) and pd.isna(x) else round(x, 7) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_queries_equal_sql(spark, oracle, name):
    a, b = queries.QUERIES[name](spark, SMALL).toPandas(), oracle.execute(queries.ORACLES[name]).df()
    assert sorted(a.columns) == sorted(b.columns) and values(a) == values(b)


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n not in queries.ORACLES and not n.endswith("300s")])
def test_other_queries_run(spark, name):
    assert queries.QUERIES[name](spark, SMALL).count() > 0


def test_syllables_of_every_word(spark):
    from sonospan import audio_queries

    docs = spark.createDataFrame([(1, "Katapult 12 st, BANANA"), (2, None), (3, " 7 ")], "doc_id long, text string")
    got = sorted(map(tuple, audio_queries.syllables_of(docs).collect()))
    assert got == [(1, 0, 0, 0, 2, "ka"), (1, 0, 1, 2, 4, "ta"), (1, 0, 2, 4, 8, "pult"), (1, 1, 0, 0, 2, "st"), (1, 2, 0, 0, 2, "ba"), (1, 2, 1, 2, 4, "na"), (1, 2, 2, 4, 6, "na")]


def test_syllables_of_words_put_end_to_end():
    import random

    from sonospan.functions import align

    chance, known = random.Random(7), np.full(0x110000, -1, dtype=np.int8)
    for _ in range(200):
        words = ["".join(chance.choice("abeiounrstklmpwyéßøʌθʒ日ʰ") for _ in range(chance.randint(1, 9))) for _ in range(chance.randint(1, 8))]
        starts = np.cumsum([0, *map(len, words[:-1])])
        want = [int(at) + a for at, w in zip(starts, words, strict=True) for a, _ in align.syllabify(list(w))]
        assert align.syllable_cuts(np.array([ord(c) for w in words for c in w]), starts, known).tolist() == want

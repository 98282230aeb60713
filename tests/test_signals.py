"""Signals computed from stored audio on demand equal those of whole tracks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonospan import signals, workflow
from sonospan.functions import dsp
from sonospan.sources import formats
from sonospan.store import Corpus, StoreError

RATE = 8000


def tone(f0, seconds):
    t = np.arange(int(seconds * RATE)) / RATE
    return 0.3 * (1 + 0.5 * np.sin(5 * t)) * sum(np.sin(2 * np.pi * f0 * h * t) / h for h in range(1, 6)) / 2


@pytest.fixture
def corpus(spark, tmp_path):
    """A recording in one piece, one in three parts of which samples were lost, and one that no rule asks for."""
    c = Corpus(spark, str(tmp_path))
    waves = [tone(150, 3.0), tone(220, 2.0), tone(100, 1.0)]
    c.add("bundle", [{"name": f"b{k}", "audio_relative_path": f"{k}.wav", "sample_rate": RATE, "channels": 1, "n_frames": len(x)} for k, x in enumerate(waves)])
    waves[1][9000:9500] = 0
    parts = [(1, 0, waves[0]), (2, 0, waves[1][:4000]), (2, 4000, waves[1][4000:9000]), (2, 9500, waves[1][9500:])]
    c.commit([("audio", "insert", c.frame("audio", [{"id": k, "bundle_id": b, "content": formats.encode_wav(x, RATE), "first_frame": at} for k, (b, at, x) in enumerate(parts, 1)]))])
    return c, [formats.decode_wav(formats.encode_wav(x, RATE))[2].astype(float) for x in waves]


def test_levels_of_stretches_are_those_of_the_track(spark, corpus):
    c, waves = corpus
    rois = [(1, 0.4, 0.6), (1, 0.55, 0.9), (1, 2.0, 2.0), (2, 0.45, 0.55), (2, 1.05, 1.3), (2, 1.9, 9.0)]
    frame = spark.createDataFrame(rois, "bundle_id long, start double, end double")
    spans = c.as_of(c.versions()[-1])
    assert sum(r.n for r in signals.touched(spans, frame).collect()) < 0.7 * (len(waves[0]) + len(waves[1]))
    got = {(r.bundle_id, round(r.t, 9)): r.v for r in signals.computed(c, "intensity", frame, False).collect()}
    assert len(got) == signals.computed(c, "intensity", frame, False).count()  # no frame comes twice
    for b, start, end in rois:
        full = dsp.intensity(waves[b - 1], RATE, 0.025, 0.010)
        own = {round(t, 9): v for t, v in zip(full["t"], full["db"], strict=True) if start <= t <= end}
        assert {t for q, t in got if q == b and start <= t <= end} == set(own)
        assert all(got[b, t] == pytest.approx(v, abs=1e-4) for t, v in own.items())
    whole = signals.computed(c, "intensity", frame, True).groupBy("bundle_id").count().collect()
    assert {r.bundle_id: r["count"] for r in whole} == {b: len(dsp.intensity(waves[b - 1], RATE, 0.025, 0.010)["t"]) for b in (1, 2)}


def test_pitch_is_a_path_over_the_recording(spark, corpus):
    c, waves = corpus
    got = signals.computed(c, "f0", spark.createDataFrame([(1, 1.0, 1.1)], "bundle_id long, start double, end double"), False).collect()
    full = dsp.pitch(waves[0], RATE)
    assert [r.v for r in sorted(got, key=lambda r: r.t)] == pytest.approx(list(full["hz"][full["voicing"] >= 0.45]), abs=1e-6)


def test_recordings_are_encoded_as_arrays():
    import tracemalloc

    import pyarrow as pa

    x = np.linspace(-1, 1, 1_000_000)
    for kind, floats in (("float", True), ("double", True), ("double", False)):
        samples = pa.array([x.astype("f4" if kind == "float" else "f8")], pa.list_(pa.float32() if kind == "float" else pa.float64()))
        batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array([8000], pa.int32()), pa.array([1], pa.int32()), samples], ["name", "sample_rate", "channels", "samples"])
        tracemalloc.start()
        made = list(workflow.encoded(iter([batch]), floats))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 30 * len(x)
        assert made[0].column("content")[0].as_py() == formats.encode_wav(samples[0].values.to_numpy().astype(float), 8000, 1, floats)
        assert made[0].column("n_frames").to_pylist() == [len(x)]
    with pytest.raises(ValueError, match="no frames"):
        list(workflow.encoded(iter([batch.set_column(3, "samples", pa.array([None], samples.type))]), True))


def test_rules_name_them(spark, corpus):
    c, _ = corpus
    workflow.import_tiers(c, spark.createDataFrame([(1, "w", "interval", 0.5, 1.0, "x"), (2, "w", "interval", 0.1, 0.4, "y"), (2, "w", "interval", 1.13, 1.18, "lost")], "bundle_id long, tier string, kind string, start double, end double, label string"), "import")
    rule = {"select": {"tier": "w"}, "where": "mean(f0) > 200 and min(intensity) > -60", "emit": {"kind": "span"}}
    assert workflow.run_criterion(c, workflow.set_criterion(c, "high", rule, "hits")) == 1
    assert [r.label for r in c.timeline(["hits (auto)"]).collect()] == ["y"]
    assert workflow.generate_targets(c, 1) is None or c.table("target").count() == 1
    with pytest.raises(StoreError, match="no signal"):
        workflow.run_criterion(c, workflow.set_criterion(c, "odd", rule | {"where": "mean(loudness) > 1"}, "hits"))
    given = {"f0": spark.createDataFrame([(1, 0.7, 300.0)], "bundle_id long, t double, v double"), "intensity": spark.createDataFrame([(1, 0.7, 0.0)], "bundle_id long, t double, v double")}
    assert workflow.run_criterion(c, 1, given) == 1 and [r.label for r in c.timeline(["hits (auto)"]).collect()] == ["x"]


def test_recordings_kept_as_floats_are_those_that_came(spark, tmp_path):
    from sonospan import workflow

    c = Corpus(spark, str(tmp_path / "c"), "x")
    x = (np.random.default_rng(3).normal(0, 0.1, 500)).astype("<f4")
    workflow.add_recordings(c, spark.createDataFrame([("a", RATE, 1, x.tolist())], "name string, sample_rate int, channels int, samples array<float>"), floats=True)
    got = np.array(workflow.load_audio(c).first()["samples"], dtype="<f4")
    assert np.array_equal(got, x)

"""Live sessions and the recovery of the corpus: chunks in any order, lost ones, restarts, replayed epochs, writes that fail."""

import json
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from sonospan import workflow
from sonospan.store import Corpus, StoreError
from sonospan.streaming import live

BEGAN = datetime(2024, 1, 1)


def chunk(session, first, samples, at, last=False, rate=100):
    return (session, first, rate, [float(x) for x in samples], BEGAN + timedelta(seconds=at), last)


def taken(order, chunks, now=0, **how):
    return [(first, x.tolist(), lost) for first, x, lost in order.take([(f, due, np.array(x, dtype="<f4"), last) for f, due, x, last in chunks], now, **how)]


def test_chunks_come_in_order_once():
    order = live.Order()
    assert taken(order, [(0, 10, [1, 2], False), (4, 10, [5], False), (1, 10, [2, 3], False)]) == [(0, [1, 2, 3], 0)]
    order = live.Order(order.state())  # what waits is kept as arrays
    assert (order.next, [(f, x.tolist()) for f, _, x, _ in order.early]) == (3, [(4, [5])])
    assert taken(order, [(0, 10, [1, 2, 3], False)]) == [] and taken(order, [(2, 10, [3, 4], False)]) == [(3, [4, 5], 0)]


def test_a_gap_is_lost_when_it_is_due_or_too_much_waits():
    order = live.Order()
    assert taken(order, [(5, 10, [1], False), (9, 30, [2], False)], now=9) == []
    assert taken(order, [], now=10) == [(5, [1], 5)]
    assert taken(order, [(12, 50, [3], False)], now=11) == []
    assert taken(order, [], now=30) == [(9, [2], 3)]
    assert taken(order, [(20, 90, [4, 4], False), (30, 90, [5, 5, 5], False)], now=31, most_early=4) == [(12, [3], 2), (20, [4, 4], 7)]
    assert [f for f, *_ in order.early] == [30]


def test_an_end_closes_and_late_chunks_are_dropped():
    order = live.Order()
    assert taken(order, [(0, 10, [1], False), (3, 10, [], True)]) == [(0, [1], 0)] and not order.closed
    assert taken(order, [], now=10) == [(3, [], 2)] and order.closed
    assert taken(order, [(1, 10, [2], False)]) == []


def recorded(spark, tmp_path, parts, **how):
    c = Corpus(spark, str(tmp_path / "corpus"), "ann", lambda: "2024-01-01T00:00:00.000Z")
    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, live.CHUNK).write.parquet(str(tmp_path / "in" / f"part{k}"))
        source = spark.readStream.schema(live.CHUNK).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        live.record(c, source, "mic", **how).awaitTermination()
    return c


def heard(c):
    names = {r.id: (r.name, r.n_frames) for r in c.table("bundle").collect()}
    out = {}
    for r in workflow.load_audio(c).collect():
        out.setdefault(names[r.bundle_id], []).extend(zip(range(r.first_frame, r.first_frame + len(r.samples)), (round(x * 32768 / 32767, 4) for x in r.samples), strict=True))
    return {k: sorted(v) for k, v in out.items()}


def test_recordings_land_once_and_go_on_after_a_restart(spark, tmp_path):
    first = [chunk("a", 0, [0.1] * 4, 0), chunk("b", 4, [0.4], 1), chunk("a", 8, [0.3] * 2, 2), chunk("quiet", 0, [], 2)]
    second = [chunk("a", 4, [0.2] * 4, 3), chunk("a", 0, [0.9] * 4, 3), chunk("b", 9, [0.5], 100, True), chunk("a", 10, [], 100, True), chunk("quiet", 0, [], 100, True), chunk("clock", 0, [], 10_000)]
    c = recorded(spark, tmp_path, [first, second], idle_seconds=50_000.0)
    assert heard(c) == {("a", 10): [*((k, 0.1) for k in range(4)), *((k, 0.2) for k in range(4, 8)), (8, 0.3), (9, 0.3)], ("b", 10): [(4, 0.4), (9, 0.5)]}
    runs = {r.bundle_id: json.loads(r.parameters) for r in c.table("processing_run").collect()}
    names = {r.name: runs[r.id] for r in c.table("bundle").collect()}
    assert names["a"]["dropped_samples"] == 0 and names["b"] == {"sample_rate": 100, "channels": 1, "duration_s": 0.1, "dropped_samples": 8}
    assert {r.recording for r in c.table("recording_part").collect()} <= {"clock"}  # a session without samples leaves nothing
    before = c.versions()
    sink = live.Recorder(c, "mic")
    landed = [epoch for epoch in range(6) if c.has(f"mic:{epoch}:parts")]
    assert len(landed) > 1
    for epoch in landed:  # replayed epochs change nothing
        sink(spark.createDataFrame([("again", 100, 0, [0.5], 0, True)], live.PIECE), epoch)
    assert c.versions() == before
    sink(spark.createDataFrame([("a", 100, 0, [0.5], 0, True)], live.PIECE), 99)  # the name is taken
    assert c.table("bundle").count() == 2 and c.table("recording_part").filter("recording = 'a'").count() == 1
    with pytest.raises(StoreError, match="unique"):
        live.commit_recordings(c, spark.createDataFrame([("a",)], "recording string"))


def test_silence_ends_a_session(spark, tmp_path):
    c = recorded(spark, tmp_path, [[chunk("a", 0, [0.1], 0), chunk("a", 5, [0.2], 1), chunk("clock", 0, [0.0], 5_000)]], idle_seconds=100.0, gap_seconds=1000.0)
    assert heard(c) == {("a", 6): [(0, 0.1), (5, 0.2)]}


def test_sessions_of_one_group_keep_their_own_order_and_timers(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(live, "GROUPS", 1)
    c, query = Corpus(spark, str(tmp_path / "corpus")), None
    batches = [
        [chunk("quiet", 0, [0.1], 0), chunk("quiet", 5, [0.2], 1), chunk("busy", 2, [0.3, 0.4], 0, rate=200), chunk("clock", 0, [0.0], 5_000)],
        [chunk("busy", 0, [0.5, 0.6], 5_000, rate=200), chunk("busy", 4, [0.7], 5_001, True, rate=200), chunk("clock", 1, [0.0], 5_050)],
    ]
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, live.CHUNK).write.parquet(str(tmp_path / f"in/{k}"))
        source = spark.readStream.schema(live.CHUNK).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        query = live.record(c, source, "mic", idle_seconds=100.0, gap_seconds=10_000.0)
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # a group, not a row for each session
    made = {r["name"]: r["sample_rate"] for r in c.table("bundle").collect()}
    assert made == {"quiet": 100, "busy": 200} and heard(c)["quiet", 6] == [(0, 0.1), (5, 0.2)]


def test_rates_may_not_change(spark, tmp_path):
    with pytest.raises(Exception, match="changes its rate"):
        recorded(spark, tmp_path, [[chunk("a", 0, [0.1], 0), chunk("a", 1, [0.1], 0, rate=200)]])


def test_frames_that_lost_samples_touch_are_left_out(spark, tmp_path):
    x = np.sin(np.arange(600) / 3)
    rows = [chunk("s", i, x[i : i + 50], i / 1000, rate=1000) for i in range(0, 600, 50) if i != 250] + [chunk("clock", 0, [], 900, rate=1000)]
    spark.createDataFrame(rows, live.CHUNK).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(live.CHUNK).parquet(str(tmp_path / "in"))
    c = Corpus(spark, str(tmp_path / "corpus"))
    sink = live.FrameTable(c, "levels")
    live.start(live.hop_frames(source, idle_seconds=50_000.0), sink, str(tmp_path / "ck")).awaitTermination()
    want = live.frames_of(x.astype("<f4").astype(float), 0, 1000, 75.0, 500.0)
    begins = np.round((want["t"] - 0.015) * 1000)
    want = want[(begins + 30 <= 250) | (begins >= 300)]
    got = sorted((r.t, r.rms) for r in sink.read().collect())
    assert np.allclose([t for t, _ in got], want["t"]) and np.allclose([r for _, r in got], want["rms"])
    sink(spark.createDataFrame([], live.FRAME), 0)
    assert len(sink.read().collect()) < len(got) or not len(got)  # an epoch is written in its place


def test_commit_and_discard(spark, tmp_path):
    c = Corpus(spark, str(tmp_path))
    sink = live.Recorder(c, "mic")
    sink(spark.createDataFrame([("open", 100, 0, [0.5, 0.5], 0, False)], live.PIECE), 0)
    name = lambda x: spark.createDataFrame([(x,)], "recording string")
    for bad in ("open", "nothing"):
        with pytest.raises(StoreError, match="not ended"):
            live.commit_recordings(c, name(bad))
    sink.corpus.commit([("recording_part", "insert", c.frame("recording_part", [{"id": 50, "recording": "empty", "sample_rate": 100, "first_frame": 0, "n_frames": 0, "lost": 0, "closed": True}]))])
    with pytest.raises(StoreError, match="no audio"):
        live.commit_recordings(c, name("empty"))
    assert live.discard(c, "empty") == 1 and live.discard(c, "empty") == 0
    sink(spark.createDataFrame([("open", 100, 2, [], 0, True)], live.PIECE), 1)
    assert [(r.name, r.n_frames) for r in c.table("bundle").collect()] == [("open", 2)]


@pytest.mark.parametrize("step", range(4))
def test_a_write_that_fails_leaves_the_old_state_and_no_obstacle(spark, tmp_path, monkeypatch, step):
    c = Corpus(spark, str(tmp_path), "ann", lambda: "2024-01-01T00:00:00.000Z")
    b = c.add("bundle", [{"name": "one", "audio_relative_path": "a.wav"}])[0]
    tier = {"bundle_id": b, "name": "phones", "type": "interval"}
    calls, parquet, mark = [], DataFrameWriter.parquet, Corpus._mark

    def failing(self, path, *args, **how):
        if "_staged" not in path:
            calls.append(path)
            if len(calls) == step + 1:
                if step % 2:
                    parquet(self, path, *args, **how)  # the rows are there, and then the writer is lost
                raise OSError("lost")
        return parquet(self, path, *args, **how)

    monkeypatch.setattr(DataFrameWriter, "parquet", failing)
    if step > 1:
        monkeypatch.setattr(Corpus, "_mark", lambda self, n, marker: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError, match="lost"):
        c.add("tier", [tier])
    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    monkeypatch.setattr(Corpus, "_mark", mark)
    again = Corpus(spark, str(tmp_path), "ann")
    assert again.table("tier").isEmpty() and again.table("audit_log").count() == 1
    assert again.add("tier", [tier]) == [1] and again.table("tier").count() == 1
    assert again.table("audit_log").count() == 2  # no row of the failed change
    gone = again.swept()
    assert (step == 0 or any(g.startswith("tier/") for g in gone)) and again.table("tier").count() == 1 and again.table("audit_log").count() == 2


def test_a_second_writer_is_told(spark, tmp_path):
    one, two = Corpus(spark, str(tmp_path)), Corpus(spark, str(tmp_path))
    one.add("bundle", [{"name": "one", "audio_relative_path": "a.wav"}])
    with pytest.raises(StoreError, match="another writer"):
        two._mark(1, {"attempt": "x", "tables": {}})
    assert two.add("bundle", [{"name": "two", "audio_relative_path": "b.wav"}]) == [2]


def test_reads_at_a_version_and_tokens(spark, tmp_path):
    c = Corpus(spark, str(tmp_path))
    rows = c.frame("bundle", [{"id": 1, "name": "one", "audio_relative_path": "a.wav"}])
    for _ in range(2):
        c.commit([("bundle", "insert", rows)], token="stream:7")
    assert c.versions() == [1] and c.has("stream:7")
    c.update("bundle", F.col("id") == 1, {"name": F.lit("two")})
    c.compact("bundle")
    assert c.table("bundle").first().name == "two" and c.as_of(1).table("bundle").first().name == "one"
    with pytest.raises(StoreError, match="read only"):
        c.as_of(1).add("bundle", [{"name": "x", "audio_relative_path": "x.wav"}])


def test_windows_are_measured_at_once():
    from sonospan.functions import dsp

    x = np.random.default_rng(3).normal(size=1000)
    size, hop = dsp.sizes(8000, live.WINDOW_SECONDS, live.HOP_SECONDS)
    windows = dsp.framed(x, size, hop)
    got = live.window_frames(windows, np.arange(len(windows)) * hop, 8000, 75.0, 500.0)
    each = [dsp.formants(w, 8000, frame_seconds=live.WINDOW_SECONDS, hop_seconds=live.WINDOW_SECONDS) for w in windows]
    for c in ("frequencies", "bandwidths"):
        assert all(np.allclose(a, b[c][0], rtol=1e-9) for a, b in zip(got[c], each, strict=True))
    few = live.window_frames(windows, np.arange(len(windows)) * hop, 8000, 75.0, 500.0, ("level",))
    assert few["rms"].equals(got["rms"]) and few["db"].equals(got["db"]) and few[["hz", "voicing", "voiced", "frequencies", "bandwidths"]].isna().all(axis=None)

"""Live sessions: chunks of samples put in order, metered, analysed by frames and recorded into a corpus.

A chunk is (session_id, first, sample_rate, samples, at, last): ``first`` is the
index of its first sample, ``at`` when it was taken.  Sample time is index over
rate, so frames lie where the stream began, whatever the chunks' sizes: one frame
for every hop, none reused.  Samples that repeat are taken once.  A chunk that
comes before an earlier one waits; what is missing before it counts as lost once
``gap_seconds`` of event time have passed, or once too many samples wait.  A chunk
with ``last`` ends a session at its end; so does silence of ``idle_seconds``.
"""

from __future__ import annotations

import json
from collections.abc import Collection, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sonospan.functions import columns as fn
from sonospan.functions import dsp
from sonospan.sources import formats
from sonospan.store import Corpus, StoreError

CHUNK = "session_id string, first long, sample_rate int, samples array<float>, at timestamp, last boolean"
FRAME = "session_id string, t double, rms double, db double, hz double, voicing double, voiced boolean, frequencies array<double>, bandwidths array<double>"
PIECE = "session_id string, sample_rate int, first long, samples array<float>, lost long, closed boolean"
WINDOW_SECONDS, HOP_SECONDS = 0.030, 0.010
GAP_SECONDS, IDLE_SECONDS, DELAY_SECONDS = 5.0, 600.0, 60.0
#: Samples of a session that may wait for an earlier chunk: 8 MB.
MOST_EARLY = 1 << 21


def meter(chunks: DataFrame, seconds: float = 0.1) -> DataFrame:
    """Peak and RMS of tumbling windows of samples; the aggregation is partial on both sides of the shuffle."""
    rows = chunks.select("session_id", "sample_rate", "first", F.posexplode("samples").alias("k", "x"))
    slot = F.floor((F.col("first") + F.col("k")) / (F.col("sample_rate") * seconds))
    return rows.groupBy("session_id", slot.alias("slot")).agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x") * F.col("x"))).alias("rms"), F.count("*").alias("n"))


#: What frames tell, and their columns.
MEASURES = {"level": ("rms", "db"), "pitch": ("hz", "voicing", "voiced"), "formants": ("frequencies", "bandwidths")}


def window_frames(windows: np.ndarray, begins: np.ndarray, rate: int, lo: float, hi: float, measures: Collection[str] = tuple(MEASURES)) -> pd.DataFrame:
    """Measures of windows (a row each, ``begins`` their first samples), all at once; columns not asked for are null."""
    size, n = windows.shape[1], len(windows)
    x, alone = windows.reshape(-1), {"frame_seconds": size / rate, "hop_seconds": size / rate}  # end to end, each a frame of its own
    made: dict = {"t": begins / rate + size / (2 * rate)} | {c: [None] * n for names in MEASURES.values() for c in names}
    if "level" in measures:
        made |= {c: v for c, v in dsp.intensity(x, rate, **alone).items() if c != "t"}
    if "pitch" in measures:
        pitch = dsp.pitch_autocorrelation(x, rate, lo, hi, **alone)
        made |= {"hz": pitch["hz"], "voicing": pitch["voicing"], "voiced": pitch["voicing"] >= 0.45}
    if "formants" in measures:  # pre-emphasis starts anew in each window, so that frames don't depend on where chunks end
        made |= {c: v for c, v in dsp.window_formants(windows, rate).items() if c != "t"}
    return pd.DataFrame(made)


def frames_of(x: np.ndarray, first: int, rate: int, lo: float, hi: float) -> pd.DataFrame:
    """All frames of samples in a row, of which ``first`` is the first."""
    size, hop = dsp.sizes(rate, WINDOW_SECONDS, HOP_SECONDS)
    windows = dsp.framed(x, size, hop)
    return window_frames(windows, first + np.arange(len(windows)) * hop, rate, lo, hi)


class Order:
    """The samples of one session in order, from chunks in any."""

    #: next sample, rate, event time of the last chunk, whether the session has ended; early chunks (index, due, size, end mark) and their samples
    STATE = "next long, rate int, latest long, closed boolean, early_table binary, early_samples binary"

    def __init__(self, state: tuple = (0, 0, 0, False, b"", b"")):
        self.next, self.rate, self.latest, self.closed = state[:4]
        table, samples = np.frombuffer(state[4], dtype="<i8").reshape(-1, 4), np.frombuffer(state[5], dtype="<f4")
        ends = np.cumsum(table[:, 2])
        self.early = [(int(f), int(due), samples[e - n : e], bool(last)) for (f, due, n, last), e in zip(table, ends, strict=True)]

    def state(self) -> tuple:
        table = np.array([(f, due, len(x), last) for f, due, x, last in self.early], dtype="<i8")
        samples = np.concatenate([x for _, _, x, _ in self.early]) if self.early else np.zeros(0, dtype="<f4")
        return self.next, self.rate, self.latest, self.closed, table.tobytes(), samples.astype("<f4").tobytes()

    def take(self, chunks: list[tuple[int, int, np.ndarray, bool]], now: int, most_early: int = MOST_EARLY) -> Iterator[tuple[int, np.ndarray, int]]:
        """(first, samples, lost before) of every run that is now in order.  ``chunks``: first, due, samples, last."""
        if self.closed:
            return
        waiting = sorted([*self.early, *chunks], key=lambda c: (c[0], -len(c[2])))
        due = np.minimum.accumulate([c[1] for c in waiting][::-1])[::-1] if waiting else []
        room = sum(len(c[2]) for c in waiting) - most_early
        run: list[np.ndarray] = []
        begun, lost, k = self.next, 0, 0
        for k, (first, _, x, last) in enumerate(waiting):
            if first > self.next:
                if due[k] > now and room <= 0:
                    break
                if run or lost:
                    yield begun, np.concatenate([np.zeros(0, dtype="<f4"), *run]), lost
                run, begun, lost = [], first, first - self.next
                self.next = first
            if first + len(x) > self.next:
                run.append(x[self.next - first :])
                self.next = first + len(x)
            room -= len(x)
            if last:
                self.closed = True
                break
        else:
            k = len(waiting)
        self.early = [] if self.closed else waiting[k:]
        if run or lost:
            yield begun, np.concatenate([np.zeros(0, dtype="<f4"), *run]), lost

    def timer(self, idle: int) -> int:
        """When something is due if nothing more comes."""
        return min([self.latest + idle, *(due for _, due, _, _ in self.early)])


#: Sessions meet in so many groups of the state store: a call and its frames serve a group, not a session.
GROUPS = 1 << 13
#: Windows that are measured together.
WINDOWS = 1 << 12


class Held:
    """The sessions of one group: their order, extra state and when each is due, as one Arrow batch in the state store."""

    def __init__(self, extra: list[str]):
        types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary()}
        fields = [c.split() for c in (*Order.STATE.split(", "), *extra)]
        self.schema = pa.schema([("session", pa.string()), ("due", pa.int64()), *((name, types[kind]) for name, kind in fields)])
        self.fresh = tuple({"binary": b"", "long": 0}[c.split()[1]] for c in extra)

    def read(self, content: bytes | None) -> dict[str, tuple[int, tuple]]:
        """session -> when it is due, its order's state and the extra one."""
        if not content:
            return {}
        columns = pa.ipc.read_record_batch(pa.py_buffer(content), self.schema).columns
        return {session: (due, state) for session, due, *state in zip(*(c.to_pylist() for c in columns), strict=True)}

    def write(self, sessions: dict[str, tuple[int, tuple]]) -> bytes:
        columns = list(zip(*((session, due, *state) for session, (due, state) in sessions.items()), strict=True))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, self.schema, strict=True)], schema=self.schema).serialize().to_pybytes()


def in_order(chunks: DataFrame, schema: str, state_schema: str, step, frames, gap_seconds: float, idle_seconds: float, delay_seconds: float) -> DataFrame:
    """``step(session, order, runs, extra, ended)`` on every session that has new chunks or whose timer is due -> what it found and the new ``extra`` state.

    Sessions are kept in ``GROUPS`` groups by their hash.  Every session has a timer of
    its own; a group is due when one of its sessions is.  ``frames`` makes frames of
    ``schema`` from what the sessions of a group found.
    """
    columns = [c.split()[0] for c in schema.split(", ")]
    gap, idle = round(gap_seconds * 1000), round(idle_seconds * 1000)
    store = Held([c for c in state_schema.split(", ") if c])

    def run(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = store.read(state.get[0] if state.exists else None)
        now, found = state.getCurrentWatermarkMs(), []
        orders: dict[str, Order] = {}
        came: dict[str, list] = {}
        for b in batches if not state.hasTimedOut else []:
            for session, first, rate, samples, at, last in zip(b["session_id"], b["first"], b["sample_rate"], b["samples"], b["at_ms"], b["last"], strict=True):
                if session not in orders:
                    orders[session], came[session] = Order(held[session][1][:6]) if session in held else Order(), []
                order = orders[session]
                x = np.asarray(samples if samples is not None else [], dtype="<f4")
                rate = 0 if pd.isna(rate) else int(rate)
                if rate and order.rate and rate != order.rate:
                    raise ValueError(f"session {session!r} changes its rate from {order.rate} to {rate}")
                order.rate, order.latest = order.rate or rate, max(order.latest, int(at))
                came[session].append((int(first), int(at) + gap, x, False))
                if last:
                    came[session].append((int(first) + len(x), int(at) + gap, x[:0], True))
        for session, (due, kept) in held.items():
            if session not in orders and due < now:
                orders[session] = Order(kept[:6])
        for session, order in orders.items():
            extra = tuple(held[session][1][6:]) if session in held else store.fresh
            closed = order.closed
            runs = list(order.take(came.get(session, []), now))
            if session not in came and order.latest + idle <= now:
                if closed:  # nothing came while the ended session was remembered
                    del held[session]
                    continue
                runs += list(order.take([], 1 << 62))
                order.closed = True
            made, extra = step(session, order, runs, extra, order.closed and not closed)
            held[session] = max(order.timer(idle), now + 1), (*order.state(), *extra)
            if made is not None:
                found.append(made)
        if held:
            state.update((store.write(held),))
            state.setTimeoutTimestamp(min(due for due, _ in held.values()))
        else:
            state.remove()
        for made in frames(found):
            if len(made):
                yield made[columns]

    rows = chunks.withColumn("at_ms", F.unix_millis("at")).withColumn("last", F.coalesce("last", F.lit(False)))
    rows = rows.filter("session_id is not null and first is not null and at is not null").withWatermark("at", f"{round(delay_seconds * 1000)} milliseconds")
    rows = rows.withColumn("group", F.pmod(F.xxhash64("session_id"), F.lit(GROUPS)))
    return rows.groupBy("group").applyInPandasWithState(run, schema, "sessions binary", "append", "EventTimeTimeout")


def pieces(chunks: DataFrame, gap_seconds: float = GAP_SECONDS, idle_seconds: float = IDLE_SECONDS, delay_seconds: float = DELAY_SECONDS) -> DataFrame:
    """Runs of samples in order, each once, with the samples lost before it; the last row of a session is ``closed``."""

    def step(session, order, runs, extra, ended):
        rows = [(session, order.rate, first, x, lost, False) for first, x, lost in runs]
        if ended:
            rows.append((session, order.rate, order.next, np.zeros(0, dtype="<f4"), 0, True))
        return rows, extra

    def frames(found: list[list[tuple]]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame([row for rows in found for row in rows], columns=[c.split()[0] for c in PIECE.split(", ")])

    return in_order(chunks, PIECE, "", step, frames, gap_seconds, idle_seconds, delay_seconds)


def hop_frames(chunks: DataFrame, lo: float = 75.0, hi: float = 500.0, gap_seconds: float = GAP_SECONDS, idle_seconds: float = IDLE_SECONDS, delay_seconds: float = DELAY_SECONDS, measures: Collection[str] = tuple(MEASURES)) -> DataFrame:
    """Frames of every session as its chunks arrive, with the measures asked for; a frame that lost samples touch is left out.

    State per session: the samples from the next frame's start on (less than a
    window and a hop), where they begin, and chunks that came early.
    """

    def step(session, order, runs, extra, ended):
        held, at = np.frombuffer(extra[0], dtype="<f4"), extra[1]
        windows, begins = [], []
        for first, x, lost in runs:
            size, hop = dsp.sizes(order.rate, WINDOW_SECONDS, HOP_SECONDS)
            if lost:  # begin anew at the next place of the same grid
                held, at = held[:0], -(-first // hop) * hop
            if not len(held):
                x = x[max(0, at - first) :]
            held = np.concatenate([held, x])
            n = (len(held) - size) // hop + 1 if len(held) >= size else 0
            if n > 0:
                windows.append(dsp.framed(held, size, hop)[:n])
                begins.append(at + np.arange(n) * hop)
                held, at = held[n * hop :], at + n * hop
        made = (order.rate, session, np.concatenate(windows), np.concatenate(begins)) if windows else None
        return made, (held.astype("<f4").tobytes(), at)

    def frames(found: list[tuple]) -> Iterator[pd.DataFrame]:
        """Windows of sessions with one rate are measured together, up to about ``WINDOWS``."""
        found.sort(key=lambda f: f[0])
        part: list[tuple] = []
        for k, each in enumerate(found):
            part.append(each)
            if k + 1 == len(found) or found[k + 1][0] != each[0] or sum(len(f[3]) for f in part) >= WINDOWS:
                _, sessions, windows, begins = zip(*part, strict=True)
                names = np.repeat(np.array(sessions, dtype=object), [len(b) for b in begins])
                yield window_frames(np.concatenate(windows).astype(float), np.concatenate(begins), each[0], lo, hi, measures).assign(session_id=names)
                part = []

    return in_order(chunks, FRAME, "held binary, held_at long", step, frames, gap_seconds, idle_seconds, delay_seconds)


# ---- recording


def encoded(parts: DataFrame) -> DataFrame:
    """Pieces as rows of ``recording_part``, their samples as WAV content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            content = [formats.encode_wav(np.asarray(x.values, dtype=float), rate or 1) if x.is_valid else None for rate, x in zip(batch.column(1).to_pylist(), batch.column(3), strict=True)]
            sizes = [len(x) if x.is_valid else 0 for x in batch.column(3)]
            cols = [batch.column(0), batch.column(1), batch.column(2), pa.array(sizes, pa.int64()), batch.column(4), pa.array(content, pa.binary()), batch.column(5)]
            yield pa.RecordBatch.from_arrays(cols, ["recording", "sample_rate", "first_frame", "n_frames", "lost", "content", "closed"])

    return parts.select(*[c.split()[0] for c in PIECE.split(", ")]).mapInArrow(run, "recording string, sample_rate int, first_frame long, n_frames long, lost long, content binary, closed boolean")


def commit_recordings(corpus: Corpus, sessions: DataFrame | None = None, token: str | None = None) -> None:
    """Ended sessions become bundles with their audio and a run of kind ``live_recording``, in one commit; their parts go.

    ``sessions`` (recording) names the ones wanted, which must have ended and hold
    a frame; without it, all ended ones are taken, those without a frame are only
    dropped, and those whose file name a bundle has already stay as they are, to be
    discarded or committed by hand.  A recording's frames count what was lost; its audio is kept in
    the parts it came in, each with its first frame.  Nothing ended changes
    nothing.
    """
    if token is not None and corpus.has(token):
        return
    parts = corpus.table("recording_part")
    path = F.concat(F.lit("audio/"), fn.safe_file_name(F.col("recording")), F.lit(".wav"))
    ended = parts.filter("closed").select("recording").distinct()
    if sessions is not None:
        if not sessions.join(ended, "recording", "left_anti").isEmpty():
            raise StoreError("recording: a session is not there or has not ended")
        ended = ended.join(sessions, "recording", "left_semi")
    else:
        ended = ended.withColumn("audio_relative_path", path).join(corpus.table("bundle").select("audio_relative_path"), "audio_relative_path", "left_anti").select("recording")
    gone = corpus.staged(parts.join(ended, "recording", "left_semi"))
    if gone.isEmpty():
        return
    whole = gone.groupBy("recording").agg(F.max("sample_rate").alias("sample_rate"), F.max(F.col("first_frame") + F.col("n_frames")).alias("n_frames"), F.sum("n_frames").alias("kept"), F.sum("lost").alias("lost"))
    if sessions is not None and not whole.filter("kept = 0").isEmpty():
        raise StoreError("recording: no audio captured")
    made = corpus.staged(corpus.numbered("bundle", whole.filter("kept > 0")))
    none = {c: F.lit(None).cast(t) for c, t in (("session_id", "long"), ("speaker_id", "long"), ("extra", "string"))}
    bundles = made.select("id", F.col("recording").alias("name"), path.alias("audio_relative_path"), "sample_rate", F.lit(1).alias("channels"), "n_frames").withColumns(none)
    corpus._checked("bundle", bundles)
    audio = corpus.numbered("audio", gone.filter("n_frames > 0").join(made.select("recording", F.col("id").alias("bundle_id")), "recording").select("bundle_id", "content", "first_frame"))
    told = F.to_json(F.struct("sample_rate", F.lit(1).alias("channels"), (F.col("n_frames") / F.col("sample_rate")).alias("duration_s"), F.col("lost").alias("dropped_samples")))
    active = corpus.table("recipe_run").filter("status = 'running'").first()
    runs = made.select(F.col("id").alias("bundle_id"), F.lit("live_recording").alias("kind"), F.lit("live").alias("processor_id"), told.alias("parameters"), F.lit("done").alias("status"), F.lit(active["id"] if active else None).cast("long").alias("recipe_run_id"))
    changes = [("bundle", "insert", bundles), ("audio", "insert", audio), ("processing_run", "insert", corpus.numbered("processing_run", runs)), ("recording_part", "delete", gone)]
    corpus.commit(changes, token)


class Recorder:
    """A sink of ``pieces``: every micro-batch lands in the corpus once, however often it is replayed."""

    def __init__(self, corpus: Corpus, stream: str):
        self.corpus, self.stream = corpus, stream

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        token = f"{self.stream}:{epoch}"
        if not self.corpus.has(f"{token}:parts"):
            parts = self.corpus.staged(encoded(batch))
            if not parts.isEmpty():
                self.corpus.commit([("recording_part", "insert", self.corpus.numbered("recording_part", parts))], f"{token}:parts")
        commit_recordings(self.corpus, token=f"{token}:recordings")


class FrameTable:
    """A sink that keeps frames as Parquet, one folder an epoch: a replayed epoch is written again in its place."""

    def __init__(self, corpus: Corpus, stream: str):
        self.corpus, self.path = corpus, f"{corpus.root}/_frames/{stream}"

    def __call__(self, batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/epoch={epoch}")

    def read(self) -> DataFrame:
        return self.corpus.spark.read.schema(FRAME).parquet(self.path)


def start(frames: DataFrame, sink, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Run ``sink(batch, epoch)`` on every micro-batch; stop the query to end the session, delete the checkpoint to discard it."""
    return frames.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def record(corpus: Corpus, chunks: DataFrame, stream: str, trigger: dict | None = None, **how: float) -> StreamingQuery:
    """Record a stream of chunks into a corpus; its checkpoint lies beside the corpus, so a stream of that name goes on where it stopped."""
    return start(pieces(chunks, **how), Recorder(corpus, stream), f"{corpus.root}/_streams/{stream}", trigger)


def stop(query: StreamingQuery) -> None:
    """Take what is there, then stop."""
    query.processAllAvailable()
    query.stop()


def discard(corpus: Corpus, recording: str) -> int:
    """Drop what is recorded of a session that is not committed; again changes nothing."""
    return corpus.delete("recording_part", F.col("recording") == recording)

"""Likeliest paths through recordings that are cut into blocks of frames.

A block alone says how well each state can be reached from each state before it:
a matrix in the (max, +) algebra, kept as a band, since a path moves two states a
frame at most.  Five steps find the path of the whole recording:

1. every block makes its matrix, the first one its scores;
2. along a recording, matrices carry the scores to every border;
3. every block, with the scores at its border, tells for each state at its end the
   state at its border that the likeliest path came from;
4. back along a recording, these maps give the state at the end of every block;
5. every block gives its part of the path.

Steps 1, 3 and 5 look at frames and run over all blocks at once; 2 and 4 pass one
row a block through a stream.  Scores are whole numbers of 2 ** -32, so a sum does
not depend on how it is bracketed, and any cut gives the same path.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sonospan.checkpoints import settled
from sonospan.functions.align import NEVER, advanced, fixed, lattice

BLOCK = "block int, first long, emissions array<array<double>>"


def band(e: np.ndarray, may_skip: np.ndarray) -> np.ndarray:
    """M[i, d]: the best score from state i before the first frame to state i + d at the last.  ``e``: frames by states."""
    frames, states = e.shape
    width = min(2 * frames, states - 1) + 1
    to = np.arange(states)[:, None] + np.arange(width)[None]
    inside = to < states
    to = np.minimum(to, states - 1)
    skip = may_skip[to]
    best = np.full((states, width), NEVER)
    best[:, 0] = 0
    shifted = lambda m, k: np.pad(m, ((0, 0), (k, 0)), constant_values=NEVER)[:, : m.shape[1]]
    for row in e:
        best = np.maximum(np.maximum(best, shifted(best, 1)), np.where(skip, shifted(best, 2), NEVER))
        best = np.where(inside & (best > NEVER), np.maximum(best + row[to], NEVER), NEVER)
    return best


def carried_over(score: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Scores after a block from those before it."""
    out = np.full(len(score), NEVER)
    for d in range(matrix.shape[1]):
        n = len(score) - d
        both = (score[:n] > NEVER) & (matrix[:n, d] > NEVER)
        out[d:] = np.maximum(out[d:], np.where(both, score[:n] + matrix[:n, d], NEVER))
    return out


def _emissions(column: pa.Array, i: int) -> np.ndarray:
    frames = column[i].values
    return np.asarray(frames.flatten(), dtype=float).reshape(len(frames), -1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, dict]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch, i, {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names) if n != "emissions"}


def _table(schema: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64(), "string": pa.string()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[t]) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])


def _mapped(df: DataFrame, schema: str, make: Callable[[Iterator], Iterator[tuple]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in make(_rows(batches)):
            yield _table(schema, [row])

    return df.mapInArrow(run, schema)


def path_runs(blocks: DataFrame, targets: DataFrame, blank: int = 0, key: str = "bundle_id") -> DataFrame:
    """key, state, first, end, own, blank_sum: the runs of states on each recording's likeliest path, and sums over their frames of the log probabilities of their target and of the blank.

    ``blocks``: key (long), block (from 0), first (its first frame), emissions (log
    probabilities by frame and label); ``targets``: key, targets (array<int>).
    State 2k + 1 is target k, 2k the blank before it; a path never returns to a
    state, so each has one run.
    """
    cut = blocks.filter(F.size("emissions") > 0).join(targets.select(key, F.col("targets").cast("array<int>").alias("targets")), key)
    cut = settled(cut.select(F.col(key).cast("long").alias("key"), F.col("block").cast("int").alias("block"), F.col("first").cast("long").alias("first"), "targets", "emissions"))

    def made(batch: pa.RecordBatch, i: int, targets: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        e = _emissions(batch.column(batch.schema.get_field_index("emissions")), i)
        states, may_skip = lattice(targets, blank)
        if not targets or not 0 <= min(blank, *targets) <= max(blank, *targets) < e.shape[1]:
            raise ValueError("no targets, or a label is out of range")
        return e, fixed(e)[:, states], may_skip

    def matrices(rows: Iterator) -> Iterator[tuple]:
        for batch, i, r in rows:
            _, e, may_skip = made(batch, i, r["targets"])
            if r["block"] == 0:
                score = advanced(None, e, may_skip)[0]
                yield r["key"], r["block"], e.shape[1], 0, score.tobytes()
            else:
                m = band(e, may_skip)
                yield r["key"], r["block"], m.shape[0], m.shape[1], m.tobytes()

    def borders(rows: Iterator) -> Iterator[tuple]:
        score, of = None, None
        for _, _, r in rows:
            if r["key"] != of:
                if r["block"] != 0:
                    raise ValueError("a recording lacks its first block")
                of, score = r["key"], None
            yield r["key"], r["block"], None if score is None else score.tobytes()
            m = np.frombuffer(r["matrix"], dtype=np.int64)
            score = m if not r["width"] else carried_over(score, m.reshape(r["states"], r["width"]))

    def maps(rows: Iterator) -> Iterator[tuple]:
        for batch, i, r in rows:
            _, e, may_skip = made(batch, i, r["targets"])
            score, back = advanced(np.frombuffer(r["border"], dtype=np.int64) if r["border"] else None, e, may_skip)
            at = np.arange(len(score))
            for step in back[::-1]:
                at = at - step[at]
            last = len(score) - 1 if score[-1] >= score[-2] else len(score) - 2
            yield r["key"], r["block"], last, bool(score[last] > NEVER), at.astype("<i4").tobytes()

    def ends(rows: Iterator) -> Iterator[tuple]:
        at, of = 0, None
        for _, _, r in rows:  # the last block of a recording comes first
            if r["key"] != of:
                of, at = r["key"], r["last"]
                if not r["reached"]:
                    raise ValueError(f"recording {of} has too few frames for its targets")
            yield r["key"], r["block"], int(at)
            at = np.frombuffer(r["came"], dtype="<i4")[at]

    def parts(rows: Iterator) -> Iterator[tuple]:
        for batch, i, r in rows:
            logs, e, may_skip = made(batch, i, r["targets"])
            _, back = advanced(np.frombuffer(r["border"], dtype=np.int64) if r["border"] else None, e, may_skip)
            path, at = np.zeros(len(e), dtype=np.int64), r["at"]
            for t in range(len(e) - 1, -1, -1):
                path[t] = at
                at -= back[t, at]
            edges = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                own = r["targets"][max((path[lo] + 1) // 2 - 1, 0)]
                yield r["key"], int(path[lo]), r["first"] + lo, r["first"] + hi, float(logs[lo:hi, own].sum()), float(logs[lo:hi, blank].sum())

    along = lambda df, *order: df.repartition("key").sortWithinPartitions("key", *order)
    steps = _mapped(cut, "key long, block int, states int, width int, matrix binary", matrices)
    border = _mapped(along(steps, "block"), "key long, block int, border binary", borders)
    known = settled(cut.join(border, ["key", "block"]))

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in maps(_rows(batches)):
            key_, block, last, reached, came = row
            yield pa.RecordBatch.from_arrays([pa.array([key_]), pa.array([block], pa.int32()), pa.array([last], pa.int32()), pa.array([reached]), pa.array([came], pa.binary())], ["key", "block", "last", "reached", "came"])

    came = known.mapInArrow(told, "key long, block int, last int, reached boolean, came binary")
    end = _mapped(along(came, F.desc("block")), "key long, block int, at int", ends)
    runs = _mapped(known.join(end, ["key", "block"]), "key long, state int, first long, end long, own double, blank_sum double", parts)
    return runs.groupBy(F.col("key").alias(key), "state").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sum("own").alias("own"), F.sum("blank_sum").alias("blank_sum"))


def forced_align_cut(blocks: DataFrame, targets: DataFrame, blank: int = 0, min_silence_frames: int = 0, key: str = "bundle_id") -> DataFrame:
    """Spans (key, token, first, end, score) of recordings cut into blocks, as ``align.forced_align`` finds them in whole ones.

    Blank frames belong to the phone before them, leading ones to the first;
    blanks of ``min_silence_frames`` or more (0: none) are silence, with token -1.
    """
    runs = path_runs(blocks, targets, blank, key)
    silent = (F.col("state") % 2 == 0) & (F.col("end") - F.col("first") >= min_silence_frames) if min_silence_frames > 0 else F.lit(False)
    owner = F.greatest(F.floor((F.col("state") + 1) / 2) - 1, F.lit(0)).cast("int")
    # a path keeps the order of states, so what a phone owns is in one piece
    spans = runs.groupBy(key, silent.alias("silent"), F.when(silent, F.col("state")).otherwise(owner).alias("of")).agg(F.min("first").alias("first"), F.max("end").alias("end"), F.sum(F.when(silent, F.col("blank_sum")).otherwise(F.col("own"))).alias("total"))
    return spans.select(key, F.when(F.col("silent"), -1).otherwise(F.col("of")).cast("int").alias("token"), "first", "end", (F.col("total") / (F.col("end") - F.col("first"))).alias("score"))


def traced(frames: DataFrame, advance: Callable[[object, pa.RecordBatch], tuple[object, list[bytes], np.ndarray]], came: Callable[[bytes, int], int], key: str = "bundle_id", order: str = "frame") -> DataFrame:
    """``frames`` (key, order, ...) with the state that each one has on its recording's cheapest path.

    Two streams along the recordings, which hold a batch of frames at a time: forward, ``advance`` gets what it returned
    for the frames before (None: a recording begins) and frames of one recording, and returns it for those to come, where
    each frame's states came from, and the best state at each; back, ``came`` reads there the state before a state.  The steps
    are those over a whole recording, so the path is, to the last bit.
    """
    kinds = {f.name: f.dataType.simpleString() for f in frames.schema.fields}
    fields = ", ".join(f"`{c}` {k}" for c, k in kinds.items())

    def forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, carried = None, None
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(key)).to_pylist()
            edges = [0, *[i for i in range(1, len(keys)) if keys[i] != keys[i - 1]], len(keys)]
            for lo, hi in zip(edges, edges[1:], strict=False):
                for begin in range(lo, hi, 500):
                    part = batch.slice(begin, min(500, hi - begin))
                    if part.num_rows:
                        of, carried = keys[begin], carried if of == keys[begin] else None
                        carried, back, best = advance(carried, part)
                        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(back, pa.binary()), pa.array(best, pa.int32())], [*kinds, "_back", "_best"])

    def backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            keys, path = batch.column(batch.schema.get_field_index(key)).to_pylist(), []
            best, back = batch.column(batch.schema.get_field_index("_best")).to_pylist(), batch.column(batch.schema.get_field_index("_back"))
            for i, k in enumerate(keys):
                if k != of:  # the last frame of a recording comes first
                    of, state = k, best[i]
                path.append(state)
                state = came(back[i].as_py(), state)
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(len(kinds))], pa.array(path, pa.int32())], [*kinds, "state"])

    along = lambda df, by: df.repartition(key).sortWithinPartitions(key, by)
    made = along(frames, order).mapInArrow(forward, f"{fields}, _back binary, _best int")
    return along(made, F.desc(order)).mapInArrow(backward, f"{fields}, state int")

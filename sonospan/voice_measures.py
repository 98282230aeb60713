"""Voice measures of recordings that are cut into pieces: no task holds a recording.

Three passes over the pieces.  The first gives frames and sums that hang on nothing
else; the second, with a recording's pitch and prediction polynomial, sums over
frames and bands, and for every place where the search for pulses may enter a piece
the place where it leaves; along a recording these maps give where it does enter,
and the third pass finds each piece's pulses.  Neighbours of pulses are windows over
rows.  Bands of the glottal-to-noise excitation are filtered in pieces with
``MARGIN`` vectors on both sides, by which their response has died away.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sonospan.audio_queries import EACH, MEASURES, PIECE, Piece, heard, pieces, strung, voiced
from sonospan.checkpoints import settled
from sonospan.functions import clinical, dsp
from sonospan.functions.columns import hann

MARGIN = 2
LO, HI = 75.0, 600.0
#: Rate and order of the excitation's analysis, and its bands.
GNE_RATE, ORDER, CENTRES = 10_000, 13, np.arange(500, 4501, 300)
#: What a row of sums is about.
HZ, HNR, CPPS, LTAS, WELCH, LPC, TOP, H1H2, GNE = range(9)
SUMS = "piece long, what int, i int, v double, w double"


def table(piece: Piece, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> dict:
    """Values and second values by what they are about."""
    sizes = [len(v) for _, v, _ in parts]
    whole = lambda k: np.concatenate([np.asarray(p[k], dtype=float) for p in parts])
    about = np.repeat([p[0] for p in parts], sizes).astype(np.int32)
    return {"piece": np.full(len(about), piece.begin // (PIECE * EACH)), "what": about, "i": np.concatenate([np.arange(n) for n in sizes]).astype(np.int32), "v": whole(1), "w": whole(2)}


def own(p: Piece, hop: int) -> tuple[np.ndarray, int]:
    """Samples from the first frame of a piece on, and how many frames are its own."""
    at = p.frames(hop)
    return p.part(at.start * hop), len(at)


def around(p: Piece, vectors: list[dict] | None) -> np.ndarray:
    """Samples of the recording's other end."""
    return voiced(100 + 17 * (p.bundle % 12), vectors[0]["k"] * EACH, p.rate, np.array([v["embedding"] for v in vectors], dtype=float)) if vectors else np.zeros(0)


def excited(p: Piece, head: list[dict] | None, tail: list[dict] | None) -> tuple[np.ndarray, int, slice]:
    """A piece at ``GNE_RATE`` between zeros, the number of its first sample, and which are the piece's own.

    A recording's end is taken to go on with its beginning (``head``, ``tail``: its
    vectors).  Its length is a whole number of samples, which sets their distance; a
    length of the piece is taken at which that distance is met to a thousandth of a
    sample over all of it.
    """
    before, after = around(p, tail if p.first == 0 else None), around(p, head if p.first + len(p.x) == p.n else None)
    given, length, pad = np.concatenate([before, p.x, after]), gne_length(p.n, p.rate), p.rate // 5
    start = p.first - len(before) - pad
    each = p.n / length
    sizes = len(given) + 2 * pad + np.arange(2000)
    size = int(sizes[np.abs(sizes / each - np.rint(sizes / each)).argmin()])
    n, first = int(np.rint(size / each)), int(np.ceil(start / each))
    spectrum = np.fft.rfft(np.pad(given, (pad, size - len(given) - pad)))
    moved = spectrum * np.exp(2j * np.pi * np.arange(len(spectrum)) * (first * each - start) / size)
    kept = np.zeros(n // 2 + 1, dtype=complex)
    k = min(len(kept), len(moved))
    kept[:k] = moved[:k]
    stop = length if p.end == p.n else int(np.ceil(p.end / each))
    return np.fft.irfft(kept, n) * (n / size), first, slice(int(np.ceil(p.begin / each)) - first, stop - first)


def gne_length(n: int, rate: int) -> int:
    return int(round(n * GNE_RATE / rate))


def first_pass(p: Piece, head: list[dict] | None, tail: list[dict] | None) -> dict:
    pitch_hop, hnr_hop = dsp.sizes(p.rate, 0.03, 0.01)[1], max(1, int(0.01 * p.rate))
    x, k = own(p, pitch_hop)
    found = dsp.pitch_windowed(x, p.rate, LO, HI)
    hz = found["hz"][:k][(found["voicing"][:k] >= 0.45) & (found["hz"][:k] > 0)]
    x, k = own(p, hnr_hop)
    power, db = (v[:k] for v in clinical.hnr_frames(x[: (k - 1) * hnr_hop + 3 * int(p.rate / LO)], p.rate))
    hop = max(1, int(0.005 * p.rate))
    x, k = own(p, hop)
    peaks = clinical.cepstral_peaks(x[: (k - 1) * hop + 4096], p.rate)
    parts = [(HZ, hz, hz), (HNR, power, db), (CPPS, [peaks.sum()], [len(peaks)])]
    for what, n in ((LTAS, 2048), (WELCH, 4096)):
        x, k = own(p, n // 2)
        f = dsp.framed(x, n, n // 2)[:k]
        total = (np.abs(np.fft.rfft(f * np.array(hann(n)), axis=1)) ** 2).sum(axis=0)
        total = dsp.banded(total, p.rate / n)[1] if what == LTAS else total[: int(2000 * n / p.rate)]
        parts.append((what, total, np.full(len(total), len(f))))
    y, first, mine = excited(p, head, tail)
    length = gne_length(p.n, p.rate)
    j = np.arange(len(y)) + first
    y = y * np.where((j >= 0) & (j < length), 0.5 - 0.5 * np.cos(2 * np.pi * j / max(length - 1, 1)), 0.0)
    r = [float((y[mine] * y[mine.start + k : mine.stop + k]).sum()) for k in range(ORDER + 1)]
    parts += [(LPC, r, np.zeros(len(r))), (TOP, [np.abs(p.part(p.begin, p.end)).max()], [0])]
    return table(p, parts)


def envelopes(p: Piece, head: list[dict] | None, tail: list[dict] | None, a: np.ndarray) -> np.ndarray:
    """Envelopes of the bands of what prediction leaves of a piece, its own samples."""
    y, first, mine = excited(p, head, tail)
    n = len(y)
    left = np.convolve(y, a)[:n]
    for z in (-first, gne_length(p.n, p.rate) - first):  # prediction begins with the recording
        if 0 <= z <= n - len(a):
            left[z : z + len(a)] = np.convolve(y[z : z + len(a)], a)[: len(a)]
    spectrum = np.fft.rfft(left)
    hz = np.arange(len(spectrum)) * GNE_RATE / n
    out = []
    for centre in CENTRES:
        shape = np.where(np.abs(hz - centre) <= 500, 0.5 * (1 + np.cos(np.pi * (hz - centre) / 500)), 0)
        both = np.zeros(n, dtype=complex)
        both[: len(hz)] = 2 * spectrum * shape
        out.append(np.abs(np.fft.ifft(both))[mine])
    return np.array(out)


def second_pass(p: Piece, f0: float | None, top: float, a: list[float], head: list[dict] | None, tail: list[dict] | None) -> dict:
    e = envelopes(p, head, tail, np.array(a))
    products = (e @ e.T)[np.triu_indices(len(CENTRES))]
    sums = np.concatenate([[e.shape[1]], e.sum(axis=1), products])
    parts = [(GNE, sums, np.zeros(len(sums)))]
    if f0 is not None:
        x, k = own(p, 2048)
        values = clinical.h1_h2_frames(x[: (k - 1) * 2048 + 4096], p.rate, f0) if k else []
        parts.append((H1H2, [sum(values)], [len(values)]))
    made = table(p, parts)
    return made | {"exits": pa.array([exits(p, f0, top) if i == 0 and f0 is not None else None for i in range(len(made["v"]))], pa.binary())}


def exits(p: Piece, f0: float, top: float) -> bytes:
    """Where the search for pulses leaves a piece, by where it enters: ways soon meet, so all of them cost little more than one."""
    period = int(p.rate / f0)
    x, base, known = p.part(p.begin), p.begin, {}
    limit = min(p.end, p.n - period + 1) - base
    out = []
    for enter in range(period + int(0.7 * period) + 1):
        at, way = enter, []
        while at < limit and at not in known:
            way.append(at)
            at = clinical.next_pulse(x, at, period, 0.2 * top)[0]
        to = known.get(at, at)
        known.update(dict.fromkeys(way, to))
        out.append(to)
    return (np.array(out, dtype="<i8") + base).tobytes()


def entered(maps: DataFrame) -> DataFrame:
    """bundle_id, piece, entry: where the search enters each piece.  ``maps``: bundle_id, piece, exits; one short row a piece passes a stream along a recording."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, at = None, 0
        for batch in batches:
            entries = []
            for b, piece, to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if b != of:
                    of, at = b, 0
                entries.append(at)
                at = int(np.frombuffer(to, dtype="<i8")[at - piece * PIECE * EACH])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(entries, pa.int64())], ["bundle_id", "piece", "entry"])

    return maps.select("bundle_id", "piece", "exits").repartition("bundle_id").sortWithinPartitions("bundle_id", "piece").mapInArrow(run, "bundle_id long, piece long, entry long")


def third_pass(p: Piece, f0: float, top: float, entry: int) -> dict:
    period = int(p.rate / f0)
    x, base = p.part(p.begin - 1), max(p.begin - 1, p.first)  # a pulse's place hangs on the sample before it, too
    limit = min(p.end, p.n - period + 1) - base
    at, found = entry - base, []
    while at < limit:
        at, best = clinical.next_pulse(x, at, period, 0.2 * top)
        if best >= 0:
            found.append(clinical.pulse_at(x, best))
    return {"t": np.array([t + base for t, _ in found]) / p.rate, "a": np.array([h for _, h in found])}


def perturbation(pulses: DataFrame) -> DataFrame:
    """The measures of ``clinical.perturbation`` from pulses (bundle_id, t, a)."""
    w = Window.partitionBy("bundle_id").orderBy("t")
    near = lambda c, k: F.lead(c, k).over(w) if k >= 0 else F.lag(c, -k).over(w)
    off = lambda c, m: F.abs(F.col(c) - sum((near(c, k) for k in range(-(m // 2), m // 2 + 1)), F.lit(0.0)) / m)
    step = lambda c: F.abs(near(c, 1) - F.col(c))
    rows = pulses.withColumn("p", near("t", 1) - F.col("t"))
    ratio = F.when((F.col("a") > 0) & (near("a", 1) > 0), F.abs(20 * F.log10(near("a", 1) / F.col("a"))))
    rows = rows.select("bundle_id", "p", "a", step("p").alias("dp"), step("a").alias("da"), ratio.alias("db"), *[off(c, m).alias(f"{c}{m}") for c, m in (("p", 3), ("p", 5), ("a", 3), ("a", 5))])
    over = lambda c, of: F.when(F.avg(of) != 0, F.avg(c) / F.avg(of))
    made = {
        "jitter_local": over("dp", "p"), "jitter_rap": over("p3", "p"), "jitter_ppq5": over("p5", "p"), "shimmer_local": over("da", "a"), "shimmer_local_db": F.coalesce(F.sum("db"), F.lit(0.0)) / (F.count("*") - 1),
        "shimmer_apq3": over("a3", "a"), "shimmer_apq5": over("a5", "a"), "period_sd": F.stddev_samp("p"),
    }
    n = F.count("*")
    return rows.groupBy("bundle_id").agg(n.cast("double").alias("n_pulses"), *[F.when(n >= clinical.LEAST_PULSES, v).alias(c) for c, v in made.items()])


def totals(rows: DataFrame) -> DataFrame:
    """bundle_id, sums: a few hundred totals of a recording, in order."""
    known = rows.groupBy("bundle_id", "what", "i").agg(F.sum("v").alias("v"), F.sum("w").alias("w"))
    return known.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("what", "i", "v", "w"))).alias("sums"))


def told(rows: DataFrame, make, names: list[str], lists: tuple[str, ...] = ()) -> DataFrame:
    """A row of ``make(v, w, f0, n)`` for each recording; ``v`` and ``w``: totals by what they are about."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b, n, f0, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                v, w = ({k: np.array([s[c] for s in sums if s["what"] == k]) for k in range(GNE + 1)} for c in ("v", "w"))
                out.append((b, *make(v, w, f0, n)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64() if not k else pa.list_(pa.float64()) if names[k - 1] in lists else pa.float64()) for k in range(len(names) + 1)], ["bundle_id", *names])

    return rows.select("bundle_id", "n", "f0", "sums").mapInArrow(run, "bundle_id long, " + ", ".join(f"{c} {'array<double>' if c in lists else 'double'}" for c in names))


def measured(spark, sf_dir: str, rate: int = 22_050) -> DataFrame:
    """All measures of ``clinical.measures`` of the recordings."""
    n_fft, nan = 4096, float("nan")
    hz = dsp.banded(np.zeros(1025), rate / 2048)[0]

    def alone(v: dict, w: dict, f0: float | None, n: int) -> tuple:
        power = v[LTAS] / w[LTAS]
        a = dsp.levinson(v[LPC][None])[0] if gne_length(n, rate) >= 300 else np.zeros(ORDER + 1)
        # no frame of 4096 in a shorter recording
        over = clinical.harmonics_over_valleys(v[WELCH] / w[WELCH], rate / n_fft, f0) if f0 is not None and n >= n_fft else nan
        high = -dsp.slope_db(hz, power, (0, 6000), (6000, 10_000)) if rate >= 20_000 else nan
        return v[CPPS][0] / w[CPPS][0] if w[CPPS][0] else nan, over, high, dsp.slope_db(hz, power, (0, 1000), (1000, 10_000)), dsp.tilt_db_per_khz(hz, power, 0, 10_000), a

    def excitation(v: dict, w: dict, f0: float | None, n: int) -> tuple:
        k, s = len(CENTRES), v[GNE]
        both = np.zeros((k, k))
        both[np.triu_indices(k)] = s[1 + k :]
        both -= np.outer(s[1 : 1 + k], s[1 : 1 + k]) / s[0]
        scale = np.sqrt(np.outer(np.diag(both), np.diag(both)))
        pairs = [both[i, j] / scale[i, j] if scale[i, j] > 0 else 0.0 for i in range(k) for j in range(i + 1, k) if CENTRES[j] - CENTRES[i] >= 500]
        level = v[H1H2][0] / w[H1H2][0] if len(v[H1H2]) and w[H1H2][0] else nan
        return max(pairs) if gne_length(n, rate) >= 300 else nan, level

    cut = pieces(spark, sf_dir, before=MARGIN, after=MARGIN)
    vectors = strung(spark, sf_dir).join(F.broadcast(cut.groupBy("bundle_id").agg(F.max("n").alias("n"))), "bundle_id")
    at_end = lambda near: F.array_sort(F.collect_list(F.when(near, F.struct("k", "embedding"))))
    ends = vectors.filter((F.col("k") < MARGIN) | (F.col("k") >= F.col("n") - MARGIN)).groupBy("bundle_id").agg(at_end(F.col("k") < MARGIN).alias("_head"), at_end(F.col("k") >= F.col("n") - MARGIN).alias("_tail"))
    # pieces that reach an end are heard with the other end
    cut = cut.join(F.broadcast(ends), "bundle_id").withColumns({c: F.when(((F.col("piece") + 1) * PIECE + MARGIN >= F.col("n")) | (F.col("piece") == 0), F.col(f"_{c}")) for c in ("head", "tail")})
    cut = settled(cut.drop("_head", "_tail"))
    rows = settled(heard(cut, first_pass, SUMS, rate, ("head", "tail")))
    ordered = Window.partitionBy("bundle_id").orderBy("v", "piece", "i")
    voiced = rows.filter(F.col("what") == HZ).select("bundle_id", "v", F.row_number().over(ordered).alias("k"))
    middle = rows.filter(F.col("what") == HZ).groupBy("bundle_id").agg((F.floor(F.count("*") / 2) + 1).alias("k"))
    f0 = voiced.join(F.broadcast(middle), ["bundle_id", "k"]).select("bundle_id", F.col("v").alias("f0"))
    tops = rows.groupBy("bundle_id").agg(F.max(F.when(F.col("what") == TOP, F.col("v"))).alias("top"), F.max(F.when(F.col("what") == HNR, F.col("v"))).alias("loudest"))
    length = cut.groupBy("bundle_id").agg((F.max("n") * EACH).alias("n"))
    known = settled(length.join(tops, "bundle_id").join(f0, "bundle_id", "left"))
    hnr = rows.filter(F.col("what") == HNR).join(F.broadcast(known.select("bundle_id", "loudest")), "bundle_id").filter("v >= 0.01 * loudest").groupBy("bundle_id").agg(F.avg("w").alias("hnr_db"))
    summed = totals(rows.filter(F.col("what").isin(CPPS, LTAS, WELCH, LPC))).join(known, "bundle_id")
    first = settled(told(summed, alone, ["cpps_db", "hnr_d_db", "hfno_db", "ltas_slope_db", "ltas_tilt", "a"], ("a",)))
    with_known = cut.drop("n").join(F.broadcast(known.select("bundle_id", "top", "f0", F.col("n"))), "bundle_id").withColumn("n", (F.col("n") / EACH).cast("long"))
    again = settled(heard(with_known.join(F.broadcast(first.select("bundle_id", "a")), "bundle_id"), second_pass, SUMS + ", exits binary", rate, ("f0", "top", "a", "head", "tail")))
    second = told(totals(again.drop("exits")).join(known, "bundle_id"), excitation, ["gne", "h1_h2_db"])
    entry = entered(again.filter("exits is not null and what = " + str(GNE)))
    pulses = heard(with_known.join(entry, ["bundle_id", "piece"]), third_pass, "t double, a double", rate, ("f0", "top", "entry"))
    out = known.select("bundle_id", "f0").join(first.drop("a"), "bundle_id").join(second, "bundle_id").join(hnr, "bundle_id", "left").join(perturbation(pulses), "bundle_id", "left")
    return out.withColumn("n_pulses", F.coalesce("n_pulses", F.lit(0.0))).select("bundle_id", *[F.coalesce(m, F.lit(nan)).alias(m) for m in MEASURES])

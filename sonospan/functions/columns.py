"""Signal and measure functions as Columns; they stay in the JVM."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Published coefficients of the two indices.
AVQI = (3.295, -0.111, -0.073, -0.213, 2.789, -0.032, 0.077, 2.571)
ABI = (5.044774, -0.172, -0.193, -1.283, -0.396, 0.01, 0.017, 1.473, -0.088, -68.295, 2.92574)


def rms(x: Column) -> Column:
    return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v) / F.size(x))


def db_fs(r: Column) -> Column:
    """Level of an RMS value, -200 for silence."""
    return F.when(r > 0, 20 * F.log10(r)).otherwise(-200.0)


def preemphasis(x: Column, a: float) -> Column:
    """x[i] - a * x[i - 1]; the first sample is kept."""
    return F.transform(x, lambda v, i: F.when(i == 0, v).otherwise(v - a * F.get(x, i - 1)))


def _window(n: int, value) -> list[float]:
    return [1.0] * n if n <= 1 else [value(k) for k in range(n)]


def hann(n: int, periodic: bool = False) -> list[float]:
    return _window(n, lambda k: 0.5 * (1 - math.cos(2 * math.pi * k / (n if periodic else n - 1))))


def hamming(n: int) -> list[float]:
    return _window(n, lambda k: 0.54 - 0.46 * math.cos(2 * math.pi * k / (n - 1)))


def blackman(n: int) -> list[float]:
    return _window(n, lambda k: 0.42 - 0.5 * math.cos(2 * math.pi * k / (n - 1)) + 0.08 * math.cos(4 * math.pi * k / (n - 1)))


def gaussian(n: int, sigma: float) -> list[float]:
    return _window(n, lambda k: math.exp(-0.5 * ((k - (n - 1) / 2) / sigma) ** 2))


def bessel_i0(x: float) -> float:
    """Power series of the modified Bessel function of order 0."""
    term = total = 1.0
    for k in range(1, 51):
        term *= (x / (2 * k)) ** 2
        total += term
        if term < 1e-12 * total:
            break
    return total


def kaiser(n: int, beta: float) -> list[float]:
    return _window(n, lambda k: bessel_i0(beta * math.sqrt(max(0.0, 1 - (2 * k / (n - 1) - 1) ** 2))) / bessel_i0(beta))


def windowed(x: Column, window: list[float]) -> Column:
    return F.zip_with(x, F.array(*[F.lit(w) for w in window]), lambda a, b: a * b)


def moving_average(x: Column, width: int) -> Column:
    """Centred mean with windows that shrink at the edges."""
    h = width // 2

    def mean(v: Column, i: Column) -> Column:
        lo = F.greatest(i - h, F.lit(0))
        part = F.slice(x, lo + 1, F.least(i + h, F.size(x) - 1) - lo + 1)
        return F.aggregate(part, F.lit(0.0), lambda s, y: s + y) / F.size(part)

    return F.transform(x, mean)


def autocorrelation(x: Column, most: int) -> Column:
    """Sums of x[i] * x[i + lag] for lags 0..most."""
    lag = lambda k: F.aggregate(F.zip_with(F.slice(x, F.lit(1), F.size(x) - k), F.slice(x, k + 1, F.size(x) - k), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.transform(F.sequence(F.lit(0), F.lit(most)), lag)


def perturbation(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Jitter (local), 5-point quotient and shimmer in dB of ordered values, for keys with more than five."""
    w = Window.partitionBy(key).orderBy(*order)
    five = w.rowsBetween(-2, 2)
    v = F.col(value)
    made = rows.select(key, v.alias("v"), F.lead(v).over(w).alias("nv"), F.avg(v).over(five).alias("m5"), F.count(v).over(five).alias("c5"))
    v, nv = F.col("v"), F.col("nv")
    pairs = F.count("*") - 1
    return made.groupBy(key).agg(
        F.count("*").alias("_n"),
        (F.sum(F.abs(nv - v)) / pairs / F.avg(v)).alias("jitter_local"),
        (F.avg(F.when(F.col("c5") == 5, F.abs(v - F.col("m5")))) / F.avg(v)).alias("ppq5"),
        (F.sum(F.when((v > 0) & (nv > 0), F.abs(20 * F.log10(nv / v))).otherwise(0.0)) / pairs).alias("shimmer_db"),
    ).filter("_n > 5").drop("_n")


def _index(coefficients: tuple[float, ...], *terms: Column) -> Column:
    first, *each, scale = coefficients
    inner = F.lit(first)
    for c, t in zip(each, terms, strict=True):
        inner = inner + c * t
    return F.greatest(F.lit(0.0), F.least(F.lit(10.0), scale * inner))


def avqi(cpps: Column, hnr: Column, shimmer_pct: Column, shimmer_db: Column, slope: Column, tilt: Column) -> Column:
    return _index(AVQI, cpps, hnr, shimmer_pct, shimmer_db, slope, tilt)


def abi(cpps: Column, jitter_pct: Column, gne: Column, hfno: Column, hnr_d: Column, h1_h2: Column, shimmer_db: Column, shimmer_pct: Column, psd: Column) -> Column:
    return _index(ABI, cpps, jitter_pct, gne, hfno, hnr_d, h1_h2, shimmer_db, shimmer_pct, psd)


def upper_median(x: Column) -> Column:
    """The element at n // 2 of the sorted array."""
    return F.get(F.sort_array(x), F.floor(F.size(x) / 2).cast("int"))


def strip_stress(ipa: Column) -> Column:
    return F.translate(ipa, "ˈˌ", "")


def encode_label(label: Column, extra_json: Column) -> Column:
    """A label with its JSON behind a sentinel."""
    return F.when(extra_json.isNull(), label).otherwise(F.concat(label, F.lit(" {json:"), extra_json, F.lit("}")))


def decode_label(text: Column) -> Column:
    """(label, extra): the last sentinel counts, and only at the end."""
    at = F.length(text) - F.locate(":nosj{ ", F.reverse(text)) - 5
    has = text.endswith("}") & (F.locate(" {json:", text) > 0)
    return F.struct(F.when(has, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("label"), F.when(has, F.substring(text, at + 7, F.length(text) - at - 7)).alias("extra"))


def reference_payload(extra: Column) -> Column:
    """What the label of a reference carries behind its sentinel: target_kind, target_id, target (the document's name of it), placeholder and extra."""
    at = lambda path: F.get_json_object(extra, path)
    return F.struct(F.coalesce(at("$.target_kind"), F.lit("annotation")).alias("target_kind"), F.coalesce(at("$.target_id").cast("long"), F.lit(0).cast("long")).alias("target_id"), at("$.target").alias("target"), F.coalesce(at("$.placeholder") == "true", F.lit(False)).alias("placeholder"), at("$.extra").alias("extra"))


def safe_file_name(name: Column) -> Column:
    return F.regexp_replace(name, r"[^A-Za-z0-9._-]", "_")


def quoted(text: Column) -> Column:
    """A text in quotes, those inside doubled."""
    return F.concat(F.lit('"'), F.regexp_replace(text, '"', '""'), F.lit('"'))


def window_column(window: list[float]) -> Column:
    return F.array(*map(F.lit, window))

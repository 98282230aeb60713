"""Reference distributions: filters, summaries, quantiles and histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUANTILES = {"p5": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
# Normal quantiles of the same levels, to four places.
NORMAL = {"p5": -1.6449, "p25": -0.6745, "median": 0.0, "p75": 0.6745, "p95": 1.6449, "min": -2.0, "max": 2.0}


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def filtered(data: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Rows where every column equals its value, ASCII case aside."""
    for name, value in filters.items():
        data = data.filter(ascii_lower(F.col(name)) == ascii_lower(F.lit(value)))
    return data


def column_double(data: DataFrame, name: str) -> Column:
    """A numeric column; a null in a kept row is an error."""
    return F.coalesce(F.col(name).cast("double"), F.raise_error(F.lit(f"null in {name}")).cast("double"))


def summary(data: DataFrame, parameter: str, keys: list[str] = ()) -> DataFrame:
    """n, mean, sd (0 for one row), min, p5, p25, median, p75, p95, max; quantiles interpolate linearly."""
    v = F.col(parameter)
    qs = F.percentile(v, F.array(*[F.lit(q) for q in QUANTILES.values()]))
    rows = data.groupBy(*keys).agg(F.count(v).alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"), F.min(v).alias("min"), F.max(v).alias("max"), qs.alias("_q"))
    return rows.filter("n > 0").select(*keys, "n", "mean", "sd", "min", *[F.col("_q")[i].alias(k) for i, k in enumerate(QUANTILES)], "max")


def normative_summary(data: DataFrame, parameter: str, n_speakers: int, keys: list[str] = ()) -> DataFrame:
    """Summary of a normal model: the mean of ``stat = mean`` rows and of ``stat = sd`` rows (0 without any)."""
    v = F.col(parameter)
    rows = data.groupBy(*keys).agg(F.avg(F.when(F.col("stat") == "mean", v)).alias("mean"), F.coalesce(F.avg(F.when(F.col("stat") == "sd", v)), F.lit(0.0)).alias("sd"))
    return rows.filter("mean is not null").select(*keys, F.lit(n_speakers).cast("long").alias("n"), "mean", "sd", *[(F.col("mean") + z * F.col("sd")).alias(k) for k, z in NORMAL.items()])


def histogram(data: DataFrame, parameter: str, bins: int, keys: list[str] = ()) -> DataFrame:
    """bin, low, high, n for every bin: equal widths, the last bin closed; equal values make one bin of width 1."""
    v = F.col(parameter)
    ends = data.groupBy(*keys).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi")).filter("_lo is not null")
    flat = F.col("_lo") == F.col("_hi")
    ends = ends.withColumns({"_n": F.when(flat, 1).otherwise(bins), "_w": F.when(flat, 1.0).otherwise((F.col("_hi") - F.col("_lo")) / bins)})
    ends = ends.withColumn("_lo", F.when(flat, F.col("_lo") - 0.5).otherwise(F.col("_lo")))
    rows = data.join(ends, list(keys)) if keys else data.crossJoin(F.broadcast(ends))  # one row
    b = F.least(F.floor((v - F.col("_lo")) / F.col("_w")), F.col("_n") - 1).cast("int")
    counts = rows.filter(v.isNotNull()).groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    every = ends.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return every.join(counts, [*keys, "bin"], "left").select(*keys, "bin", (F.col("_lo") + F.col("bin") * F.col("_w")).alias("low"), (F.col("_lo") + (F.col("bin") + 1) * F.col("_w")).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def points2d(data: DataFrame, x: str, y: str, filters: dict[str, str] | None = None) -> DataFrame:
    return filtered(data, filters or {}).select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))


def k_anonymous(data: DataFrame, keys: list[str], speaker: str, least: int) -> DataFrame:
    """Cells and whether each has at least ``least`` distinct speakers."""
    return data.groupBy(*keys).agg(F.countDistinct(speaker).alias("n_speakers")).withColumn("ok", F.col("n_speakers") >= least)

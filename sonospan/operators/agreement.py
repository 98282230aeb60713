"""Inter-annotator agreement: matching, kappa, boundary and frame metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sonospan.operators.matching import match_intervals, match_points
from sonospan.operators.sweep import frame_pairs

NO_LABEL = "␀none"


def kappa(po: Column, pe: Column, n: Column) -> Column:
    """Cohen's kappa from observed and chance agreement: 0 without pairs; where chance is certain, 1 if all agree, else 0."""
    certain = F.abs(1 - pe) < 1e-12
    return F.when(n == 0, 0.0).when(certain, F.when(F.abs(1 - po) < 1e-12, 1.0).otherwise(0.0)).otherwise((po - pe) / (1 - pe))


def cohen_kappa(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", weight: str | None = None) -> DataFrame:
    """n, percent_agreement and kappa by ``keys``; a row counts ``weight`` times.

    Each pair adds to the margins of its two labels, so one aggregation by label
    and one by key give all counts: nothing is joined.
    """
    n = F.col(weight) if weight else F.lit(1)
    x, y = F.coalesce(F.col(a), F.lit(NO_LABEL)), F.coalesce(F.col(b), F.lit(NO_LABEL))
    side = lambda label, of_a, of_b, same: F.struct(label.alias("label"), of_a.alias("of_a"), of_b.alias("of_b"), same.alias("same"))
    none = F.lit(0).cast("long")
    margins = pairs.select(*keys, F.explode(F.array(side(x, n.cast("long"), none, F.when(x == y, n).otherwise(0).cast("long")), side(y, none, n.cast("long"), none))).alias("m")).select(*keys, "m.*")
    by_label = margins.groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in ("of_a", "of_b", "same")])
    rows = by_label.groupBy(*keys).agg(F.sum("of_a").alias("n"), F.sum("same").alias("same"), F.sum(F.col("of_a") * F.col("of_b")).alias("chance"))
    po, pe = F.col("same") / F.col("n"), F.coalesce(F.col("chance"), F.lit(0)) / (F.col("n") * F.col("n"))
    return rows.select(*keys, "n", po.alias("percent_agreement"), kappa(po, pe, F.col("n")).alias("kappa"))


def deviations(matched: DataFrame, keys: list[str], deviation: str, tolerance: float) -> DataFrame:
    """Mean absolute deviation and the fraction within tolerance."""
    d = F.abs(F.col(deviation))
    return matched.groupBy(*keys).agg(F.coalesce(F.avg(d), F.lit(0.0)).alias("mean_abs_diff"), F.coalesce(F.avg((d <= tolerance).cast("double")), F.lit(0.0)).alias("within_tolerance"))


def frame_agreement(a: DataFrame, b: DataFrame, step: float = 0.01) -> DataFrame:
    """Frame percent agreement and kappa by bundle, on centres (k + 0.5) * step up to the last end of either side."""
    return cohen_kappa(frame_pairs(a, b, step), ["bundle_id"], weight="n")


def compare_intervals(a: DataFrame, b: DataFrame, tolerance: float = 0.02, step: float = 0.01) -> DataFrame:
    """The agreement report of two interval tiers by bundle."""
    matched = match_intervals(a, b)
    both = matched.withColumn("d", F.explode(F.array(F.col("a_start") - F.col("b_start"), F.col("a_end") - F.col("b_end"))))
    counts = a.groupBy("bundle_id").agg(F.count("*").alias("n_a")).join(b.groupBy("bundle_id").agg(F.count("*").alias("n_b")), "bundle_id", "full_outer")
    units = cohen_kappa(matched, ["bundle_id"], "a_label", "b_label").withColumnsRenamed({"n": "n_matched", "percent_agreement": "percent_label_agreement", "kappa": "cohen_kappa"})
    frames = frame_agreement(a, b, step).select("bundle_id", F.col("percent_agreement").alias("frame_percent_agreement"), F.col("kappa").alias("frame_kappa"))
    out = counts.join(units, "bundle_id", "left").join(deviations(both, ["bundle_id"], "d", tolerance), "bundle_id", "left").join(frames, "bundle_id", "left").na.fill(0)
    return out.withColumns({"n_only_a": F.col("n_a") - F.col("n_matched"), "n_only_b": F.col("n_b") - F.col("n_matched")})


def compare_points(a: DataFrame, b: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """The agreement report of two point tiers (bundle_id, id, t, label) by bundle."""
    matched = match_points(a, b)
    counts = a.groupBy("bundle_id").agg(F.count("*").alias("n_a")).join(b.groupBy("bundle_id").agg(F.count("*").alias("n_b")), "bundle_id", "full_outer")
    units = cohen_kappa(matched, ["bundle_id"], "a_label", "b_label").withColumnsRenamed({"n": "n_matched", "percent_agreement": "percent_label_agreement", "kappa": "cohen_kappa"})
    moved = deviations(matched.withColumn("d", F.col("a_t") - F.col("b_t")), ["bundle_id"], "d", tolerance)
    out = counts.join(units, "bundle_id", "left").join(moved, "bundle_id", "left").na.fill(0)
    return out.withColumns({"n_only_a": F.col("n_a") - F.col("n_matched"), "n_only_b": F.col("n_b") - F.col("n_matched")})


def annotator_pairs(tiers: DataFrame, base: str) -> DataFrame:
    """Pairs (a < b) of tiers named "<base> [annotator]" in each bundle."""
    own = tiers.withColumn("annotator", F.regexp_extract("name", r"^(.*) \[([^\]]*)\]$", 2)).filter(F.regexp_extract("name", r"^(.*) \[([^\]]*)\]$", 1) == base)
    x, y = (own.select("bundle_id", F.col("annotator").alias(c), F.col("id").alias(f"tier_{c}")) for c in "ab")
    return x.join(y, "bundle_id").filter("a < b")

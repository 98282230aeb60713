"""Annotation campaigns: progress, quality checks, vocabularies, rubric impact and assignment."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan.operators.intervals import overlap_pairs


def progress(rows: DataFrame, statuses: list[str], keys: list[str] = (), status: str = "status") -> DataFrame:
    """Counts by status side by side, and their total."""
    return rows.groupBy(*keys).agg(*[F.count_if(F.col(status) == s).alias(f"n_{s}") for s in statuses], F.count("*").alias("total"))


def next_target(targets: DataFrame, statuses: list[str], key: str = "bundle_id") -> DataFrame:
    """First target of each bundle, by (start, id), in one of the statuses; a minimum, not a sort."""
    names = [c for c in targets.columns if c not in (key, "start", "id")]
    first = F.min(F.struct("start", "id", *names)).alias("first")
    return targets.filter(F.col("status").isin(*statuses)).groupBy(key).agg(first).select(key, "first.*")


def label_check(rows: DataFrame, vocabulary: DataFrame, label: str = "label") -> DataFrame:
    """``rows`` with ``in_vocabulary``; empty and null labels are, and so is everything where a tier has no vocabulary."""
    words = vocabulary.select(F.col("tier").alias("_tier"), F.col("value").alias("_value")).distinct()
    has = words.groupBy(F.col("_tier").alias("tier")).agg(F.lit(True).alias("_has"))
    out = rows.join(has, "tier", "left").join(words, (F.col("tier") == F.col("_tier")) & (F.col(label) == F.col("_value")), "left").drop("_tier")
    empty = F.coalesce(F.col(label), F.lit("")) == ""
    return out.withColumn("in_vocabulary", F.col("_has").isNull() | empty | F.col("_value").isNotNull()).drop("_has", "_value")


def tier_qa(tier: DataFrame, vocabulary: list[str], keys: list[str]) -> DataFrame:
    """n, out_of_vocab, missing_label and overlapping pairs by ``keys``."""
    missing = F.coalesce("label", F.lit("")) == ""
    out = ~missing & ~F.col("label").isin(*vocabulary) if vocabulary else F.lit(False)
    counts = tier.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(out).alias("out_of_vocab"), F.count_if(missing).alias("missing_label"))
    return counts.join(overlap_pairs(tier, keys), keys)


def rubric_impact(before: DataFrame, after: DataFrame, annotations: DataFrame) -> DataFrame:
    """Tiers whose vocabulary changed: values added and removed, and annotations whose label was removed.

    ``before`` and ``after``: tier, value.  ``annotations``: tier, label.
    """
    a, b = (v.groupBy("tier").agg(F.sort_array(F.collect_set("value")).alias(n)) for v, n in ((before, "old"), (after, "new")))
    none = F.array().cast("array<string>")
    both = a.join(b, "tier", "full_outer").withColumns({"old": F.coalesce("old", none), "new": F.coalesce("new", none)})
    both = both.select("tier", F.array_except("new", "old").alias("added"), F.array_except("old", "new").alias("removed")).filter("size(added) > 0 or size(removed) > 0")
    gone = both.select("tier", F.explode("removed").alias("label"))
    hit = annotations.join(gone, ["tier", "label"], "left_semi").groupBy("tier").agg(F.count("*").alias("affected"))
    return both.join(hit, "tier", "left").withColumn("affected", F.coalesce("affected", F.lit(0).cast("long")))


def citations(runs: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Processors of each bundle that have a citation, in the order of their first run."""
    first = runs.groupBy(*keys, "processor").agg(F.min("id").alias("first_run"))
    return first.join(known, "processor").withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy("first_run"))).withColumn("weblink", F.coalesce("url", F.concat(F.lit("https://doi.org/"), F.col("doi"))))


def shuffled(items: list, seed: int) -> list:
    """A seeded permutation: splitmix64 words, Fisher-Yates from the end, bounded by the high half of a 128-bit product."""
    out, state, mask = list(items), seed & (1 << 64) - 1, (1 << 64) - 1
    for i in range(len(out) - 1, 0, -1):
        state = (state + 0x9E3779B97F4A7C15) & mask
        z = state
        z = (z ^ z >> 30) * 0xBF58476D1CE4E5B9 & mask
        z = (z ^ z >> 27) * 0x94D049BB133111EB & mask
        z ^= z >> 31
        j = z * (i + 1) >> 64
        out[i], out[j] = out[j], out[i]
    return out


def assign_randomly(targets: DataFrame, annotators: list[str], seed: int) -> DataFrame:
    """Unassigned targets of each bundle in time order, shuffled by the seed and dealt round robin."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = lru_cache(1000)(lambda n: np.array(shuffled(range(n), seed)))  # the order hangs on the number of targets only
        for batch in batches:
            lists = batch.column(1)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            firsts = np.cumsum(sizes) - sizes
            take = np.concatenate([a + places(int(n)) for a, n in zip(firsts, sizes, strict=True)]) if len(sizes) else np.zeros(0, dtype=int)
            k = np.arange(len(take)) - np.repeat(firsts, sizes)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(sizes)), sizes))), lists.flatten().take(pa.array(take)), pa.array(annotators).take(pa.array(k % len(annotators)))], ["bundle_id", "target_id", "annotator"])

    ids = F.transform(F.array_sort(F.collect_list(F.struct("start", "id"))), lambda x: x["id"])
    rows = targets.filter("status = 'unassigned'").select(F.col("bundle_id").cast("long").alias("bundle_id"), F.col("id").cast("long").alias("id"), "start")
    return rows.groupBy("bundle_id").agg(ids.alias("ids")).mapInArrow(deal, "bundle_id long, target_id long, annotator string")


def spl(db_fs: Column, reference_spl_db: Column, reference_db_fs: Column) -> Column:
    """Calibrated level; null where the recording has no calibration."""
    return db_fs + (reference_spl_db - reference_db_fs)

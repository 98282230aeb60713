"""Annotator packages: the part of a corpus that one annotator works on, out and back in."""

from __future__ import annotations

from pyspark.sql import functions as F

from sonospan.store import ANNOTATIONS, Corpus, StoreError
from sonospan.workflow import copy_tiers


def export_package(corpus: Corpus, annotator: str, root: str) -> Corpus:
    """A corpus of the bundles with an assignment of ``annotator``: their sparse tiers, targets, assignments and the rubric.  Ids stay."""
    out = Corpus(corpus.spark, root, annotator, corpus.clock)
    own = corpus.table("assignment").filter(F.col("annotator") == annotator)
    targets = corpus.table("target").join(own.select(F.col("target_id").alias("id")), "id", "left_semi")
    bundles = corpus.table("bundle").join(targets.select(F.col("bundle_id").alias("id")), "id", "left_semi")
    if bundles.isEmpty():
        raise StoreError(f"{annotator} has no assignment")
    tiers = corpus.table("tier").filter(F.col("type").isin("interval", "point", "reference")).join(bundles.select(F.col("id").alias("bundle_id")), "bundle_id", "left_semi")
    parts = {"bundle": bundles, "tier": tiers, "target": targets, "assignment": own} | {n: corpus.table(n) for n in ("rubric", "rubric_status", "rubric_tier", "vocabulary")}
    parts |= {n: corpus.table(n).join(tiers.select(F.col("id").alias("tier_id")), "tier_id", "left_semi") for n in ANNOTATIONS}
    out.commit([(name, "insert", rows) for name, rows in parts.items()])
    return out


def import_package(corpus: Corpus, package: Corpus, annotator: str) -> dict[str, int]:
    """Land a package's annotations on tiers "<name> [annotator]" of the bundles with the same names, parents included; what was there goes; the assignments are done."""
    ours = corpus.table("bundle").select(F.col("id").alias("to_bundle"), "name")
    pairs = corpus.staged(package.table("bundle").select(F.col("id").alias("from_bundle"), "name").join(ours, "name").select("from_bundle", "to_bundle"))
    landed = package.table("tier").join(pairs.withColumnRenamed("from_bundle", "bundle_id"), "bundle_id").select(F.col("to_bundle").alias("bundle_id"), F.concat("name", F.lit(f" [{annotator}]")).alias("name"))
    corpus.delete("tier", corpus.table("tier").join(landed, ["bundle_id", "name"], "left_semi").select("id"))
    counts = copy_tiers(package, corpus, pairs, f" [{annotator}]")
    corpus.update("assignment", F.col("annotator") == annotator, {"status": F.lit("done")})
    return {"bundles": pairs.count(), **counts}

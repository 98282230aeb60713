"""Workflow of a corpus, over many bundles at once: imports, rule runs, proposals, targets, comparisons, rubric, notebook, provenance.

Every operation is joins and aggregates over the corpus's tables and one commit;
rows never pass the driver.  Where the model speaks of one bundle, a frame of
bundle ids picks them.
"""

from __future__ import annotations

import hashlib
import json
from collections import namedtuple
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sonospan import signals
from sonospan.checkpoints import settled
from sonospan.operators import agreement
from sonospan.plans import expr, rules
from sonospan.store import Corpus, StoreError

SPARSE = ("interval", "point", "reference")


# ---- imports and exports


OPTIONAL = {"position": "int", "parent": "string", "extra": "string", "note": "string", "annotation": "string", "ref": "string"}


def import_tiers(corpus: Corpus, rows: DataFrame, processor: str, parameters: Column | None = None) -> int:
    """Land parsed annotations as new tiers with a processing run for each bundle; returns the number of tiers.

    ``rows``: bundle_id, tier, kind, start, end, label, and where known position,
    parent (a tier's name), extra, note, annotation and ref.  ``annotation`` is a
    document's name of a row and ``ref`` that of the row it hangs on: ids are given
    first, then one join puts stored ids for names, whatever the order or depth.  A
    ``ref`` that no row has is left out.  What a reference's label carries (see
    ``columns.reference_payload``) becomes its target; a target in the same document
    gets its new id.  Parent tiers keep their link; a tier with links has
    cardinality "one_to_many", others "none".
    """
    from sonospan.functions.columns import decode_label, reference_payload

    have = set(rows.columns)
    full = rows.select("bundle_id", "tier", "kind", "start", "end", "label", *[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in OPTIONAL.items()])
    if "annotation" in have:  # labels as documents keep them
        full = full.withColumn("_l", decode_label(F.col("label"))).withColumns({"label": F.col("_l.label"), "extra": F.coalesce("extra", "_l.extra")}).drop("_l")
    full = corpus.staged(full)
    runs = corpus.numbered("processing_run", full.select("bundle_id").distinct().select("bundle_id", F.lit("import").alias("kind"), F.lit(processor).alias("processor_id"), (parameters if parameters is not None else F.lit(None)).cast("string").alias("parameters"), F.lit("done").alias("status"), F.lit(None).cast("long").alias("recipe_run_id")))
    runs = corpus.staged(runs)
    linked = F.max(F.col("ref").isNotNull()).alias("linked")
    named = corpus.numbered("tier", full.groupBy("bundle_id", F.col("tier").alias("name")).agg(F.max("kind").alias("type"), F.max("parent").alias("parent"), linked))
    named = corpus.staged(named)
    parents = named.select("bundle_id", F.col("name").alias("parent"), F.col("id").alias("parent_id"))
    cardinality = F.when(F.col("linked") & F.col("parent_id").isNotNull(), "one_to_many").otherwise("none")
    tiers = named.join(parents, ["bundle_id", "parent"], "left").select("id", "bundle_id", "name", "type", "parent_id", cardinality.alias("cardinality"), F.lit(None).cast("string").alias("extra"))
    corpus._checked("tier", tiers)
    ids = named.select("bundle_id", F.col("name").alias("tier"), F.col("id").alias("tier_id")).join(runs.select("bundle_id", F.col("id").alias("processing_run_id")), "bundle_id")
    placed = full.join(ids, ["bundle_id", "tier"]).withColumnsRenamed({"start": "start_seconds", "end": "end_seconds"}).withColumn("status", F.lit(None).cast("string"))
    made = {kind: corpus.numbered(f"annotation_{kind}", placed.filter(F.col("kind") == kind)) for kind in SPARSE}
    if "annotation" in have:
        made = {kind: corpus.staged(part) for kind, part in made.items()}
    known: DataFrame | None = None
    for kind, part in made.items():
        part = part.filter("annotation is not null").select("bundle_id", F.lit(kind).alias("_kind"), F.col("annotation").alias("_name"), F.col("id").alias("_id"))
        known = part if known is None else known.unionByName(part)

    def link(part: DataFrame, name: str, to: str) -> DataFrame:
        """The stored id of the row that the document calls ``name``."""
        if "annotation" not in have:
            return part.withColumn(to, F.lit(None).cast("long"))
        return part.join(known.select("bundle_id", F.col("_name").alias(name), F.col("_id").alias(to), F.col("_kind").alias(f"{to}_kind")), ["bundle_id", name], "left")

    intervals, points, references = (link(made[kind], "ref", "parent_annotation_id") for kind in SPARSE)
    carried = references.withColumn("_p", reference_payload(F.col("extra"))).withColumns({"target": F.col("_p.target"), "extra": F.col("_p.extra"), "parent_annotation_id": F.when(~F.col("_p.placeholder"), F.col("parent_annotation_id"))})
    pointed = link(carried, "target", "_target_id").withColumns({"target_kind": F.col("_p.target_kind"), "target_id": F.coalesce("_target_id", "_p.target_id")})
    points = points.withColumnRenamed("start_seconds", "time_seconds")
    corpus.commit([("processing_run", "insert", runs), ("tier", "insert", tiers), ("annotation_interval", "insert", intervals), ("annotation_point", "insert", points), ("annotation_reference", "insert", pointed)])
    return named.count()


def export_rows(corpus: Corpus, tier_names: list[str] | None = None) -> DataFrame:
    """Annotations of the sparse tiers in the columns of the tabular format; dense tiers are skipped."""
    from sonospan.sources.readers import CSV_COLUMNS, CSV_SCHEMA

    tiers = corpus.table("tier").filter(F.col("type").isin(*SPARSE)).select(F.col("id").alias("tier_id"), "bundle_id", F.col("name").alias("tier_name"), F.col("type").alias("tier_type"))
    tiers = tiers if tier_names is None else tiers.filter(F.col("tier_name").isin(*tier_names))
    tiers = tiers.join(corpus.table("bundle").select(F.col("id").alias("bundle_id"), F.col("name").alias("bundle_name")), "bundle_id")
    typed = {c.split()[0]: c.split()[1] for c in CSV_SCHEMA.split(", ")}
    out: DataFrame | None = None
    for kind in SPARSE:
        rows = corpus.table(f"annotation_{kind}").withColumnRenamed("id", "annotation_id").join(tiers.filter(F.col("tier_type") == kind), "tier_id")
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(typed[c]).alias(c) for c in CSV_COLUMNS])
        out = rows if out is None else out.unionByName(rows)
    return out


def export_textgrids(corpus: Corpus, durations: DataFrame, tier_names: list[str] | None = None) -> DataFrame:
    """(bundle_id, text): a TextGrid of each bundle's interval and point tiers, gaps filled; an overlap is an error."""
    from sonospan.functions.columns import encode_label
    from sonospan.sources.readers import write_textgrids

    rows = export_rows(corpus, tier_names).filter("tier_type <> 'reference'")
    rows = rows.select("bundle_id", "tier_id", F.col("tier_name").alias("tier"), F.col("tier_type").alias("kind"), F.coalesce("start_seconds", "time_seconds").alias("start"), F.coalesce("end_seconds", "time_seconds").alias("end"), encode_label(F.coalesce("label", F.lit("")), F.col("extra")).alias("label"))
    return write_textgrids(rows, durations)


def export_eafs(corpus: Corpus, tier_names: list[str] | None = None) -> DataFrame:
    """(bundle_id, text): an ELAN document of each bundle's sparse tiers, with the tiers' hierarchy and what references hang on.

    A reference without a parent annotation hangs on the first one of its parent
    tier, as the format wants one, and its label says so; its label also carries its
    target, by the document's name where the target is in the document.
    """
    import pyarrow as pa

    from sonospan.sources import formats

    tiers = corpus.table("tier")
    parents = tiers.select("bundle_id", F.col("name").alias("tier_name"), "parent_id").join(tiers.select(F.col("id").alias("parent_id"), F.col("name").alias("parent"), F.col("type").alias("parent_type")), "parent_id", "left").drop("parent_id")
    rows = export_rows(corpus, tier_names).join(parents, ["bundle_id", "tier_name"], "left")
    start, end = F.coalesce("start_seconds", "time_seconds"), F.coalesce("end_seconds", "time_seconds")
    rows = rows.select("bundle_id", "tier_id", "tier_name", "tier_type", "parent", "parent_type", "annotation_id", start.alias("start"), end.alias("end"), F.coalesce("label", F.lit("")).alias("label"), "extra", "parent_annotation_id", "target_kind", "target_id")

    columns, tell = rows.columns, json.JSONEncoder(separators=(",", ":")).encode
    Row = namedtuple("Row", columns)

    def write(table: pa.Table) -> pa.Table:
        last = lambda x: (x is None, x or 0.0)
        found = [Row(*values) for values in zip(*(table[c].to_pylist() for c in columns), strict=True)]
        found.sort(key=lambda r: (r.tier_id, last(r.start), last(r.end), r.annotation_id))
        name = {(r.tier_type, r.annotation_id): f"a{n}" for n, r in enumerate(found, 1)}
        first: dict[str, str] = {}
        for r in found:
            if r.tier_name not in first:
                first[r.tier_name] = name[r.tier_type, r.annotation_id]
        made = []
        for _, part in groupby(found, key=lambda r: r.tier_id):
            rows, part = [], list(part)
            for r in part:
                if r.tier_type != "reference":
                    rows.append((r.start, r.end, formats.encode_label(r.label, r.extra)))
                    continue
                own = name.get((r.parent_type, r.parent_annotation_id)) if r.parent_annotation_id is not None else None
                told = {"target_kind": r.target_kind, "target_id": r.target_id if r.target_id is not None else 0}
                if (r.target_kind, r.target_id) in name:
                    told["target"] = name[r.target_kind, r.target_id]
                if own is None:
                    told["placeholder"] = True
                payload = tell(told)
                if r.extra is not None:
                    payload = f'{payload[:-1]},"extra":{r.extra}}}'
                rows.append((None, None, formats.encode_label(r.label, payload), own or first.get(r.parent, "")))
            made.append((part[0].tier_name, part[0].parent, rows))
        return pa.table({"bundle_id": table["bundle_id"][:1], "text": pa.array([formats.write_eaf(made)])})

    return rows.groupBy("bundle_id").applyInArrow(write, "bundle_id long, text string")


def export_json(corpus: Corpus, tier_names: list[str] | None = None) -> DataFrame:
    """(bundle_id, json): the structured document of each bundle's sparse tiers."""
    from sonospan.sources.readers import tiers_json

    return tiers_json(export_rows(corpus, tier_names), corpus.table("bundle").select(F.col("id").alias("bundle_id"), "name", "sample_rate", "n_frames"))


def import_json(corpus: Corpus, documents: DataFrame, processor: str = "import:json") -> int:
    """New tiers of bundles from structured documents (bundle_id, json)."""
    from sonospan.sources.readers import parsed_json

    return import_tiers(corpus, parsed_json(documents), processor)


def parents_first(tiers: DataFrame) -> DataFrame:
    """``tiers`` (id, parent_id and others) with ``level``: 0 for roots, a child one more than its parent.

    Every row knows an ancestor and how far it is; a round doubles that distance by
    one join, so a forest of depth d takes log d rounds.  Missing parents and rows
    that are their own ancestors are errors, and told apart.
    """
    rows = tiers.select("id", F.col("parent_id").alias("up"), F.col("parent_id").isNotNull().cast("int").alias("level"))
    if not rows.filter("up is not null").select(F.col("up").alias("id")).join(rows, "id", "left_anti").isEmpty():
        raise StoreError("a tier has a missing parent")
    rows = settled(rows)
    rounds, most = 0, max(1, rows.count()).bit_length() + 1
    while not rows.filter("up is not null").isEmpty():
        rounds += 1
        if rounds > most:  # longer than any path without a repeat
            raise StoreError("a tier is its own ancestor")
        above = rows.select(F.col("id").alias("up"), F.col("up").alias("next"), F.col("level").alias("more"))
        going = rows.filter("up is not null").join(above, "up").select("id", F.col("next").alias("up"), (F.col("level") + F.col("more")).alias("level"))
        rows = settled(rows.filter("up is null").unionByName(going))
    return tiers.join(rows.select("id", "level"), "id")


def copy_tiers(source: Corpus, target: Corpus, pairs: DataFrame, suffix: str = "") -> dict[str, int]:
    """Copy the sparse tiers of bundles (from_bundle, to_bundle) with their annotations under new ids; parents of tiers and annotations follow."""
    old = source.table("tier").filter(F.col("type").isin(*SPARSE)).join(pairs.select(F.col("from_bundle").alias("bundle_id"), "to_bundle"), "bundle_id")
    new = target.staged(target.numbered("tier", old.select(F.col("id").alias("old_id"), F.col("to_bundle").alias("bundle_id"), F.concat("name", F.lit(suffix)).alias("name"), "type", F.col("parent_id").alias("old_parent"), "cardinality", "extra")))
    ids = new.select(F.col("old_id").alias("old_parent"), F.col("id").alias("parent_id"))
    tiers = new.join(ids, "old_parent", "left")
    target._checked("tier", tiers.select("id", "bundle_id", "name", "type", "parent_id", "cardinality", "extra"))
    of_tier = new.select(F.col("old_id").alias("old_tier"), F.col("id").alias("tier_id"))
    changes, made, moved = [("tier", "insert", tiers)], {}, None
    for kind in SPARSE:
        rows = source.table(f"annotation_{kind}").withColumnsRenamed({"id": "old_id", "tier_id": "old_tier", "parent_annotation_id": "old_parent_annotation"}).join(of_tier, "old_tier")
        made[kind] = target.staged(target.numbered(f"annotation_{kind}", rows))
        if kind != "reference":
            part = made[kind].select(F.lit(kind).alias("kind"), F.col("old_id").alias("old_parent_annotation"), F.col("id").alias("parent_annotation_id"))
            moved = part if moved is None else moved.unionByName(part)
    kinds = new.select(F.col("id").alias("_tier"), F.col("type").alias("kind"))
    parent_kind = tiers.select(F.col("id").alias("tier_id"), F.col("parent_id").alias("_tier")).join(kinds, "_tier", "left").select("tier_id", "kind")
    for kind, rows in made.items():
        rows = rows.join(parent_kind, "tier_id", "left").join(moved, ["kind", "old_parent_annotation"], "left")
        changes.append((f"annotation_{kind}", "insert", rows))
    target.commit(changes)
    return {"tiers": new.count(), "annotations": sum(r.count() for r in made.values())}


# ---- rules, proposals, targets


def set_criterion(corpus: Corpus, name: str, body: dict | str, target_tier: str, kind: str = "structured", description: str | None = None) -> int:
    """Upsert by name; the body's JSON is read, its expressions are compiled when it runs."""
    body = body if isinstance(body, str) else json.dumps(body)
    if kind == "structured":
        json.loads(body)
    old = corpus.table("criterion").filter(F.col("name") == name).first()
    row = {"name": name, "description": description, "kind": kind, "body": body, "target_tier": target_tier}
    if old is None:
        return corpus.add("criterion", [row])[0]
    corpus.replace("criterion", corpus.frame("criterion", [row | {"id": old["id"]}]))
    return old["id"]


def rule_signals(corpus: Corpus, rule: rules.Rule, tiers: DataFrame, computed: dict[str, DataFrame] | None = None) -> DataFrame | None:
    """The signals that a rule names: given ones, ``f0`` and ``intensity`` from the audio that its matches touch, and dense tiers."""
    names = rule.referenced_signals()
    if not names:
        return None
    computed = dict(computed or {})
    for name in set(names) & set(signals.BUILT_IN) - set(computed):
        whole = any(r.scope == "file" for n in [*rule.anchors(), *([rule.where] if rule.where else [])] for r in expr.reductions(n) if r.signal == name)
        computed[name] = signals.computed(corpus, name, rules.select_rois(rule, tiers), whole)
    return signal_set(corpus, names, computed)


def signal_set(corpus: Corpus, wanted: list[str], computed: dict[str, DataFrame] | None = None) -> DataFrame:
    """bundle_id, signal, t, v of named signals: computed ones, else dense tiers of one number at i / rate.  An unknown name is an error."""
    computed = computed or {}
    out: DataFrame | None = None
    for name in wanted:
        if name in computed:
            rows = computed[name].select("bundle_id", "t", "v")
        else:
            tiers = corpus.table("tier").filter((F.col("name") == name) & (F.col("type") == "continuous_numeric")).select(F.col("id").alias("tier_id"), "bundle_id")
            found = tiers.join(corpus.table("derived_signal"), "tier_id")
            paths = [r["relative_path"] for r in found.select("relative_path").distinct().collect()]  # one table holds a signal of all bundles
            if not paths:
                raise StoreError(f"no signal {name!r}")
            data = corpus.spark.read.parquet(*[f"{corpus.root}/{p}" for p in paths])
            rows = data.join(found.select("tier_id", "bundle_id", "sample_rate_hz"), "tier_id").select("bundle_id", (F.col("i") / F.col("sample_rate_hz")).alias("t"), F.col("value").alias("v"))
        rows = rows.withColumn("signal", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else corpus.spark.createDataFrame([], "bundle_id long, t double, v double, signal string")


def write_dense_tier(corpus: Corpus, name: str, samples: DataFrame, rate: float, kind: str = "continuous_numeric") -> int:
    """A dense tier for each bundle of ``samples`` (bundle_id, i, value), in one table; written once only.  Returns the number of tiers.

    Values must not be null; vectors of one tier have one width; labels are kept
    dictionary-coded by Parquet.
    """
    value = F.coalesce("value", F.raise_error(F.lit("null sample")).cast(samples.schema["value"].dataType))
    samples = corpus.staged(samples.select("bundle_id", "i", value.alias("value")))
    width = F.max(F.size("value")) if kind == "continuous_vector" else F.lit(1)
    each = samples.groupBy("bundle_id").agg(F.count("*").alias("n_frames"), width.alias("n_dims"), (F.min(F.size("value")) if kind == "continuous_vector" else F.lit(1)).alias("least"))
    if not each.filter("n_dims <> least").isEmpty():
        raise StoreError("vectors of several widths")
    tiers = corpus.staged(corpus.numbered("tier", each.select("bundle_id", "n_frames", "n_dims", F.lit(name).alias("name"), F.lit(kind).alias("type"), F.lit(None).cast("long").alias("parent_id"), F.lit(None).cast("string").alias("cardinality"), F.lit(None).cast("string").alias("extra"))))
    corpus._checked("tier", tiers.select("id", "bundle_id", "name", "type", "parent_id", "cardinality", "extra"))
    path = f"_dense/{hashlib.sha256(name.encode()).hexdigest()[:16]}-{corpus.next_id('derived_signal')}"
    keyed = samples.join(tiers.select("bundle_id", F.col("id").alias("tier_id")), "bundle_id").select("tier_id", "i", "value")
    keyed.repartitionByRange("tier_id", "i").sortWithinPartitions("tier_id", "i").write.option("compression", "snappy").parquet(f"{corpus.root}/{path}")
    dtype = {"continuous_numeric": "float64", "continuous_vector": "float64", "categorical_sampled": "utf8"}[kind]
    signals = corpus.numbered("derived_signal", tiers.select(F.col("id").alias("tier_id"), F.lit(path).alias("relative_path"), "n_frames", F.col("n_dims").cast("int").alias("n_dims"), F.lit(float(rate)).alias("sample_rate_hz"), F.lit(dtype).alias("dtype")))
    corpus.commit([("tier", "insert", tiers), ("derived_signal", "insert", signals)])
    return tiers.count()


def read_dense_tier(corpus: Corpus, name: str) -> DataFrame:
    """bundle_id, i, t, value of a dense tier in all bundles."""
    tiers = corpus.table("tier").filter(F.col("name") == name).select(F.col("id").alias("tier_id"), "bundle_id").join(corpus.table("derived_signal"), "tier_id")
    paths = [r["relative_path"] for r in tiers.select("relative_path").distinct().collect()]  # a path for each write
    if not paths:
        raise StoreError(f"no dense tier {name!r}")
    return corpus.spark.read.parquet(*[f"{corpus.root}/{p}" for p in paths]).join(tiers.select("tier_id", "bundle_id", "sample_rate_hz"), "tier_id").select("bundle_id", "i", (F.col("i") / F.col("sample_rate_hz")).alias("t"), "value")


def preview(name: str) -> str:
    return f"{name} (auto)"


def set_proposals(corpus: Corpus, target_tier: str, proposals: DataFrame, bundles: DataFrame) -> int:
    """Replace the preview tier of ``bundles`` (bundle_id) by proposals (bundle_id, start, end, label, processing_run_id), all points or all spans."""
    rows = corpus.staged(proposals.select("bundle_id", "start", "end", "label", F.col("processing_run_id").cast("long").alias("processing_run_id")))
    kinds = {r["point"] for r in rows.select((F.col("start") == F.col("end")).alias("point")).distinct().collect()}  # two rows at most
    if len(kinds) > 1:
        raise StoreError("proposals mix points and spans")
    kind = "point" if kinds == {True} else "interval"
    gone = corpus.staged(corpus.table("tier").filter(F.col("name") == preview(target_tier)).join(bundles, "bundle_id", "left_semi"))
    changes = [(t, op, corpus.staged(r)) for t, op, r in corpus.doomed("tier", gone)]
    n = rows.count()
    if n:
        none = {c: F.lit(None).cast(t) for c, t in (("parent_id", "long"), ("cardinality", "string"), ("extra", "string"))}
        tiers = corpus.staged(corpus.numbered("tier", rows.select("bundle_id").distinct().withColumns({"name": F.lit(preview(target_tier)), "type": F.lit(kind)} | none)))
        made = rows.join(tiers.select("bundle_id", F.col("id").alias("tier_id")), "bundle_id").withColumns({c: F.lit(None).cast(t) for c, t in (("parent_annotation_id", "long"), ("status", "string"), ("note", "string"), ("extra", "string"))})
        made = made.withColumn("time_seconds", F.col("start")) if kind == "point" else made.withColumnsRenamed({"start": "start_seconds", "end": "end_seconds"})
        changes += [("tier", "insert", tiers), (f"annotation_{kind}", "insert", corpus.numbered(f"annotation_{kind}", made))]
    corpus.commit(changes)
    return n


def criterion(corpus: Corpus, criterion_id: int):
    row = corpus.get("criterion", criterion_id)
    if row is None:
        raise StoreError("no such criterion")
    return row, rules.Rule.from_json(row["body"])


def record_criterion_run(corpus: Corpus, criterion_id: int, bundles: DataFrame) -> DataFrame:
    """A processing run for each bundle, with the SHA-256 of the rule's body and the rubric's version: bundle_id, processing_run_id."""
    row = corpus.get("criterion", criterion_id)
    version = corpus.table("rubric").agg(F.max("version")).first()[0]
    parameters = json.dumps({"criterion": row["name"], "body_sha256": hashlib.sha256(row["body"].encode()).hexdigest(), "rubric_version": version})
    runs = record_runs(corpus, bundles.select("bundle_id", F.lit("criterion").alias("kind"), F.lit(f"criterion:{row['name']}").alias("processor_id"), F.lit(parameters).alias("parameters")))
    return runs.select("bundle_id", F.col("id").alias("processing_run_id"))


def run_criterion(corpus: Corpus, criterion_id: int, computed: dict[str, DataFrame] | None = None, bundles: DataFrame | None = None, bucket_seconds: float | None = None) -> int:
    """Evaluate a criterion over bundles (all, unless given) into the preview tier of its target; returns the number of proposals."""
    row, rule = criterion(corpus, criterion_id)
    bundles = bundles if bundles is not None else corpus.table("bundle").select(F.col("id").alias("bundle_id"))
    wanted = [s.tier for s in (rule.select, rule.within, rule.overlaps) if s is not None]
    tiers = corpus.timeline(wanted).join(bundles, "bundle_id", "left_semi").select("bundle_id", "tier", "id", "start", "end", "label")
    found = rules.evaluate(rule, tiers, rule_signals(corpus, rule, tiers, computed), bucket_seconds)
    runs = record_criterion_run(corpus, criterion_id, bundles)
    return set_proposals(corpus, row["target_tier"], found.join(runs, "bundle_id"), bundles)


def accept_proposals(corpus: Corpus, target_tier: str, bundles: DataFrame) -> int:
    """Append the preview rows (times, label, run) to the target tier, which is made where it is missing, then clear the preview."""
    auto = corpus.table("tier").filter(F.col("name") == preview(target_tier)).join(bundles, "bundle_id", "left_semi")
    auto = corpus.staged(auto)
    kinds = [r["type"] for r in auto.select("type").distinct().collect()]
    have = corpus.table("tier").filter(F.col("name") == target_tier).select("bundle_id", F.col("id").alias("target_id"))
    missing = auto.join(have, "bundle_id", "left_anti").select("bundle_id", F.lit(target_tier).alias("name"), "type", *[F.lit(None).cast(t).alias(c) for c, t in (("parent_id", "long"), ("cardinality", "string"), ("extra", "string"))])
    made = corpus.staged(corpus.numbered("tier", missing))
    target = corpus.staged(have.unionByName(made.select("bundle_id", F.col("id").alias("target_id"))))
    changes, n = [("tier", "insert", made)], 0
    move = auto.select(F.col("id").alias("tier_id"), "bundle_id").join(target, "bundle_id")
    for kind in kinds:
        rows = corpus.table(f"annotation_{kind}").join(move, "tier_id").withColumn("tier_id", F.col("target_id")).drop("target_id", "bundle_id", "id")
        rows = corpus.staged(corpus.numbered(f"annotation_{kind}", rows))
        n += rows.count()
        changes.append((f"annotation_{kind}", "insert", rows))
    changes += [(t, op, corpus.staged(r)) for t, op, r in corpus.doomed("tier", auto)]
    corpus.commit(changes)
    return n


def clear_proposals(corpus: Corpus, target_tier: str, bundles: DataFrame) -> int:
    """Delete the preview tier of bundles; returns how many rows went."""
    auto = corpus.staged(corpus.table("tier").filter(F.col("name") == preview(target_tier)).join(bundles, "bundle_id", "left_semi"))
    changes = [(t, op, corpus.staged(r)) for t, op, r in corpus.doomed("tier", auto)]
    n = sum(r.count() for t, _, r in changes if t.startswith("annotation_"))
    corpus.commit(changes)
    return n


def generate_targets(corpus: Corpus, criterion_id: int, computed: dict[str, DataFrame] | None = None, bundles: DataFrame | None = None) -> int:
    """Matched intervals of a criterion become targets; those it made before go, with their assignments."""
    _, rule = criterion(corpus, criterion_id)
    bundles = bundles if bundles is not None else corpus.table("bundle").select(F.col("id").alias("bundle_id"))
    wanted = [s.tier for s in (rule.select, rule.within, rule.overlaps) if s is not None]
    tiers = corpus.timeline(wanted).join(bundles, "bundle_id", "left_semi").select("bundle_id", "tier", "id", "start", "end", "label")
    rois = rules.evaluate(rules.Rule(rule.select, {"kind": "span"}, rule.within, rule.overlaps, rule.where, None), tiers, rule_signals(corpus, rule, tiers, computed))
    made = corpus.numbered("target", rois.select("bundle_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "label", F.lit("unassigned").alias("status"), F.lit(None).cast("string").alias("note"), F.lit(criterion_id).cast("long").alias("criterion_id")))
    made = corpus.staged(made)
    old = corpus.staged(corpus.table("target").filter(F.col("criterion_id") == criterion_id).join(bundles, "bundle_id", "left_semi"))
    corpus.commit([*((t, op, corpus.staged(r)) for t, op, r in corpus.doomed("target", old)), ("target", "insert", made)])
    return made.count()


# ---- agreement


def compare_tiers(corpus: Corpus, a: str, b: str, tolerance: float = 0.02, step: float = 0.01) -> DataFrame:
    """The agreement report of two tiers by name, in every bundle that has both; they must be of one type, intervals or points."""
    tiers = corpus.table("tier").filter(F.col("name").isin(a, b))
    kinds = {r["type"] for r in tiers.select("type").distinct().collect()}  # at most the six types
    if len(kinds) != 1 or not kinds <= {"interval", "point"}:
        raise StoreError("tiers to compare must be of one type, intervals or points")
    both = tiers.groupBy("bundle_id").agg(F.count_distinct("name").alias("n")).filter(F.col("n") == (1 if a == b else 2)).select("bundle_id")
    rows = corpus.timeline([a, b]).join(both, "bundle_id", "left_semi")
    x, y = (rows.filter(F.col("tier") == n).select("bundle_id", "id", "start", "end", F.coalesce("label", F.lit("")).alias("label")) for n in (a, b))
    if kinds == {"interval"}:
        return agreement.compare_intervals(x, y, tolerance, step)
    return agreement.compare_points(*(t.select("bundle_id", "id", F.col("start").alias("t"), "label") for t in (x, y)), tolerance)


def agreement_summary(corpus: Corpus, base: str, tolerance: float = 0.02, step: float = 0.01) -> DataFrame:
    """The reports of all pairs of annotators (a < b) with a tier "<base> [annotator]": annotator_a, annotator_b, bundle_id and the report.

    Units are keyed by bundle and pair, so all pairs are one plan.
    """
    pairs = agreement.annotator_pairs(corpus.table("tier"), base).select(F.struct("bundle_id", "a", "b").alias("key"), "tier_a", "tier_b")
    rows = corpus.timeline().select("tier_id", "id", "start", "end", F.coalesce("label", F.lit("")).alias("label"))
    x, y = (rows.join(pairs.select("key", F.col(f"tier_{s}").alias("tier_id")), "tier_id").select(F.col("key").alias("bundle_id"), "id", "start", "end", "label") for s in "ab")
    report = agreement.compare_intervals(x, y, tolerance, step)
    return report.select("bundle_id.bundle_id", F.col("bundle_id.a").alias("annotator_a"), F.col("bundle_id.b").alias("annotator_b"), *[c for c in report.columns if c != "bundle_id"])


# ---- rubric


def set_vocabulary(corpus: Corpus, entries: DataFrame) -> int:
    """Replace the vocabularies of the tiers named in ``entries`` (tier_name, value); repeated values count once."""
    entries = corpus.staged(entries.select("tier_name", "value").distinct())
    old = corpus.staged(corpus.table("vocabulary").join(entries.select("tier_name").distinct(), "tier_name", "left_semi"))
    corpus.commit([("vocabulary", "delete", old), ("vocabulary", "insert", corpus.numbered("vocabulary", entries))])
    return entries.count()


def set_rubric(corpus: Corpus, name: str, version: int, guidelines: str | None = None) -> None:
    """The one rubric of a corpus."""
    old = corpus.table("rubric").first()
    row = {"name": name, "version": version, "guidelines": guidelines}
    if old is None:
        corpus.add("rubric", [row])
    else:
        corpus.replace("rubric", corpus.frame("rubric", [row | {"id": old["id"]}]))


def set_rubric_tier(corpus: Corpus, tier_name: str, description: str | None = None, closed: bool = False) -> None:
    old = corpus.table("rubric_tier").filter(F.col("tier_name") == tier_name).first()
    row = {"tier_name": tier_name, "description": description, "closed_vocabulary": closed}
    if old is None:
        corpus.add("rubric_tier", [row])
    else:
        corpus.replace("rubric_tier", corpus.frame("rubric_tier", [row | {"id": old["id"]}]))


def set_rubric_statuses(corpus: Corpus, statuses: list[tuple[str, str | None]]) -> None:
    """Replace the statuses (name, description) that annotations may have."""
    first = corpus.next_id("rubric_status")
    new = corpus.frame("rubric_status", [{"id": first + i, "name": n, "description": d} for i, (n, d) in enumerate(dict(statuses).items())])
    corpus.commit([("rubric_status", "delete", corpus.staged(corpus.table("rubric_status"))), ("rubric_status", "insert", new)])


SNAPSHOT = "statuses array<struct<name: string, description: string>>, tiers array<struct<tier_name: string, description: string, closed_vocabulary: boolean>>, vocabulary array<struct<tier_name: string, value: string>>"


def publish_rubric_version(corpus: Corpus, note: str | None = None) -> int:
    """Snapshot statuses, tiers and vocabularies as JSON under the rubric's version; publishing a version again replaces it."""
    version = corpus.table("rubric").agg(F.max("version")).first()[0] or 1
    parts = {"statuses": ("rubric_status", ["name", "description"]), "tiers": ("rubric_tier", ["tier_name", "description", "closed_vocabulary"]), "vocabulary": ("vocabulary", ["tier_name", "value"])}
    one: DataFrame | None = None
    for name, (table, columns) in parts.items():
        packed = corpus.table(table).agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        one = packed if one is None else one.crossJoin(packed)  # one row each
    new = corpus.numbered("rubric_version", one.select(F.lit(version).cast("long").alias("version"), F.lit(note).alias("note"), F.to_json(F.struct(*parts)).alias("snapshot")))
    old = corpus.staged(corpus.table("rubric_version").filter(F.col("version") == version))
    corpus.commit([("rubric_version", "delete", old), ("rubric_version", "insert", corpus.staged(new))])
    return version


def rubric_versions(corpus: Corpus) -> DataFrame:
    """Published versions with their snapshots parsed."""
    rows = corpus.table("rubric_version").withColumn("s", F.from_json("snapshot", SNAPSHOT))
    return rows.select("version", "note", "s.*").orderBy("version")


def rubric_impact(corpus: Corpus, version: int) -> DataFrame:
    """Tiers whose vocabulary differs from a published version: values added and removed, annotations whose label was removed."""
    from sonospan.operators import campaign

    old = rubric_versions(corpus).filter(F.col("version") == version).select(F.explode("vocabulary").alias("v")).select(F.col("v.tier_name").alias("tier"), F.col("v.value").alias("value"))
    new = corpus.table("vocabulary").select(F.col("tier_name").alias("tier"), "value")
    return campaign.rubric_impact(old, new, corpus.timeline().select("tier", "label"))


# ---- notebook and provenance

# Kinds of notebook entries.
ENTRY_KINDS = ("observation", "hypothesis", "question", "decision", "todo")


def add_notebook_entries(corpus: Corpus, rows: DataFrame) -> DataFrame:
    """``rows``: kind, text, and where given measurement, target_type, target_id."""
    if not rows.filter(~F.col("kind").isin(*ENTRY_KINDS)).isEmpty():
        raise StoreError("unknown kind of entry")
    return corpus.append("notebook_entry", rows)


def notebook_entries(corpus: Corpus, target_type: str | None = None) -> DataFrame:
    rows = corpus.table("notebook_entry")
    return (rows if target_type is None else rows.filter(F.col("target_type") == target_type)).orderBy("id")


def promote_to_criterion(corpus: Corpus, entry_id: int, name: str, body: dict | str, target_tier: str, kind: str = "structured") -> int:
    """Upsert a criterion from a notebook entry, whose text describes it, and mark the entry."""
    entry = corpus.get("notebook_entry", entry_id)
    if entry is None:
        raise StoreError("no such entry")
    made = set_criterion(corpus, name, body, target_tier, kind, entry["text"])
    corpus.update("notebook_entry", F.col("id") == entry_id, {"promoted": F.lit(f"criterion:{made}")})
    return made


def promote_to_guidance(corpus: Corpus, entry_id: int, tier_name: str) -> None:
    """Append an entry's text to a rubric tier's description, and mark the entry."""
    entry = corpus.get("notebook_entry", entry_id)
    if entry is None:
        raise StoreError("no such entry")
    if not corpus.update("rubric_tier", F.col("tier_name") == tier_name, {"description": F.concat_ws("\n", "description", F.lit(entry["text"]))}):
        raise StoreError("no such rubric tier")
    corpus.update("notebook_entry", F.col("id") == entry_id, {"promoted": F.lit(f"rubric:{tier_name}")})


def start_recipe(corpus: Corpus, name: str, parameters: dict | None = None) -> int:
    """One recipe is active at a time; runs recorded meanwhile belong to it."""
    if not corpus.table("recipe_run").filter("status = 'running'").isEmpty():
        raise StoreError("a recipe is active")
    return corpus.add("recipe_run", [{"name": name, "parameters": json.dumps(parameters) if parameters is not None else None, "status": "running"}])[0]


def end_recipe(corpus: Corpus, recipe_id: int, status: str = "done", error: str | None = None) -> None:
    if not corpus.update("recipe_run", (F.col("id") == recipe_id) & (F.col("status") == "running"), {"status": F.lit(status), "error_message": F.lit(error)}):
        raise StoreError("no such active recipe")


def record_runs(corpus: Corpus, runs: DataFrame) -> DataFrame:
    """Append processing runs (bundle_id, kind, processor_id, parameters); they get the active recipe's id."""
    active = corpus.table("recipe_run").filter("status = 'running'").first()
    rows = runs.select("bundle_id", "kind", "processor_id", "parameters", F.lit("done").alias("status"), F.lit(active["id"] if active else None).cast("long").alias("recipe_run_id"))
    made = corpus.staged(corpus.numbered("processing_run", rows))
    corpus.commit([("processing_run", "insert", made)])
    return made


def runs_of_recipe(corpus: Corpus, recipe_id: int) -> DataFrame:
    return corpus.table("processing_run").filter(F.col("recipe_run_id") == recipe_id).orderBy("id")


def render_scripts(corpus: Corpus) -> DataFrame:
    """(recipe, script): a runnable script of each recipe's runs, in order."""
    line = F.concat(F.lit("run("), F.to_json(F.struct("processor_id", "bundle_id", "parameters")), F.lit(")"))
    runs = corpus.table("processing_run").filter("recipe_run_id is not null").groupBy(F.col("recipe_run_id").alias("id")).agg(F.sort_array(F.collect_list(F.struct("id", line.alias("line")))).alias("lines"))
    recipes = corpus.table("recipe_run").select("id", F.col("name").alias("recipe"))
    body = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return recipes.join(runs, "id").select("recipe", F.concat(F.lit("# recipe: "), "recipe", F.lit(f"\ncorpus = {corpus.root!r}\n"), body, F.lit("\n")).alias("script"))


def pin_refdist(corpus: Corpus, name: str, version: str) -> None:
    old = corpus.table("refdist_pin").filter(F.col("refdist") == name).first()
    if old is None:
        corpus.add("refdist_pin", [{"refdist": name, "version": version}])
    else:
        corpus.update("refdist_pin", F.col("refdist") == name, {"version": F.lit(version)})


def remove_refdist_pin(corpus: Corpus, name: str) -> bool:
    return corpus.delete("refdist_pin", F.col("refdist") == name) > 0


# ---- audio and alignments


def encoded(batches, floats: bool):
    """Recordings as WAV content, one at a time; samples stay in arrays, since as Python's numbers they would take several times their size."""
    import numpy as np
    import pyarrow as pa

    from sonospan.sources import formats

    for batch in batches:
        for i in range(batch.num_rows):
            name, rate, channels = (batch.column(k)[i].as_py() for k in range(3))
            samples = batch.column(3)[i].values
            if samples is None or not len(samples):
                raise ValueError(f"recording {name!r} has no frames")
            own = samples.to_numpy(zero_copy_only=False)
            content = formats.encode_wav(own if floats and own.dtype == np.float32 else np.asarray(own, dtype=float), rate, channels, floats)
            cols = [pa.array([name], pa.string()), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.array([len(own) // channels], pa.int64()), pa.array([content], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["name", "sample_rate", "channels", "n_frames", "content"])


def add_recordings(corpus: Corpus, audio: DataFrame, session_id: int | None = None, speaker_id: int | None = None, floats: bool = False) -> int:
    """Bundles of recordings (name, sample_rate, channels, samples interleaved in [-1, 1]), their WAV content kept in the corpus, in 16 bits or as ``floats``; no frames are an error."""
    made = audio.select("name", "sample_rate", "channels", "samples").mapInArrow(lambda it: encoded(it, floats), "name string, sample_rate int, channels int, n_frames long, content binary")
    rows = corpus.staged(corpus.numbered("bundle", made))
    bundles = rows.select("id", "name", F.concat(F.lit("audio/"), "id", F.lit(".wav")).alias("audio_relative_path"), "sample_rate", "channels", "n_frames", F.lit(session_id).cast("long").alias("session_id"), F.lit(speaker_id).cast("long").alias("speaker_id"), F.lit(None).cast("string").alias("extra"))
    contents = corpus.numbered("audio", rows.select(F.col("id").alias("bundle_id"), "content", F.lit(0).cast("long").alias("first_frame")))
    corpus._checked("bundle", bundles)
    corpus.commit([("bundle", "insert", bundles), ("audio", "insert", contents)])
    return rows.count()


def add_split(corpus: Corpus, audio: DataFrame, seconds: float) -> int:
    """Recordings cut into bundles "<name>_NNN" of ``seconds``, 0.1 at least; the last may be short."""
    from sonospan.sources.readers import split_chunks

    pieces = split_chunks(audio, seconds, "name")
    return add_recordings(corpus, pieces.withColumn("name", F.concat("name", F.lit("_"), F.lpad((F.col("chunk") + 1).cast("string"), 3, "0"))).drop("chunk"))


#: Samples of recordings that travel together.
AUDIO_SAMPLES = 1 << 18


def load_audio(corpus: Corpus, bundles: DataFrame | None = None) -> DataFrame:
    """bundle_id, sample_rate, channels, samples and first_frame of the corpus's recordings; live ones come in parts, a row for each."""
    import numpy as np
    import pyarrow as pa

    from sonospan.sources import formats

    def decode(batches):
        for batch in batches:
            held, samples, n = [], [], 0
            for bundle, content, first in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rate, channels, x = formats.decode_wav(content.as_py())
                held.append((bundle, rate, channels, first))
                samples.append(x)
                n += len(x)
                if n >= AUDIO_SAMPLES:  # short ones travel together
                    yield recordings(held, samples)
                    held, samples, n = [], [], 0
            if held:
                yield recordings(held, samples)

    def recordings(held, samples):
        bundles, rates, channels, firsts = zip(*held, strict=True)
        ends = np.cumsum([0, *map(len, samples)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(samples)))
        return pa.RecordBatch.from_arrays([pa.array(bundles), pa.array(rates, pa.int32()), pa.array(channels, pa.int32()), lists, pa.array(firsts, pa.int64())], ["bundle_id", "sample_rate", "channels", "samples", "first_frame"])

    rows = corpus.table("audio").select("bundle_id", "content", F.coalesce("first_frame", F.lit(0)).alias("first_frame"))
    rows = rows if bundles is None else rows.join(bundles, "bundle_id", "left_semi")
    return rows.mapInArrow(decode, "bundle_id long, sample_rate int, channels int, samples array<float>, first_frame long")


def write_alignment(corpus: Corpus, aligned: DataFrame, processor: str, parameters: dict | None = None) -> int:
    """Words, Syllables and Phones tiers from (bundle_id, tier, start, end, label), each row stamped with its bundle's run."""
    named = aligned.withColumn("tier", F.initcap("tier"))
    return import_tiers(corpus, named.withColumn("kind", F.lit("interval")), processor, F.lit(json.dumps(parameters or {})))


def import_alignment(phones: DataFrame, words: DataFrame) -> DataFrame:
    """``phones`` with ``word_id``: the word that contains a phone's midpoint, the earliest where several do."""
    p = phones.withColumn("_mid", (F.col("start") + F.col("end")) / 2)
    w = words.select(F.col("bundle_id").alias("_b"), F.col("id").alias("word_id"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    met = p.join(w, (F.col("bundle_id") == F.col("_b")) & (F.col("_mid") >= F.col("_s")) & (F.col("_mid") < F.col("_e")), "left")
    first = Window.partitionBy("bundle_id", "id").orderBy("_s", "word_id")
    return met.withColumn("_k", F.row_number().over(first)).filter("_k = 1").drop("_k", "_mid", "_b", "_s", "_e")


# ---- models


def latest_models(models: DataFrame) -> DataFrame:
    """The model of each id with the largest version, as text."""
    return models.groupBy("id").agg(F.max_by(F.struct(*models.columns), "version").alias("m")).select("m.*")


def resolved_models(models: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` (id, version or null) with their models: the exact version, or the latest."""
    asked = wanted.join(latest_models(models).select("id", F.col("version").alias("_latest")), "id", "left").withColumn("version", F.coalesce("version", "_latest")).drop("_latest")
    return asked.join(models, ["id", "version"], "left")


def verified(files: DataFrame) -> DataFrame:
    """``files`` (content, expected) with ``ok``: whether the SHA-256 of the content is the expected one, whatever its letters' case."""
    return files.withColumn("ok", F.sha2("content", 256) == F.lower("expected"))

"""Registered queries of the corpus and its workflow: each loads the driver's tables into a new corpus, runs operations on it and returns what they left."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonospan import packages, workflow
from sonospan.functions import columns as fn
from sonospan.plans import projections as view
from sonospan.queries import register, rounded
from sonospan.sources import formats, readers
from sonospan.store import Corpus


def new_corpus(spark: SparkSession) -> Corpus:
    """A corpus in the shared folder that the cluster names; a local session may use a folder of its machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all nodes share")
    return Corpus(spark, f"{shared or tempfile.mkdtemp(prefix='corpora-')}/corpora/{uuid.uuid4().hex}", "driver")


def none(**kinds: str) -> dict:
    return {c: F.lit(None).cast(t) for c, t in kinds.items()}


BUNDLE = {"audio_relative_path": "string", "sample_rate": "int", "channels": "int", "n_frames": "long", "session_id": "long", "speaker_id": "long", "extra": "string"}
TIER = {"parent_id": "long", "cardinality": "string", "extra": "string"}
ROW = {"parent_annotation_id": "long", "status": "string", "note": "string", "processing_run_id": "long", "extra": "string"}


def bundles_of(rows: DataFrame) -> DataFrame:
    """A bundle for each ``bundle_id``."""
    names = {"audio_relative_path": F.concat(F.lit("u"), "id", F.lit(".wav")), "name": F.concat(F.lit("u"), "id")}
    return rows.select(F.col("bundle_id").alias("id")).distinct().withColumns(none(**BUNDLE) | names)


def loaded(spark: SparkSession, sf_dir: str, tiers: tuple[str, ...] = ("words", "phones"), rows: DataFrame | None = None) -> Corpus:
    """Users as bundles with interval tiers; ids are those of the tables, interleaved by tier."""
    c, k = new_corpus(spark), len(tiers)
    t = view.tiers(spark, sf_dir) if rows is None else rows
    number = F.array_position(F.array(*map(F.lit, tiers)), F.col("tier")) - 1
    t = c.staged(t.filter(F.col("tier").isin(*tiers)).withColumns({"tier_id": F.col("bundle_id") * k + number, "id": F.col("id") * k + number}))
    tier_rows = t.select(F.col("tier_id").alias("id"), "bundle_id", F.col("tier").alias("name"), F.lit("interval").alias("type")).distinct().withColumns(none(**TIER))
    annotations = t.select("id", "tier_id", F.col("start").alias("start_seconds"), F.col("end").alias("end_seconds"), "label").withColumns(none(**ROW))
    c.commit([("bundle", "insert", bundles_of(t)), ("tier", "insert", tier_rows), ("annotation_interval", "insert", annotations)])
    return c


def shown(c: Corpus, *tiers: str) -> DataFrame:
    return rounded(c.timeline(list(tiers) or None).select("bundle_id", "tier", "start", "end", "label"))


@register("""SELECT bundle_id, 'words' AS tier, round(s, 6) AS "start", round(e, 6) AS "end", label FROM wd UNION ALL SELECT bundle_id, 'phones', round(s, 6), round(e, 6), label FROM iv""")
def corpus_timeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sparse rows of a corpus with their tiers."""
    return shown(loaded(spark, sf_dir))


@register("""+ u AS (SELECT min(bundle_id) AS b FROM wd) SELECT round(s, 6) AS start_seconds, round(e, 6) AS end_seconds, round(e - s, 6) AS duration_seconds, label FROM wd, u WHERE bundle_id = b""")
def corpus_tier_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the first bundle's word tier, by its type."""
    c = loaded(spark, sf_dir)
    first = c.table("tier").filter("name = 'words'").orderBy("bundle_id").first()
    return rounded(c.tier_rows(first["id"]).select("start_seconds", "end_seconds", "duration_seconds", "label"))


@register("""SELECT bundle_id, tier, round(s, 6) AS "start", round(e, 6) AS "end", label FROM (SELECT *, 'words' AS tier FROM wd UNION ALL BY NAME SELECT *, 'phones' AS tier FROM iv)""")
def import_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported as CSV, read back and imported into another corpus."""
    c, other = loaded(spark, sf_dir), new_corpus(spark)
    other.commit([("bundle", "insert", c.table("bundle"))])
    path = f"{c.root}/csv"
    readers.write_annotations_csv(workflow.export_rows(c), path)
    rows = readers.read_annotations_csv(spark, path)
    workflow.import_tiers(other, rows.select("bundle_id", F.col("tier_name").alias("tier"), F.col("tier_type").alias("kind"), F.coalesce("start_seconds", "time_seconds").alias("start"), F.coalesce("end_seconds", "time_seconds").alias("end"), "label"), "import:csv")
    return shown(other)


@register("""+ a AS (SELECT bundle_id, 'words' AS tier, s, e, label, id FROM wd UNION ALL SELECT bundle_id, 'phones', s, e, label, id FROM iv), k AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY bundle_id, tier ORDER BY s, id), 0) AS prior FROM a)
SELECT bundle_id, tier, round(s, 6) AS "start", round(e, 6) AS "end", label FROM k UNION ALL SELECT bundle_id, tier, round(prior, 6), round(s, 6), '' FROM k WHERE s > prior + 1e-9""")
def import_textgrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle exported as a TextGrid, parsed and imported into another corpus; gaps come back as empty intervals."""
    c, other = loaded(spark, sf_dir), new_corpus(spark)
    other.commit([("bundle", "insert", c.table("bundle"))])
    durations = c.timeline().groupBy("bundle_id").agg(F.max("end").alias("duration"))
    texts = c.staged(workflow.export_textgrids(c, durations))
    workflow.import_tiers(other, readers.parsed_texts(texts, formats.parse_textgrid, readers.TEXTGRID), "import:textgrid")
    return shown(other)


MS = "round_even({} * 1000, 0) / 1000"


@register(f"""+ a AS (SELECT bundle_id, 'words' AS tier, NULL AS parent, s, e, label FROM wd UNION ALL SELECT bundle_id, 'phones', 'words', s, e, label FROM iv WHERE bundle_id IN (SELECT bundle_id FROM wd))
SELECT bundle_id, tier, parent, {MS.format('s')} AS "start", {MS.format('e')} AS "end", label FROM a""")
def import_eaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle exported as an ELAN document with phones under words, parsed and imported; times are whole milliseconds."""
    c, other = loaded(spark, sf_dir), new_corpus(spark)
    tiers = c.table("tier")
    words = tiers.filter("name = 'words'").select("bundle_id", F.col("id").alias("_words"))
    c.replace("tier", tiers.filter("name = 'phones'").join(words, "bundle_id").withColumn("parent_id", F.col("_words")))
    other.commit([("bundle", "insert", c.table("bundle"))])
    with_words = c.staged(workflow.export_eafs(c)).join(words.select("bundle_id"), "bundle_id", "left_semi")
    workflow.import_tiers(other, readers.parsed_texts(with_words, formats.parse_eaf, readers.EAF), "import:eaf")
    made = other.table("tier")
    parents = made.join(made.select(F.col("id").alias("parent_id"), F.col("name").alias("parent")), "parent_id", "left").select(F.col("id").alias("tier_id"), "parent")
    return rounded(other.timeline().join(parents, "tier_id").select("bundle_id", "tier", "parent", "start", "end", "label"))


@register(f"""+ a AS (SELECT i.*, w.s AS ws, w.label AS wlabel FROM iv i LEFT JOIN wd w ON w.bundle_id = i.bundle_id AND i.s >= w.s AND i.e <= w.e WHERE i.bundle_id IN (SELECT bundle_id FROM wd))
SELECT bundle_id, 'ref ' || label AS label, CASE WHEN id % 3 = 0 THEN '{{"n":' || id || '}}' END AS extra, {MS.format('ws')} AS parent_start, wlabel AS parent_label, {MS.format('s')} AS target_start, label AS target_label FROM a""")
def eaf_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """References to phones that hang on words, exported as ELAN documents and imported under new ids: each still hangs on its word and points to its phone; phones outside words have none to hang on."""
    c, other = loaded(spark, sf_dir), new_corpus(spark)
    tiers, rows = c.table("tier"), c.table("annotation_interval")
    words = tiers.filter("name = 'words'").select("bundle_id", F.col("id").alias("parent_id"))
    made = words.select((F.col("bundle_id") * 2 + 1_000_001).alias("id"), "bundle_id", F.lit("links").alias("name"), F.lit("reference").alias("type"), "parent_id", F.lit("one_to_many").alias("cardinality"), F.lit(None).cast("string").alias("extra"))
    of_tier = lambda name, *cols: rows.join(tiers.filter(F.col("name") == name).select(F.col("id").alias("tier_id"), "bundle_id"), "tier_id").select("bundle_id", *cols)
    phones = of_tier("phones", F.col("id").alias("target_id"), "start_seconds", "end_seconds", "label")
    spans = of_tier("words", F.col("id").alias("parent_annotation_id"), F.col("start_seconds").alias("s"), F.col("end_seconds").alias("e"))
    met = phones.join(spans, "bundle_id").filter("start_seconds >= s and end_seconds <= e").select("bundle_id", "target_id", "parent_annotation_id")
    number = F.floor(F.col("target_id") / 2)
    links = phones.join(met, ["bundle_id", "target_id"], "left").join(made.select("bundle_id", F.col("id").alias("tier_id")), "bundle_id").select(
        F.col("target_id").alias("id"), "tier_id", F.lit("interval").alias("target_kind"), "target_id", F.concat(F.lit("ref "), "label").alias("label"), "parent_annotation_id", F.when(number % 3 == 0, F.concat(F.lit('{"n":'), number.cast("long"), F.lit("}"))).alias("extra")
    )
    c.commit([("tier", "insert", made), ("annotation_reference", "insert", links)])
    other.commit([("bundle", "insert", c.table("bundle"))])
    workflow.import_tiers(other, readers.parsed_texts(workflow.export_eafs(c).join(words.select("bundle_id"), "bundle_id", "left_semi"), formats.parse_eaf, readers.EAF), "import:eaf")
    known = other.table("annotation_interval")
    at = lambda name: known.select(F.col("id").alias(f"{name}_id"), F.col("start_seconds").alias(f"{name}_start"), F.col("label").alias(f"{name}_label"))
    back = other.table("annotation_reference").withColumnRenamed("parent_annotation_id", "parent_id").join(other.table("tier").select(F.col("id").alias("tier_id"), "bundle_id"), "tier_id")
    return rounded(back.join(at("parent"), "parent_id", "left").join(at("target"), "target_id", "left").select("bundle_id", "label", "extra", "parent_start", "parent_label", "target_start", "target_label"))


@register("""SELECT bundle_id, tier, round(s, 6) AS "start", round(e, 6) AS "end", label, CASE WHEN id % 5 = 0 THEN '{"n":' || id || '}' WHEN id % 5 = 1 THEN 'plain "text"' END AS extra, CASE WHEN id % 4 = 0 THEN 'seen' END AS note
FROM (SELECT *, 'words' AS tier FROM wd UNION ALL BY NAME SELECT *, 'phones' AS tier FROM iv)""")
def import_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every bundle exported as a structured document, read back and imported into another corpus, with notes and what labels carry."""
    c, other = loaded(spark, sf_dir), new_corpus(spark)
    number = F.floor(F.col("id") / 2).cast("long")
    extra = F.when(number % 5 == 0, F.concat(F.lit('{"n":'), number, F.lit("}"))).when(number % 5 == 1, F.lit('plain "text"'))
    c.replace("annotation_interval", c.table("annotation_interval").withColumns({"extra": extra, "note": F.when(number % 4 == 0, "seen")}))
    other.commit([("bundle", "insert", c.table("bundle"))])
    workflow.import_json(other, workflow.export_json(c))
    rows = other.table("annotation_interval").join(other.table("tier").select(F.col("id").alias("tier_id"), "bundle_id", F.col("name").alias("tier")), "tier_id")
    return rounded(rows.select("bundle_id", "tier", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "label", "extra", "note"))


RULE = {"select": {"tier": "phones", "label_any": ["click", "purchase"]}, "where": "mean(x) > 1.2 * mean(x, file)", "emit": {"kind": "point", "at": 0.5}}


@register("""+ f AS (SELECT bundle_id, avg(v) AS m FROM p GROUP BY 1),
r AS (SELECT i.bundle_id, i.id, any_value(i.s) AS s, any_value(i.e) AS e, any_value(i.label) AS label, avg(p.v) AS m FROM iv i JOIN p ON p.bundle_id = i.bundle_id AND p.t BETWEEN i.s AND i.e WHERE i.label IN ('click', 'purchase') GROUP BY 1, 2),
h AS (SELECT r.* FROM r JOIN f USING (bundle_id) WHERE r.m > 1.2 * f.m)
SELECT 'preview' AS stage, bundle_id, s + 0.5 * (e - s) AS "start", s + 0.5 * (e - s) AS "end", label FROM h UNION ALL SELECT 'accepted', bundle_id, s + 0.5 * (e - s), s + 0.5 * (e - s), label FROM h
UNION ALL SELECT 'target', bundle_id, s, e, label FROM h UNION ALL SELECT 'run', bundle_id, 0, 0, 'criterion:loud' FROM (SELECT DISTINCT bundle_id FROM iv)""")
def criterion_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A criterion is stored, run into a preview tier, accepted, and made into targets; its runs are recorded."""
    c = loaded(spark, sf_dir)
    bundles = c.table("bundle").select(F.col("id").alias("bundle_id"))
    rule, signal = workflow.set_criterion(c, "loud", RULE, "hits"), {"x": view.signal(spark, sf_dir)}
    workflow.run_criterion(c, rule, signal, bucket_seconds=86_400.0)
    before = c.staged(c.timeline(["hits (auto)"]).select(F.lit("preview").alias("stage"), "bundle_id", "start", "end", "label"))
    workflow.accept_proposals(c, "hits", bundles)
    workflow.generate_targets(c, rule, signal)
    after = c.timeline(["hits", "hits (auto)"]).select(F.lit("accepted").alias("stage"), "bundle_id", "start", "end", "label")
    made = c.table("target").select(F.lit("target").alias("stage"), "bundle_id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "label")
    runs = c.table("processing_run").select(F.lit("run").alias("stage"), "bundle_id", F.lit(0.0).alias("start"), F.lit(0.0).alias("end"), F.col("processor_id").alias("label")).distinct()
    return before.unionByName(after).unionByName(made).unionByName(runs)


def annotators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phones as tiers of two annotators; every seventh label of the second is another."""
    a = view.intervals(spark, sf_dir).select("bundle_id", F.lit("phones [ann]").alias("tier"), "id", "start", "end", "label")
    return a.unionByName(a.withColumns({"tier": F.lit("phones [bob]"), "label": F.when(F.col("id") % 7 == 0, "other").otherwise(F.col("label"))}))


AGREED = """j AS (SELECT bundle_id, a, b, count(*) AS n FROM u GROUP BY ALL), tot AS (SELECT bundle_id, sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM j GROUP BY ALL),
ch AS (SELECT bundle_id, sum(x.n * y.n) AS chance FROM (SELECT bundle_id, a AS l, sum(n) AS n FROM j GROUP BY ALL) x JOIN (SELECT bundle_id, b AS l, sum(n) AS n FROM j GROUP BY ALL) y USING (bundle_id, l) GROUP BY ALL),
k AS (SELECT bundle_id, tot.n::BIGINT AS n, same / tot.n AS po, coalesce(chance, 0) / (tot.n * tot.n) AS pe FROM tot LEFT JOIN ch USING (bundle_id)),
rep AS (SELECT bundle_id, n AS n_a, n AS n_b, n AS n_matched, round(po, 6) AS percent_label_agreement, round(CASE WHEN abs(1 - pe) < 1e-12 THEN CASE WHEN abs(1 - po) < 1e-12 THEN 1 ELSE 0 END ELSE (po - pe) / (1 - pe) END, 6) AS cohen_kappa, 0::DOUBLE AS mean_abs_diff, 1::DOUBLE AS within_tolerance FROM k)"""
REPORT = ["n_a", "n_b", "n_matched", "percent_label_agreement", "cohen_kappa", "mean_abs_diff", "within_tolerance"]


@register("+ u AS (SELECT bundle_id, label AS a, CASE WHEN id % 7 = 0 THEN 'other' ELSE label END AS b FROM iv), " + AGREED + " SELECT 'ann' AS annotator_a, 'bob' AS annotator_b, * FROM rep")
def corpus_agreement_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of all annotator pairs of a base tier."""
    c = loaded(spark, sf_dir, ("phones [ann]", "phones [bob]"), annotators(spark, sf_dir))
    return rounded(workflow.agreement_summary(c, "phones", step=21_600.0).select("annotator_a", "annotator_b", "bundle_id", *REPORT))


@register("+ u AS (SELECT bundle_id, label AS a, CASE WHEN id % 7 = 0 THEN 'other' ELSE label END AS b FROM iv), " + AGREED + " SELECT * FROM rep")
def corpus_compare_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = loaded(spark, sf_dir, ("phones [ann]", "phones [bob]"), annotators(spark, sf_dir))
    return rounded(workflow.compare_tiers(c, "phones [ann]", "phones [bob]", step=21_600.0).select("bundle_id", *REPORT))


@register("+ u AS (SELECT bundle_id, label AS a, CASE WHEN id % 5 = 0 THEN 'other' ELSE label END AS b FROM p), " + AGREED + " SELECT * FROM rep")
def compare_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of two point tiers with equal times."""
    from sonospan.operators import agreement

    p = view.points(spark, sf_dir)
    return rounded(agreement.compare_points(p, p.withColumn("label", F.when(F.col("id") % 5 == 0, "other").otherwise(F.col("label")))).select("bundle_id", *REPORT))


@register("""+ d AS (SELECT DISTINCT source, lang FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL)
SELECT 'published' AS kind, source AS tier_name, lang AS value FROM d UNION ALL SELECT 'status', 'a', 'checked' UNION ALL SELECT 'status', 'b', 'open' UNION ALL SELECT 'tier', min(source), 'one' || chr(10) || 'two' FROM d
UNION ALL SELECT 'removed', source, lang FROM d WHERE lang = 'de'""")
def rubric_workflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vocabularies and statuses are set, published, read back from the snapshot, changed and compared with it; a notebook entry becomes guidance."""
    c = new_corpus(spark)
    words = view.table(spark, sf_dir, "documents").select(F.col("source").alias("tier_name"), F.col("lang").alias("value")).dropna()
    workflow.set_rubric(c, "r", 2)
    workflow.set_rubric_statuses(c, [("open", "x"), ("old", None)])
    workflow.set_rubric_statuses(c, [("checked", "a"), ("open", "b")])
    least = words.agg(F.min("tier_name")).first()[0]
    workflow.set_rubric_tier(c, least, "zero", True)
    workflow.set_rubric_tier(c, least, "one", False)
    entry = workflow.add_notebook_entries(c, spark.createDataFrame([("decision", "two")], "kind string, text string")).first()["id"]
    workflow.promote_to_guidance(c, entry, least)
    workflow.set_vocabulary(c, words)
    version = workflow.publish_rubric_version(c)
    workflow.publish_rubric_version(c, "again")
    got = c.staged(workflow.rubric_versions(c).filter(F.col("version") == version))
    workflow.set_vocabulary(c, words.filter("value <> 'de'"))
    published = got.select(F.explode("vocabulary").alias("v")).select(F.lit("published").alias("kind"), "v.tier_name", "v.value")
    statuses = got.select(F.explode("statuses").alias("v")).select(F.lit("status").alias("kind"), F.col("v.description").alias("tier_name"), F.col("v.name").alias("value"))
    tiers = got.select(F.explode("tiers").alias("v")).select(F.lit("tier").alias("kind"), "v.tier_name", F.col("v.description").alias("value"))
    removed = workflow.rubric_impact(c, version).select(F.lit("removed").alias("kind"), F.col("tier").alias("tier_name"), F.explode("removed").alias("value"))
    return published.unionByName(statuses).unionByName(tiers).unionByName(removed)


@register("""+ k AS (SELECT bundle_id, row_number() OVER (PARTITION BY bundle_id ORDER BY t, id) - 1 AS i, v, label FROM p)
SELECT 'number' AS kind, bundle_id, i, round(i / 50, 6) AS t, round(v, 6) AS value FROM k UNION ALL SELECT 'vector', bundle_id, i, round(i / 50, 6), round(3 * v, 6) FROM k UNION ALL SELECT 'label', bundle_id, i, round(i / 50, 6), length(label)::DOUBLE FROM k""")
def dense_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense tiers of numbers, vectors and labels, written once and read back with their times."""
    c = new_corpus(spark)
    rows = readers.indexed(view.points(spark, sf_dir), "bundle_id", ["t", "id"]).withColumn("i", F.col("i").cast("long"))
    c.commit([("bundle", "insert", bundles_of(rows))])
    workflow.write_dense_tier(c, "number", rows.select("bundle_id", "i", F.col("v").alias("value")), 50.0)
    workflow.write_dense_tier(c, "vector", rows.select("bundle_id", "i", F.array("v", 2 * F.col("v")).alias("value")), 50.0, "continuous_vector")
    workflow.write_dense_tier(c, "label", rows.select("bundle_id", "i", F.col("label").alias("value")), 50.0, "categorical_sampled")
    values = {"number": F.col("value"), "vector": F.get("value", F.lit(0)) + F.get("value", F.lit(1)), "label": F.length("value").cast("double")}
    out: DataFrame | None = None
    for kind, value in values.items():
        part = workflow.read_dense_tier(c, kind).select(F.lit(kind).alias("kind"), "bundle_id", "i", "t", value.alias("value"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@register("""+ x AS (SELECT vec_id, list_transform(embedding, lambda v: round_even(greatest(least(v::DOUBLE, 1), -1) * 32767, 0) / 32768) AS s FROM embeddings), c AS (SELECT vec_id, s, unnest([0, 1, 2]) AS k FROM x)
SELECT 'v' || vec_id || '_00' || (k + 1) AS name, CASE WHEN k = 2 THEN 16 ELSE 24 END::BIGINT AS n_frames, round(list_sum(s[24 * k + 1:24 * k + 24]), 6) AS total FROM c""")
def corpus_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as recordings of 64 frames, split into bundles of 24, encoded as WAV, and decoded again."""
    c = new_corpus(spark)
    audio = view.table(spark, sf_dir, "embeddings").select(F.concat(F.lit("v"), "vec_id").alias("name"), F.lit(16).alias("sample_rate"), F.lit(1).alias("channels"), F.col("embedding").cast("array<float>").alias("samples"))
    workflow.add_split(c, audio, 1.5)
    total = F.aggregate("samples", F.lit(0.0), lambda s, v: s + v)
    return rounded(workflow.load_audio(c).select("bundle_id", total.alias("total")).join(c.table("bundle").select(F.col("id").alias("bundle_id"), "name", "n_frames"), "bundle_id").select("name", "n_frames", "total"))


@register("""+ e AS (SELECT bundle_id, 'phones' AS tier, round(s, 6) AS "start", round(e, 6) AS "end", CASE WHEN label = 'view' THEN 'seen' ELSE label END AS label, CASE WHEN label = 'click' THEN 'checked' END AS status FROM iv WHERE label <> 'error')
SELECT *, 'renamed ' || bundle_id AS bundle FROM e UNION ALL SELECT -1, 'audit', (SELECT count(*) FROM iv WHERE label = 'error'), (SELECT count(*) FROM iv WHERE label IN ('view', 'click')), NULL, NULL, NULL""")
def corpus_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows relabelled, given a status, deleted, bundles renamed, word tiers dropped; the last row counts audited deletes and updates of phones."""
    c = loaded(spark, sf_dir, ("phones", "words"))
    workflow.set_rubric_statuses(c, [("checked", None)])
    c.delete("tier", F.col("name") == "words")
    c.update("annotation_interval", F.col("label") == "view", {"label": F.lit("seen")})
    c.update("annotation_interval", F.col("label") == "click", {"status": F.lit("checked"), "note": F.lit("n")})
    c.delete("annotation_interval", F.col("label") == "error")
    c.update("bundle", F.lit(True), {"name": F.concat(F.lit("renamed "), "id")})
    status = c.table("annotation_interval").select("id", "status")
    names = c.table("bundle").select(F.col("id").alias("bundle_id"), F.col("name").alias("bundle"))
    rows = c.timeline().join(status, "id").join(names, "bundle_id").select("bundle_id", "tier", "start", "end", "label", "status", "bundle")
    phones = c.table("audit_log").filter("table_name = 'annotation_interval' and row_id % 2 = 0")
    audit = phones.agg(F.count_if(F.col("op") == "delete").cast("double").alias("start"), F.count_if(F.col("op") == "update").cast("double").alias("end"))
    last = audit.select(F.lit(-1).cast("long").alias("bundle_id"), F.lit("audit").alias("tier"), "start", "end", *[F.lit(None).cast("string").alias(x) for x in ("label", "status", "bundle")])
    return rounded(rows.unionByName(last))


@register("""+ r AS (SELECT o_orderkey AS id, o_custkey AS bundle_id, o_orderpriority AS pr, o_orderstatus AS st FROM orders)
SELECT id, bundle_id, CASE WHEN st = 'P' THEN 'done' WHEN left(pr, 1) = '1' AND st = 'O' THEN 'assigned' ELSE 'unassigned' END AS status, CASE WHEN left(pr, 1) = '1' AND st <> 'F' THEN 'bob' END AS annotator FROM r""")
def corpus_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as targets: urgent ones are assigned, some assignments go again, annotators and statuses change."""
    c = new_corpus(spark)
    o = view.table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("id"), F.col("o_custkey").cast("long").alias("bundle_id"), F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"))
    fixed = {"start_seconds": F.lit(0.0), "end_seconds": F.lit(1.0), "label": F.col("st"), "status": F.lit("unassigned")}
    c.commit([("bundle", "insert", bundles_of(o)), ("target", "insert", o.withColumns(fixed | none(note="string", criterion_id="long")))])
    c.append("assignment", o.filter("left(pr, 1) = '1'").select(F.col("id").alias("target_id"), F.lit("ann").alias("annotator"), F.lit("assigned").alias("status")))
    finished = c.assignments().join(o.filter("st = 'F'").select(F.col("id").alias("target_id")), "target_id", "left_semi").select("id")
    c.update("assignment", F.lit(True), {"annotator": F.lit("bob"), "role": F.lit("second")})
    marked = c.table("assignment").join(finished, "id", "left_semi").withColumn("status", F.lit("gone"))
    c.replace("assignment", marked)
    c.delete("assignment", F.col("status") == "gone")
    c.update("target", F.col("label") == "P", {"status": F.lit("done"), "note": F.lit("n")})
    who = c.assignments().select(F.col("target_id").alias("id"), "annotator")
    return c.table("target").join(who, "id", "left").select("id", "bundle_id", "status", "annotator")


@register("""+ n AS (SELECT doc_id, quality FROM labels)
SELECT 'entry' AS kind, 'doc ' || doc_id AS name, 'observation' AS value FROM n WHERE quality = 1 UNION ALL SELECT 'run', event_type, count(DISTINCT user_id)::VARCHAR FROM events GROUP BY event_type
UNION ALL SELECT 'recipe', 'first', 'done' UNION ALL SELECT 'pin', 'vowels', '2' UNION ALL SELECT 'criterion', 'long', 'hits' UNION ALL SELECT 'script', 'first', (SELECT count(*) FROM (SELECT DISTINCT user_id, event_type FROM events))::VARCHAR""")
def corpus_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notebook entries, a recipe with its processing runs and script, pins, and an entry promoted to a criterion."""
    c = new_corpus(spark)
    labels = view.table(spark, sf_dir, "labels")
    workflow.add_notebook_entries(c, labels.select(F.lit("observation").alias("kind"), F.concat(F.lit("doc "), "doc_id").alias("text"), F.when(F.col("quality") == 1, "bundle").otherwise("interval").alias("target_type"), F.col("doc_id").alias("target_id")))
    first = workflow.notebook_entries(c, "bundle").first()["id"]
    workflow.promote_to_criterion(c, first, "long", {"select": {"tier": "phones"}, "emit": {"kind": "span"}}, "hits")
    recipe = workflow.start_recipe(c, "first", {"a": 1})
    events = view.table(spark, sf_dir, "events").select(F.col("user_id").alias("bundle_id"), F.col("event_type").alias("processor_id")).distinct()
    c.commit([("bundle", "insert", bundles_of(events))])
    workflow.record_runs(c, events.select("bundle_id", F.lit("dsp").alias("kind"), "processor_id", F.lit("{}").alias("parameters")))
    workflow.end_recipe(c, recipe)
    workflow.pin_refdist(c, "vowels", "1")
    workflow.pin_refdist(c, "vowels", "2")
    workflow.pin_refdist(c, "other", "1")
    workflow.remove_refdist_pin(c, "other")
    part = lambda kind, df, name, value: df.select(F.lit(kind).alias("kind"), name.alias("name"), value.alias("value"))
    col = F.col
    out = part("entry", workflow.notebook_entries(c, "bundle"), col("text"), col("kind"))
    out = out.unionByName(part("run", workflow.runs_of_recipe(c, recipe).groupBy("processor_id").agg(F.count("*").cast("string").alias("n")), col("processor_id"), col("n")))
    out = out.unionByName(part("recipe", c.table("recipe_run"), col("name"), col("status"))).unionByName(part("pin", c.table("refdist_pin"), col("refdist"), col("version")))
    out = out.unionByName(part("criterion", c.table("criterion"), col("name"), col("target_tier")))
    lines = F.size(F.filter(F.split("script", "\n"), lambda x: x.startswith("run("))).cast("string")
    return out.unionByName(part("script", workflow.render_scripts(c), col("recipe"), lines))


@register("""SELECT 'vocabulary' AS rule, count(*) AS n FROM wd WHERE label NOT IN ('view', 'click') AND label <> '' UNION ALL SELECT 'check', count(*) FROM wd WHERE id % 4 = 0 UNION ALL SELECT 'cardinality', count(*) FROM wd WHERE id % 3 = 0 UNION ALL SELECT 'status', count(*) FROM wd WHERE id % 5 = 0""")
def corpus_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that new rows of a closed tier break, by rule: labels, times, parents and statuses."""
    c = loaded(spark, sf_dir, ("words",))
    workflow.set_rubric_tier(c, "words", None, True)
    workflow.set_vocabulary(c, spark.createDataFrame([("words", "view"), ("words", "click")], "tier_name string, value string"))
    rows = c.table("annotation_interval").withColumns({
        "end_seconds": F.when(F.col("id") % 4 == 0, F.col("start_seconds")).otherwise(F.col("end_seconds")),
        "parent_annotation_id": F.when(F.col("id") % 3 == 0, F.col("id")), "status": F.when(F.col("id") % 5 == 0, "unknown"),
    })
    return c.violations("annotation_interval", rows).distinct().groupBy("rule").agg(F.count("*").alias("n"))


@register("""SELECT bundle_id, tier || ' [ann]' AS tier, round(s, 6) AS "start", round(e, 6) AS "end", label, parent FROM (SELECT bundle_id, 'words' AS tier, s, e, label, -1::DOUBLE AS parent FROM wd UNION ALL
SELECT i.bundle_id, 'phones', i.s, i.e, i.label, coalesce(round(w.s, 6), -1) FROM iv i LEFT JOIN wd w ON w.bundle_id = i.bundle_id AND i.s >= w.s - 1e-9 AND i.e <= w.e + 1e-9) WHERE bundle_id % 2 = 0""")
def package_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of the bundles exported for an annotator and imported as their tiers, links of phones to words included."""
    c = loaded(spark, sf_dir)
    tiers = c.table("tier")
    words = tiers.filter("name = 'words'").select("bundle_id", F.col("id").alias("_words"))
    c.replace("tier", tiers.filter("name = 'phones'").join(words, "bundle_id").withColumns({"parent_id": F.col("_words"), "cardinality": F.lit("one_to_many")}))
    rows = c.timeline()
    w = rows.filter("tier = 'words'").select(F.col("bundle_id").alias("_b"), F.col("id").alias("_w"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    links = rows.filter("tier = 'phones'").join(w, (F.col("bundle_id") == F.col("_b")) & (F.col("start") >= F.col("_s") - 1e-9) & (F.col("end") <= F.col("_e") + 1e-9)).select("id", "_w")
    c.replace("annotation_interval", c.table("annotation_interval").join(links, "id").withColumn("parent_annotation_id", F.col("_w")))
    half = c.table("bundle").filter("id % 2 = 0").select(F.col("id").alias("bundle_id"))
    goals = half.withColumns({"start_seconds": F.lit(0.0), "end_seconds": F.lit(1.0), "status": F.lit("unassigned")})
    made = c.append("target", goals)
    c.append("assignment", c.table("target").select(F.col("id").alias("target_id"), F.lit("ann").alias("annotator"), F.lit("assigned").alias("status")))
    package = packages.export_package(c, "ann", f"{c.root}-package")
    packages.import_package(c, package, "ann")
    parents = c.table("annotation_interval").select("id", "parent_annotation_id").join(c.table("annotation_interval").select(F.col("id").alias("parent_annotation_id"), F.col("start_seconds").alias("parent")), "parent_annotation_id", "left").select("id", F.coalesce("parent", F.lit(-1.0)).alias("parent"))
    return rounded(c.timeline(["words [ann]", "phones [ann]"]).join(parents, "id").select("bundle_id", "tier", "start", "end", "label", "parent"))


@register("""SELECT i.bundle_id, i.id, coalesce(arg_min(w.id, (w.s, w.id)), -1) AS word_id FROM iv i LEFT JOIN wd w ON w.bundle_id = i.bundle_id AND (i.s + i.e) / 2 >= w.s AND (i.s + i.e) / 2 < w.e GROUP BY 1, 2""")
def alignment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word of each phone, by midpoint."""
    t = view.tiers(spark, sf_dir)
    return workflow.import_alignment(t.filter("tier = 'phones'").drop("tier"), t.filter("tier = 'words'").drop("tier")).select("bundle_id", "id", F.coalesce("word_id", F.lit(-1).cast("long")).alias("word_id"))


@register("SELECT p_partkey AS id, (p_partkey // 2)::BIGINT AS parent_id, (length(bin(p_partkey)) - 1)::INT AS level FROM part")
def tiers_parents_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a forest of tiers, with levels."""
    k = F.col("p_partkey")
    return workflow.parents_first(view.table(spark, sf_dir, "part").select(k.alias("id"), F.when(k > 1, F.floor(k / 2)).alias("parent_id"))).withColumn("parent_id", F.coalesce("parent_id", F.lit(0).cast("long")))


@register("""+ m AS (SELECT p_brand AS id, max(p_size::VARCHAR) AS latest FROM part GROUP BY 1)
SELECT p_brand AS id, p_partkey, coalesce(CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR END, latest) AS version FROM part JOIN m ON m.id = p_brand""")
def models_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a brand's parts as versions of a model: even parts ask for their own, others for the latest by text."""
    part = view.table(spark, sf_dir, "part").select(F.col("p_brand").alias("id"), "p_partkey", F.col("p_size").cast("string").alias("size"))
    models = part.select("id", F.col("size").alias("version")).distinct()
    return workflow.resolved_models(models, part.select("id", "p_partkey", F.when(F.col("p_partkey") % 2 == 0, F.col("size")).alias("version")))


@register("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang || ' {json:{"k":' || doc_id || '}}' ELSE lang END AS encoded, lang AS label, CASE WHEN doc_id % 2 = 0 THEN '{"k":' || doc_id || '}' END AS extra,
regexp_replace(left(text, 30), '[^A-Za-z0-9._-]', '_', 'g') AS file_name, translate('ˈ' || lang || 'ˌ', 'ˈˌ', '') AS unstressed, '"' || replace('a"' || lang, '"', '""') || '"' AS quoted, sha256(text) = sha256(text) AS ok FROM documents WHERE text IS NOT NULL""")
def label_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentinels on and off, file names, stress marks, quotes and checksums of the documents' fields."""
    d = view.table(spark, sf_dir, "documents").filter("text is not null")
    extra = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('{"k":'), "doc_id", F.lit("}")))
    d = d.withColumn("encoded", fn.encode_label(F.col("lang"), extra)).withColumn("decoded", fn.decode_label(F.col("encoded")))
    d = workflow.verified(d.withColumns({"content": F.col("text").cast("binary"), "expected": F.upper(F.sha2("text", 256))}))
    return d.select("doc_id", "encoded", "decoded.label", "decoded.extra", fn.safe_file_name(F.substring("text", 1, 30)).alias("file_name"), fn.strip_stress(F.concat(F.lit("ˈ"), "lang", F.lit("ˌ"))).alias("unstressed"), fn.quoted(F.concat(F.lit('a"'), "lang")).alias("quoted"), "ok")


I0 = "list_sum(list_transform(range(0, 30), lambda k: pow({x} / 2, 2 * k) / pow(gamma(k + 1), 2)))"


WINDOWS_SQL = {
    "hamming": "0.54 - 0.46 * cos(2 * pi() * i / 63)", "blackman": "0.42 - 0.5 * cos(2 * pi() * i / 63) + 0.08 * cos(4 * pi() * i / 63)", "gaussian": "exp(-0.5 * pow((i - 31.5) / 10, 2))",
    "kaiser": f"{I0.format(x='(6 * sqrt(1 - pow(2 * i / 63 - 1, 2)))')} / {I0.format(x='6')}",
}


@register(f"+ w AS (SELECT i, {', '.join(f'{e} AS {n}' for n, e in WINDOWS_SQL.items())} FROM range(64) r(i)), x AS (SELECT vec_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) r(i)) SELECT vec_id, {', '.join(f'round(sum(x * {n}), 6) AS {n}' for n in WINDOWS_SQL)} FROM x JOIN w USING (i) GROUP BY 1")
def window_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the embeddings under four windows of 64 samples; Kaiser's comes through the series of the Bessel function."""
    made = (("hamming", fn.hamming(64)), ("blackman", fn.blackman(64)), ("gaussian", fn.gaussian(64, 10.0)), ("kaiser", fn.kaiser(64, 6.0)))
    total = lambda w: F.aggregate(fn.windowed(F.col("x"), w), F.lit(0.0), lambda s, v: s + v)
    rows = view.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    return rounded(rows.select("vec_id", *[total(w).alias(n) for n, w in made]))


@register("""+ e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x, unnest(range(0, 7)) AS k FROM embeddings), r AS (SELECT vec_id, k, sqrt(list_sum(list_transform(x[8 * k + 1:8 * k + 16], lambda v: v * v)) / 16) AS rms FROM e)
SELECT vec_id, round((8 * k + 8) / 1000, 6) AS t, round(rms, 6) AS rms, round(CASE WHEN rms > 0 THEN 20 * log10(rms) ELSE -200 END, 5) AS db FROM r""")
def intensity_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level frames of the embeddings read as signals of 1 kHz: frames of 16 samples, hops of 8."""
    from sonospan.functions import dsp, frames

    audio = view.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("bundle_id"), F.lit(1000).alias("sample_rate"), F.col("embedding").cast("array<double>").alias("samples"))
    made = frames.analysed(audio, lambda x, r: dsp.intensity(x, r, 0.016, 0.008), "t double, rms double, db double")
    return made.select(F.col("bundle_id").alias("vec_id"), F.round("t", 6).alias("t"), F.round("rms", 6).alias("rms"), F.round("db", 5).alias("db"))


@register("""SELECT 'installed' AS stage, l_returnflag AS flag, count(*) AS n, count(DISTINCT l_suppkey) AS n_speakers, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY 2
UNION ALL SELECT 'refused', NULL, NULL, (SELECT min(n) FROM (SELECT count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag)), NULL""")
def refdist_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A distribution packed, checked, installed and read back; one that asks for more speakers in each subgroup than there are is refused, with the least number there is."""
    from sonospan import refdists
    from sonospan.store import StoreError

    root = new_corpus(spark).root
    data = view.table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_suppkey").alias("speaker_id"), F.col("l_quantity").alias("value"))
    about = {"version": "1.0.0", "title": "Quantities", "license": "CC0-1.0", "measure": {"kind": "observed_distribution", "parameters": ["F1"]}, "population": {"language": "eng"}}
    privacy = {"shareability": "raw_samples", "min_n_per_subgroup": 2, "subgroups": ["flag"]}
    refdists.scaffold(spark, f"{root}/src/one", about | {"id": "quantities", "privacy": privacy}, "From the line items.", data)
    refdists.scaffold(spark, f"{root}/src/two", about | {"id": "crowded", "privacy": privacy | {"min_n_per_subgroup": 1 << 40}}, "", data)
    refdists.install(spark, f"{root}/store", f"{root}/src/one", refdists.CURATED)
    least = 0
    try:
        refdists.install(spark, f"{root}/store", f"{root}/src/two", refdists.CURATED)
    except StoreError as e:
        least = int(str(e).rpartition(": ")[2].split()[0])
    paths = [r["path"] for r in refdists.found(refdists.installed(spark, f"{root}/store"), language="ENG", parameter="f1").collect()]  # one package
    kept = spark.read.parquet(*[f"{p}/data.parquet" for p in paths])
    rows = kept.groupBy("flag").agg(F.count("*").alias("n"), F.countDistinct("speaker_id").alias("n_speakers"), F.round(F.avg("value"), 6).alias("mean")).select(F.lit("installed").alias("stage"), "flag", "n", "n_speakers", "mean")
    return rows.unionByName(spark.range(1).select(F.lit("refused").alias("stage"), *[F.lit(None).cast(t).alias(c) for c, t in (("flag", "string"), ("n", "long"))], F.lit(least).cast("long").alias("n_speakers"), F.lit(None).cast("double").alias("mean")))

"""Links in ELAN documents, structured JSON documents, and the order of a forest."""

import json
from xml.etree import ElementTree as ET

import pytest
from pyspark.sql import functions as F

from sonospan import workflow
from sonospan.sources import formats, readers
from sonospan.store import Corpus, StoreError


def corpus(spark, tmp_path, name):
    return Corpus(spark, str(tmp_path / name), "ann", lambda: "2024-01-01T00:00:00.000Z")


def linked(spark, tmp_path):
    c = corpus(spark, tmp_path, "one")
    b = c.add("bundle", [{"name": "one", "audio_relative_path": "a.wav", "sample_rate": 100, "n_frames": 250}])[0]
    words = c.add("tier", [{"bundle_id": b, "name": "words", "type": "interval"}])[0]
    notes = c.add("tier", [{"bundle_id": b, "name": "notes", "type": "reference", "parent_id": words, "cardinality": "one_to_many"}])[0]
    remarks = c.add("tier", [{"bundle_id": b, "name": "remarks", "type": "reference", "parent_id": notes, "cardinality": "one_to_many"}])[0]
    w = c.add("annotation_interval", [{"tier_id": words, "start_seconds": s, "end_seconds": s + 0.5, "label": x, "extra": e} for s, x, e in ((0.0, "a", None), (0.5, "b", '{"k":1}'))])
    rows = [
        {"id": 70, "tier_id": notes, "target_kind": "interval", "target_id": w[0], "label": "on b, to a", "parent_annotation_id": w[1], "extra": None},
        {"id": 71, "tier_id": notes, "target_kind": "bundle", "target_id": 9, "label": "on nothing", "parent_annotation_id": None, "extra": '{"x":[1]}'},
        {"id": 72, "tier_id": remarks, "target_kind": "reference", "target_id": 71, "label": "on the first note, to the second", "parent_annotation_id": 70, "extra": None},
    ]
    c.commit([("annotation_reference", "insert", c.frame("annotation_reference", rows))])
    return c, b


def test_links_survive_a_round_trip(spark, tmp_path):
    c, b = linked(spark, tmp_path)
    texts = workflow.export_eafs(c)
    root = ET.fromstring(texts.first().text)
    refs = {a.findtext("ANNOTATION_VALUE").split(" {json")[0]: a.get("ANNOTATION_REF") for a in root.iter("REF_ANNOTATION")}
    names = {a.findtext("ANNOTATION_VALUE").split(" {json")[0]: a.get("ANNOTATION_ID") for a in root.iter() if a.get("ANNOTATION_ID")}
    assert refs == {"on b, to a": names["b"], "on nothing": names["a"], "on the first note, to the second": names["on b, to a"]}
    other = corpus(spark, tmp_path, "two")
    other.add("bundle", [{"name": "x", "audio_relative_path": "x.wav"}, {"name": "y", "audio_relative_path": "y.wav"}])
    tier = other.add("tier", [{"bundle_id": 2, "name": "old", "type": "interval"}])[0]
    other.add("annotation_interval", [{"tier_id": tier, "start_seconds": 0.0, "end_seconds": 1.0}] * 5)  # so that ids differ
    assert workflow.import_tiers(other, readers.parsed_texts(texts, formats.parse_eaf, readers.EAF), "import:eaf") == 3
    w = {r.label: r for r in other.table("annotation_interval").filter("label is not null").collect()}
    n = {r.label: r for r in other.table("annotation_reference").collect()}
    assert w["b"].extra == '{"k":1}' and w["a"].extra is None and w["a"].id > 5
    first, second, remark = n["on b, to a"], n["on nothing"], n["on the first note, to the second"]
    assert (first.parent_annotation_id, first.target_kind, first.target_id) == (w["b"].id, "interval", w["a"].id)
    assert (second.parent_annotation_id, second.target_kind, second.target_id, second.extra) == (None, "bundle", 9, '{"x":[1]}')
    assert (remark.parent_annotation_id, remark.target_kind, remark.target_id) == (first.id, "reference", second.id)
    tiers = {r.name: r for r in other.table("tier").collect()}
    assert tiers["remarks"].parent_id == tiers["notes"].id and tiers["notes"].parent_id == tiers["words"].id
    for table in ("annotation_interval", "annotation_reference"):
        rows = other.table(table).join(other.table("tier").filter("name in ('words', 'notes')").select(F.col("id").alias("tier_id")), "tier_id", "left_semi")
        assert other.violations(table, rows.select(*other.table(table).columns)).collect() == []


def test_refs_that_name_nothing_are_left_out(spark, tmp_path):
    text = """<ANNOTATION_DOCUMENT><TIER TIER_ID="r" LINGUISTIC_TYPE_REF="s"><ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a1" ANNOTATION_REF="a9"><ANNOTATION_VALUE>x</ANNOTATION_VALUE></REF_ANNOTATION></ANNOTATION>
    <ANNOTATION><REF_ANNOTATION ANNOTATION_ID="a2" ANNOTATION_REF=""><ANNOTATION_VALUE/></REF_ANNOTATION></ANNOTATION></TIER><LINGUISTIC_TYPE LINGUISTIC_TYPE_ID="s" CONSTRAINTS="Symbolic_Association"/></ANNOTATION_DOCUMENT>"""
    c = corpus(spark, tmp_path, "one")
    c.add("bundle", [{"name": "x", "audio_relative_path": "x.wav"}])
    workflow.import_tiers(c, readers.parsed_texts(spark.createDataFrame([(1, text)], "bundle_id long, text string"), formats.parse_eaf, readers.EAF), "import:eaf")
    assert [(r.label, r.parent_annotation_id, r.target_kind, r.target_id) for r in c.table("annotation_reference").orderBy(F.desc("label")).collect()] == [("x", None, "annotation", 0), ("", None, "annotation", 0)]


def test_structured_documents(spark, tmp_path):
    c, b = linked(spark, tmp_path)
    marks = c.add("tier", [{"bundle_id": b, "name": 'ma"rks', "type": "point"}])[0]
    c.add("annotation_point", [{"tier_id": marks, "time_seconds": 0.25, "label": None, "note": "n", "extra": "not json"}])
    c.add("bundle", [{"name": "bare", "audio_relative_path": "b.wav"}])
    found = {r.bundle_id: json.loads(r.json) for r in workflow.export_json(c).collect()}
    assert found[2] == {"bundle": {"id": 2, "name": "bare", "sample_rate": None, "n_frames": None, "duration_seconds": None}, "tiers": []}
    assert found[b]["bundle"] == {"id": b, "name": "one", "sample_rate": 100, "n_frames": 250, "duration_seconds": 2.5}
    tiers = {t["name"]: t for t in found[b]["tiers"]}
    assert list(tiers) == ["words", "notes", "remarks", 'ma"rks'] and tiers["words"]["type"] == "interval"
    assert tiers["words"]["intervals"][1] == {"id": 2, "start_seconds": 0.5, "end_seconds": 1.0, "label": "b", "parent_annotation_id": None, "status": None, "note": None, "processing_run_id": None, "extra": {"k": 1}}
    assert tiers['ma"rks']["points"] == [{"id": 1, "time_seconds": 0.25, "label": None, "parent_annotation_id": None, "status": None, "note": "n", "processing_run_id": None, "extra": "not json"}]
    assert tiers["notes"]["references"][1] == {"id": 71, "target_kind": "bundle", "target_id": 9, "label": "on nothing", "parent_annotation_id": None, "extra": {"x": [1]}}
    other = corpus(spark, tmp_path, "two")
    other.add("bundle", [{"name": "x", "audio_relative_path": "x.wav"}])
    assert workflow.import_json(other, workflow.export_json(c).filter("bundle_id = 1")) == 2  # references are skipped
    assert [(r.start_seconds, r.end_seconds, r.label, r.extra) for r in other.table("annotation_interval").orderBy("start_seconds").collect()] == [(0.0, 0.5, "a", None), (0.5, 1.0, "b", '{"k":1}')]
    assert [(r.time_seconds, r.label, r.note, r.extra) for r in other.table("annotation_point").collect()] == [(0.25, None, "n", "not json")]


@pytest.mark.parametrize(("text", "why"), [('{"bundle":{}}', "tiers"), ('{"tiers":[{"name":"a","type":"interval","intervals":[{"start_seconds":1}]}]}', "times"), ('{"tiers":[{"name":"a","type":"point","points":[{"label":"x"}]}]}', "times")])
def test_documents_that_lack_something(spark, text, why):
    with pytest.raises(Exception, match=why):
        readers.parsed_json(spark.createDataFrame([(1, text)], "bundle_id long, json string")).collect()


def test_a_deep_forest_is_ordered_in_few_rounds(spark):
    n = 100_000
    chain = spark.range(n).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"))
    assert workflow.parents_first(chain).filter("level <> id").isEmpty()
    trees = [(1, None), (2, 1), (3, 1), (4, 3), (10, None), (11, 10)]
    got = {r.id: r.level for r in workflow.parents_first(spark.createDataFrame(trees, "id long, parent_id long")).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 10: 0, 11: 1}
    assert workflow.parents_first(spark.createDataFrame([], "id long, parent_id long")).collect() == []


@pytest.mark.parametrize(("rows", "why"), [([(1, None), (2, 9)], "missing parent"), ([(1, None), (2, 4), (3, 2), (4, 3)], "own ancestor"), ([(1, 1)], "own ancestor")])
def test_forests_that_are_none(spark, rows, why):
    with pytest.raises(StoreError, match=why):
        workflow.parents_first(spark.createDataFrame(rows, "id long, parent_id long"))


def test_links_between_ids_that_doubles_cannot_tell_apart(spark, tmp_path):
    c, big = corpus(spark, tmp_path, "one"), (1 << 53) + 1
    b = c.add("bundle", [{"name": "one", "audio_relative_path": "a.wav"}])[0]
    words = c.add("tier", [{"bundle_id": b, "name": "words", "type": "interval"}])[0]
    notes = c.add("tier", [{"bundle_id": b, "name": "notes", "type": "reference", "parent_id": words, "cardinality": "one_to_many"}])[0]
    c.commit([("annotation_interval", "insert", c.frame("annotation_interval", [{"id": big + i, "tier_id": words, "start_seconds": i * 1.0, "end_seconds": i + 1.0, "label": f"w{i}"} for i in range(3)]))])
    rows = [{"id": 7, "tier_id": notes, "target_kind": "interval", "target_id": big, "label": "n"}, {"id": 8, "tier_id": notes, "target_kind": "interval", "target_id": big + 2, "parent_annotation_id": big + 1, "label": "m"}]
    c.commit([("annotation_reference", "insert", c.frame("annotation_reference", rows))])
    found = {r["label"].split(" {json")[0]: r for r in formats.parse_eaf(workflow.export_eafs(c).first().text)}
    told = {k: json.loads(formats.decode_label(found[k]["label"])[1]) for k in "nm"}
    assert told["n"]["target"] == found["w0"]["annotation"] and told["m"]["target"] == found["w2"]["annotation"]
    assert found["m"]["ref"] == found["w1"]["annotation"] and "placeholder" not in told["m"]


def test_small_documents_travel_together(spark):
    text = formats.write_textgrid([("t", "interval", [(0.0, 1.0, "a")])], 1.0)
    texts = spark.range(40).coalesce(1).select(F.col("id").alias("bundle_id"), F.lit(text).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    assert [r.n for r in readers.parsed_texts(texts, formats.parse_textgrid, readers.TEXTGRID).mapInArrow(sizes, "n long").collect()] == [40]


def test_textgrids_come_from_rows_in_order(spark):
    rows = [(b, 2 * b + k, f"t{k}", "interval", float(i), i + 1.0, f"{b} {k} {i}" if i else None) for i in (2, 0, 1) for b in range(30) for k in (1, 0)]
    frame = spark.createDataFrame(rows, "bundle_id long, tier_id long, tier string, kind string, start double, end double, label string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)  # documents go over the ends of batches
    try:
        made = readers.write_textgrids(frame, spark.range(30).select(F.col("id").alias("bundle_id"), F.lit(3.0).alias("duration")))
        found = {r.bundle_id: r.text for r in made.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = lambda b: formats.write_textgrid([(f"t{k}", "interval", [(float(i), i + 1.0, f"{b} {k} {i}" if i else "") for i in range(3)]) for k in (0, 1)], 3.0)
    assert found == {b: want(b) for b in range(30)}
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()  # no call for each bundle


def test_rows_of_structured_documents_meet_once(spark, tmp_path):
    c, _ = linked(spark, tmp_path)
    plan = workflow.export_json(c)._jdf.queryExecution().executedPlan().toString()
    met = [line for line in plan.splitlines() if "hashpartitioning(bundle_id" in line]
    assert len(met) <= 2 and not any("tier_id" in line.split("hashpartitioning(")[1].split(")")[0] for line in met)


def test_a_table_without_rows_needs_no_job(spark, tmp_path):
    empty = corpus(spark, tmp_path, "none").table("annotation_point")
    assert empty.columns[0] == "id" and empty.isEmpty() and "LocalTableScan <empty>" in empty._jdf.queryExecution().executedPlan().toString()

"""Annotator packages and presets."""

import pytest
from pyspark.sql import functions as F

from sonospan.packages import export_package, import_package
from sonospan.presets import Preset, PresetStore
from sonospan.store import Corpus, StoreError


def test_package_round_trip(spark, tmp_path):
    c = Corpus(spark, str(tmp_path / "corpus"), "pi", lambda: "2024-01-01T00:00:00.000Z")
    a, b = c.add("bundle", [{"name": "one", "audio_relative_path": "a"}, {"name": "two", "audio_relative_path": "b"}])
    tier, _ = c.add("tier", [{"bundle_id": a, "name": "phones", "type": "interval"}, {"bundle_id": b, "name": "phones", "type": "interval"}])
    c.add("annotation_interval", [{"tier_id": tier, "start_seconds": 0.0, "end_seconds": 1.0, "label": "x"}])
    target = c.add("target", [{"bundle_id": a, "start_seconds": 0.0, "end_seconds": 1.0, "status": "unassigned"}])[0]
    c.add("assignment", [{"target_id": target, "annotator": "ann", "status": "assigned"}])
    package = export_package(c, "ann", str(tmp_path / "package"))
    assert [r.name for r in package.table("bundle").collect()] == ["one"] and package.table("annotation_interval").count() == 1
    for _ in range(2):  # a second import replaces the first
        assert import_package(c, package, "ann") == {"bundles": 1, "tiers": 1, "annotations": 1}
    assert c.table("tier").filter("name = 'phones [ann]'").count() == 1 and c.table("annotation_interval").count() == 2
    assert c.table("assignment").filter(F.col("status") == "done").count() == 1
    with pytest.raises(StoreError):
        export_package(c, "nobody", str(tmp_path / "other"))


def test_a_changed_table_reads_only_what_is_asked_for(spark, tmp_path):
    c = Corpus(spark, str(tmp_path))
    row = {"start_seconds": 0.0, "end_seconds": 1.0, "status": "unassigned", "label": "x"}
    bundle = c.add("bundle", [{"name": "one", "audio_relative_path": "a"}])[0]
    a, b, d, _ = c.add("target", [{**row, "bundle_id": bundle}] * 4)
    c.update("target", F.col("id") != d, {"label": F.lit("y")})
    c.update("target", F.col("id") == a, {"label": F.lit("z")})
    c.delete("target", F.col("id") == b)
    assert sorted((r.id, r.label) for r in c.table("target").collect()) == [(a, "z"), (d, "x"), (d + 1, "y")]
    c.append("target", c.frame("target", [{**row, "id": b, "bundle_id": bundle}]))  # a deleted row comes back
    assert sorted((r.id, r.label) for r in c.table("target").collect()) == [(a, "z"), (b, "x"), (d, "x"), (d + 1, "y")]
    assert [r.label for r in c.as_of(3).table("target").filter(F.col("id") == b).collect()] == ["y"]
    plan = c.table("target").select("id", "bundle_id")._jdf.queryExecution().executedPlan().toString()
    assert "bundle_id" in plan and "note" not in plan and "start_seconds" not in plan and "SortAggregate" not in plan


def test_presets(tmp_path):
    s = PresetStore(str(tmp_path), "pitch")
    s.save(Preset("low-voices", "pitch", based_on="boersma", params={"lo": 50.0}))
    assert s.get("low-voices").params == {"lo": 50.0} and s.list()[-1].id == "low-voices" and s.get("yin") is not None
    for bad in ("yin", "No Good", ""):
        with pytest.raises(ValueError, match="reserved"):
            s.save(Preset(bad, "pitch"))
    assert s.delete("low-voices") and not s.delete("low-voices")

"""Packages of reference distributions: written, checked, installed, found."""

import os

import pytest

from sonospan import refdists
from sonospan.store import StoreError

ABOUT = {"id": "vowels", "version": "1.0", "title": 'Vowels "A"', "license": "CC0-1.0", "measure": {"kind": "observed_distribution", "parameters": ["F1", "F2"], "phones": ["a"]}, "population": {"language": "eng", "sex": ["female"], "n_speakers": 3}, "privacy": {"shareability": "raw_samples", "min_n_per_subgroup": 2, "subgroups": ["phone"]}}


def data(spark, rows=((1, "a", 1.0), (2, "a", 2.0), (1, "e", 3.0), (3, "e", 3.0))):
    return spark.createDataFrame(list(rows), "speaker_id long, phone string, value double")


def changed(**tables):
    return {k: ABOUT[k] | v if isinstance(v, dict) else v for k, v in (ABOUT | tables).items() if v is not None} | {k: v for k, v in tables.items() if k not in ABOUT}


def test_a_package_round_trips(spark, tmp_path):
    made = refdists.scaffold(spark, str(tmp_path / "p"), ABOUT, "How it was made.", data(spark))
    assert refdists.manifest_of(spark, str(tmp_path / "p")) == made
    assert (tmp_path / "p" / "provenance.md").read_text() == "How it was made.\n" and "CC0-1.0" in (tmp_path / "p" / "LICENSE").read_text()
    assert refdists.validate(spark, str(tmp_path / "p"), refdists.CURATED) == []
    assert made["schema"]["n_rows"] == 4 and refdists.checksum(data(spark).repartition(4).orderBy("value")) == (4, made["schema"]["checksum"])


@pytest.mark.parametrize(("manifest", "tier", "level", "why"), [
    (changed(id=None), 3, "error", "'id'"), (changed(measure={"kind": "guess"}), 3, "error", "measure.kind"), (changed(license=None), 3, "error", "no license"), (changed(license="CC-BY-NC-4.0"), 2, "error", "not free"),
    (changed(license="CC-BY-NC-4.0"), 3, "warning", "not free"), (changed(license="MIT"), 2, "warning", "curated"), (changed(privacy={"min_n_per_subgroup": 3}), 2, "error", "2 distinct speakers"), (changed(privacy={"min_n_per_subgroup": 3}), 3, "warning", "2 distinct"),
])
def test_rules_of_a_manifest(spark, tmp_path, manifest, tier, level, why):
    refdists.scaffold(spark, str(tmp_path / "p"), {k: v for k, v in manifest.items() if v is not None}, "", data(spark))
    found = refdists.validate(spark, str(tmp_path / "p"), tier)
    assert len(found) == 1 and found[0][0] == level and why in found[0][1]


def test_damaged_packages(spark, tmp_path):
    path = str(tmp_path / "p")
    assert refdists.validate(spark, path) == [("error", "no refdist.toml")]
    refdists.scaffold(spark, path, ABOUT, "", data(spark))
    data(spark, [(9, "a", 9.0), (8, "a", 9.0)]).write.mode("append").parquet(f"{path}/data.parquet")
    assert [w for _, w in refdists.validate(spark, path)] == ["the data is not what the manifest was written for"]
    with pytest.raises(StoreError, match="written for"):
        refdists.install(spark, str(tmp_path / "store"), path)
    assert not os.path.exists(tmp_path / "store")
    refdists.Folder(spark, path).write("LICENSE", " ")
    data(spark).withColumnRenamed("value", "x").write.mode("overwrite").parquet(f"{path}/data.parquet")
    assert [w for _, w in refdists.validate(spark, path)][0].startswith("missing or empty LICENSE") and "columns" in refdists.validate(spark, path)[1][1]
    refdists.Folder(spark, path).write("refdist.toml", "id = ")
    assert "does not parse" in refdists.validate(spark, path)[0][1]


def test_installing_and_finding(spark, tmp_path):
    store = str(tmp_path / "store")
    for k, (version, language) in enumerate((("1.0", "eng"), ("2.0", "deu"))):
        refdists.scaffold(spark, str(tmp_path / f"p{k}"), changed(version=version, population={"language": language}), "", data(spark))
        assert refdists.install(spark, store, str(tmp_path / f"p{k}")).endswith(f"vowels__{version}")
    assert refdists.install(spark, store, str(tmp_path / "p0")).endswith("vowels__1.0")  # again
    refdists.scaffold(spark, str(tmp_path / "other"), changed(title="Other"), "", data(spark))
    with pytest.raises(StoreError, match="another manifest"):
        refdists.install(spark, store, str(tmp_path / "other"))
    os.makedirs(tmp_path / "store" / "junk")
    (tmp_path / "store" / "junk" / "refdist.toml").write_text("= broken")
    every = refdists.installed(spark, store)
    assert [(r.id, r.version, r.title) for r in every.collect()] == [("vowels", "1.0", 'Vowels "A"'), ("vowels", "2.0", 'Vowels "A"')]
    assert [r.version for r in refdists.found(every, language="DEU", parameter="f2", sex="Female", phone="a", kind=None).collect()] == ["2.0"]
    assert refdists.found(every, age_band="18-30").collect() == [] and refdists.installed(spark, str(tmp_path / "none")).collect() == []

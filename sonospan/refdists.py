"""Packages of reference distributions: a manifest, its provenance and licence, and the data as Parquet; checked by Spark, installed as a whole or not at all.

A package is a folder on any file system that Spark reads.  Its manifest carries
the number of rows and a checksum that does not depend on their order or files,
so a copy is known to be whole.  Installing checks a package first: the rules of
the manifest, the data's columns and checksum, and k-anonymity, by the whole data
and by each subgroup that the manifest names.  It writes aside and renames last.
"""

from __future__ import annotations

import json
import tomllib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sonospan.store import StoreError

# The kinds of measures, and the licences that the curated tier takes.
KINDS = ("observed_distribution", "summary_normative_range", "target_zone")
CURATED_LICENSES = ("CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "ODC-BY-1.0", "ODbL-1.0")
CURATED, COMMUNITY = 2, 3


def toml(manifest: dict, path: tuple[str, ...] = ()) -> str:
    """A manifest as TOML: plain values first, then its tables."""
    plain = {k: v for k, v in manifest.items() if v is not None and not isinstance(v, dict)}
    lines = [f"[{'.'.join(path)}]"] * bool(path) + [f"{k} = {json.dumps(v, ensure_ascii=False)}" for k, v in plain.items()]
    parts = ["\n".join(lines)] * bool(lines) + [toml(v, (*path, k)) for k, v in manifest.items() if isinstance(v, dict)]
    return "\n\n".join(parts)


class Folder:
    """A folder on the file system of its path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._path().getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str = ""):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}".rstrip("/"))

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        if not self.has(name) or self.fs.getFileStatus(self._path(name)).isDirectory():
            return None
        stream = self.fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        stream = self.fs.create(self._path(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def rename(self, to: Folder) -> bool:
        self.fs.mkdirs(to._path().getParent())
        return not to.has() and self.fs.rename(self._path(), to._path())


def checksum(data: DataFrame) -> tuple[int, str]:
    """Rows and a sum of their hashes: the same in any order, another if a row is changed, lost or doubled."""
    row = F.xxhash64(*[F.struct(F.lit(k), F.col(f"`{c}`")) for k, c in enumerate(data.columns)])
    found = data.agg(F.count("*").alias("n"), F.sum(row.cast("decimal(38,0)")).alias("s")).first()
    return found["n"], f"{int(found['s'] or 0) % (1 << 128):032x}"


def scaffold(spark: SparkSession, path: str, manifest: dict, provenance: str = "", data: DataFrame | None = None) -> dict:
    """Write a package and return its manifest; the data's columns, rows and checksum are filled in."""
    folder = Folder(spark, path)
    schema = {"data_file": "data.parquet"} | manifest.get("schema", {})
    if data is not None:
        data.write.mode("errorifexists").parquet(f"{folder.path}/{schema['data_file']}")
        n, total = checksum(spark.read.parquet(f"{folder.path}/{schema['data_file']}"))
        schema |= {"columns": data.columns, "n_rows": n, "checksum": total}
    manifest = manifest | {"schema": schema}
    folder.write("refdist.toml", toml(manifest) + "\n")
    folder.write("provenance.md", provenance.rstrip() + "\n" if provenance.strip() else "# Provenance\n\nTo be written: the source corpus, its sampling and the method.\n")
    spdx = manifest.get("license") or "LicenseRef-UNSPECIFIED"
    folder.write("LICENSE", f"SPDX-License-Identifier: {spdx}\n\nTo be written: the full text of the {spdx} license.\n")
    return manifest


def manifest_of(spark: SparkSession, path: str) -> dict:
    text = Folder(spark, path).read("refdist.toml")
    if text is None:
        raise StoreError(f"{path}: no refdist.toml")
    try:
        return tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise StoreError(f"{path}: refdist.toml does not parse: {e}") from None


def validate(spark: SparkSession, path: str, tier: int = COMMUNITY) -> list[tuple[str, str]]:
    """("error" or "warning", what is wrong) of a package, by the rules of its tier."""
    found: list[tuple[str, str]] = []
    strict = "error" if tier == CURATED else "warning"
    try:
        m = manifest_of(spark, path)
    except StoreError as e:
        return [("error", str(e).removeprefix(f"{path}: "))]
    folder = Folder(spark, path)
    found += [("error", f"missing required top-level field {name!r}") for name in ("id", "version") if not m.get(name)]
    kind = m.get("measure", {}).get("kind", KINDS[0])
    if kind not in KINDS:
        found.append(("error", f"unknown measure.kind {kind!r}"))
    spdx = m.get("license")
    if not spdx:
        found.append(("error", "no license"))
    elif "-NC" in spdx.upper() or "-ND" in spdx.upper():
        found.append((strict, f"license {spdx} is not free"))
    elif tier == CURATED and spdx not in CURATED_LICENSES:
        found.append(("warning", f"license {spdx} is not one of the curated tier"))
    if not (folder.read("LICENSE") or "").strip():
        found.append(("error", "missing or empty LICENSE file"))
    privacy, schema = m.get("privacy", {}), m.get("schema", {})
    least = privacy.get("min_n_per_subgroup")
    if least is None:
        found.append(("error", "privacy.min_n_per_subgroup is required"))
    name = schema.get("data_file")
    if not name:
        return [*found, ("error", "schema.data_file is required")]
    if not folder.has(name):
        return [*found, ("error", f"declared data file {name} is missing")]
    data = spark.read.parquet(f"{folder.path}/{name}")
    if schema.get("columns") and list(schema["columns"]) != data.columns:
        return [*found, ("error", f"data columns {data.columns} are not the declared {schema['columns']}")]
    if "checksum" in schema and checksum(data) != (schema.get("n_rows"), schema["checksum"]):
        found.append(("error", "the data is not what the manifest was written for"))
    if privacy.get("shareability") == "raw_samples" and least is not None and "speaker_id" in data.columns:
        subgroups = [c for c in privacy.get("subgroups", []) if c in data.columns]
        cells = data.groupBy(*subgroups).agg(F.countDistinct("speaker_id").alias("n"))
        worst = cells.agg(F.min("n").alias("n"), F.count_if(F.col("n") < least).alias("cells")).first()
        if worst["n"] is None or worst["cells"]:
            found.append((strict, f"{worst['n'] or 0} distinct speakers in a subgroup, fewer than {least}"))
    return found


def install(spark: SparkSession, root: str, source: str, tier: int = COMMUNITY) -> str:
    """Copy a package to ``<id>__<version>`` below ``root`` and return its path; one with errors is refused.

    Data is copied by Spark and counted again before the rename that makes it
    visible.  The same package again changes nothing; another one of the same id and
    version is refused.
    """
    wrong = [what for level, what in validate(spark, source, tier) if level == "error"]
    if wrong:
        raise StoreError(f"{source}: {'; '.join(wrong)}")
    m, src = manifest_of(spark, source), Folder(spark, source)
    to = Folder(spark, f"{root.rstrip('/')}/{m['id']}__{m['version']}")
    if to.has():
        if to.read("refdist.toml") == src.read("refdist.toml"):
            return to.path
        raise StoreError(f"{to.path} is there with another manifest")
    aside = Folder(spark, f"{root.rstrip('/')}/_aside/{uuid.uuid4().hex}")
    name = m["schema"]["data_file"]
    data = spark.read.parquet(f"{src.path}/{name}")
    data.write.parquet(f"{aside.path}/{name}")
    if checksum(spark.read.parquet(f"{aside.path}/{name}")) != checksum(data):
        raise StoreError(f"{source}: the copy differs")
    for text in ("provenance.md", "LICENSE", "refdist.toml"):
        if (content := src.read(text)) is not None:
            aside.write(text, content)
    if not aside.rename(to):
        raise StoreError(f"{to.path} was installed meanwhile")
    return to.path


INSTALLED = "id string, version string, title string, kind string, language string, variety string, sex array<string>, age_band array<string>, parameters array<string>, phones array<string>, license string, path string"


def installed(spark: SparkSession, root: str) -> DataFrame:
    """A row for each package below ``root`` whose manifest can be read, with what is asked for by."""
    base = Folder(spark, root)
    if not base.has():
        return spark.createDataFrame([], INSTALLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, texts = pa.list_(pa.string()), pa.string()
        schema = pa.schema([(c.split()[0], lists if "array" in c else texts) for c in INSTALLED.split(", ")])
        for batch in batches:
            rows = []
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    m = tomllib.loads(content.as_py().decode())
                except (tomllib.TOMLDecodeError, UnicodeDecodeError):
                    continue
                if m.get("id") and m.get("version"):
                    measure, population = m.get("measure", {}), m.get("population", {})
                    rows.append({"id": m["id"], "version": m["version"], "title": m.get("title"), "kind": measure.get("kind", KINDS[0]), "language": population.get("language"), "variety": population.get("variety"), "license": m.get("license"), "path": path.rsplit("/", 1)[0]}
                        | {c: list(population.get(c, [])) for c in ("sex", "age_band")} | {c: list(measure.get(c, [])) for c in ("parameters", "phones")})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "refdist.toml").option("recursiveFileLookup", "true").load(base.path).filter(~F.col("path").contains("/_aside/"))
    return found.select("path", "content").mapInArrow(run, INSTALLED).orderBy("id", "version")


def found(packages: DataFrame, **wanted: str | None) -> DataFrame:
    """Packages that meet every facet given: kind, language, variety, sex, age_band, parameter or phone, whatever the letters' case."""
    for facet, value in wanted.items():
        if value is None:
            continue
        many = {"sex": "sex", "age_band": "age_band", "parameter": "parameters", "phone": "phones"}.get(facet)
        low = value.lower()
        packages = packages.filter(F.array_contains(F.transform(many, F.lower), low) if many else F.lower(facet) == low)
    return packages

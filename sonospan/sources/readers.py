"""Sources and sinks as DataFrames: audio, annotation files, dense signals, tables of annotations."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sonospan.sources import formats

# The columns of the tabular exchange format, in order.
CSV_COLUMNS = (
    "bundle_id bundle_name tier_id tier_name tier_type annotation_id start_seconds end_seconds time_seconds target_kind target_id label parent_annotation_id status note processing_run_id extra"
).split()
CSV_SCHEMA = ", ".join(f"{c} {'double' if c.endswith('seconds') else 'long' if c.endswith('_id') else 'string'}" for c in CSV_COLUMNS)
TEXTGRID = "path string, tier string, kind string, position int, start double, end double, label string"
EAF = "path string, tier string, parent string, kind string, position int, start double, end double, label string, annotation string, ref string"


def files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """path, sample_rate, channels, samples (interleaved).  A file is decoded in one task; nothing passes the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, data in zip(batch.column(0), batch.column(1), strict=True):
                rate, channels, samples = formats.decode_wav(data.as_py())
                yield pa.RecordBatch.from_arrays([pa.array([p.as_py()]), pa.array([rate], pa.int32()), pa.array([channels], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples))], ["path", "sample_rate", "channels", "samples"])

    return files(spark, path, "*.wav").select("path", "content").mapInArrow(run, "path string, sample_rate int, channels int, samples array<float>")


def probe_wav(spark: SparkSession, path: str) -> DataFrame:
    """Header facts; no sample is decoded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, **formats.probe_wav(head, size)} for p, head, size in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("n_frames", pa.int64()), ("decoded_bytes", pa.int64())]))

    rows = files(spark, path, "*.wav").select("path", F.substring("content", 1, 65536).alias("head"), F.col("length").cast("long"))
    return rows.mapInArrow(run, "path string, sample_rate int, channels int, n_frames long, decoded_bytes long").withColumn("duration_seconds", F.col("n_frames") / F.col("sample_rate"))


def to_mono(audio: DataFrame) -> DataFrame:
    """Channels averaged; samples stay in order."""
    # the count goes by another name: inside a lambda a replaced column would be found first
    n = F.col("_n")
    mean = F.transform(F.sequence(F.lit(0), F.floor(F.size("samples") / n).cast("int") - 1), lambda i: F.aggregate(F.slice("samples", i * n + 1, n), F.lit(0.0), lambda s, v: s + v) / n)
    made = audio.withColumn("_n", F.col("channels")).withColumn("_mono", F.when(n == 1, F.col("samples").cast("array<double>")).otherwise(mean).cast("array<float>"))
    return made.withColumns({"samples": F.col("_mono"), "channels": F.lit(1)}).drop("_n", "_mono")


def split_chunks(audio: DataFrame, seconds: float, key: str = "path") -> DataFrame:
    """Contiguous pieces of at least 0.1 s asked for; the last may be short."""
    size = (F.greatest(F.lit(seconds), F.lit(0.1)) * F.col("sample_rate")).cast("int") * F.col("channels")
    starts = F.sequence(F.lit(0), F.greatest(F.size("samples") - 1, F.lit(0)), size)
    return audio.select(key, "sample_rate", "channels", "samples", size.alias("_size"), F.posexplode(starts).alias("chunk", "_at")).select(key, "chunk", "sample_rate", "channels", F.slice("samples", F.col("_at") + 1, F.col("_size")).alias("samples"))


#: Rows of small documents travel together, up to about so many.
BATCH_ROWS = 20_000


def _arrow_types(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64()}.get(t, pa.string())) for n, t in (c.split() for c in schema.split(", "))]


def _documents_parsed(rows: DataFrame, read, parse, schema: str) -> DataFrame:
    """``parse(read(content))``, lists by column, of each row (key, content): the key, the first column of ``schema``, and the parsed ones."""
    (key, key_type), *types = _arrow_types(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {n: [] for n in (key, *(n for n, _ in types))}

        def taken() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held[n], t) for n, t in ((key, key_type), *types)], list(held))
            for values in held.values():
                values.clear()
            return made

        for batch in batches:
            for k, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = parse(read(content.as_py()))
                n = len(found[types[0][0]])
                held[key] += [k] * n
                for name, _ in types:
                    held[name] += found[name]
                if len(held[key]) >= BATCH_ROWS:
                    yield taken()
        if held[key]:
            yield taken()

    return rows.mapInArrow(run, schema)


def _parsed(spark: SparkSession, path: str, pattern: str, parse, schema: str) -> DataFrame:
    read = lambda content: content.decode("utf-16" if content[:2] in (b"\xff\xfe", b"\xfe\xff") else "utf-8-sig")
    return _documents_parsed(files(spark, path, pattern).select("path", "content"), read, parse, schema)


def parsed_texts(rows: DataFrame, parse, schema: str) -> DataFrame:
    """Annotations of documents given as rows (bundle_id, text): bundle_id and the parser's columns."""
    schema, known = schema.replace("path string", "bundle_id long", 1), {formats.parse_eaf: formats.eaf_columns, formats.parse_textgrid: formats.textgrid_columns}

    def listed(text: str) -> dict[str, list]:
        found = parse(text)
        return {n: [r.get(n) for r in found] for n, _ in _arrow_types(schema)}

    return _documents_parsed(rows.select("bundle_id", "text"), str, known.get(parse, listed), schema)


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    rows = _parsed(spark, path, "*.TextGrid", formats.textgrid_columns, TEXTGRID)
    return rows.withColumn("_l", _decoded(F.col("label"))).withColumns({"label": F.col("_l.label"), "extra": F.col("_l.extra")}).drop("_l")


def _decoded(label):
    from sonospan.functions.columns import decode_label

    return decode_label(label)


def read_eaf(spark: SparkSession, path: str) -> DataFrame:
    return _parsed(spark, path, "*.eaf", formats.eaf_columns, EAF)


def read_annotations_csv(spark: SparkSession, path: str) -> DataFrame:
    """The tabular format, by header name; rows of reference and dense tiers are skipped."""
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("enforceSchema", False).csv(path)
    have = set(rows.columns)
    typed = {f.split()[0]: f.split()[1] for f in CSV_SCHEMA.split(", ")}
    rows = rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(typed[c]).alias(c) for c in CSV_COLUMNS])
    return rows.filter(F.col("tier_type").isin("interval", "point"))


def write_annotations_csv(rows: DataFrame, path: str) -> None:
    """One row an annotation, CRLF line ends, blanks for what does not apply."""
    full = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).cast("string").alias(c) for c in CSV_COLUMNS])
    full.write.option("header", True).option("lineSep", "\r\n").option("escape", '"').mode("overwrite").csv(path)


# The documents of the structured exchange format.
JSON_ROWS = {
    "interval": ("intervals", "id start_seconds end_seconds label parent_annotation_id status note processing_run_id extra".split()),
    "point": ("points", "id time_seconds label parent_annotation_id status note processing_run_id extra".split()),
    "reference": ("references", "id target_kind target_id label parent_annotation_id extra".split()),
}


def tiers_json(rows: DataFrame, bundles: DataFrame) -> DataFrame:
    """(bundle_id, json): a document of each bundle's sparse tiers, nulls kept.

    ``rows``: the columns of the tabular format; ``bundles``: bundle_id, name,
    sample_rate, n_frames.  ``extra`` is embedded as JSON where it is JSON, else as
    a text.
    """
    text = F.to_json(F.array("extra"))
    extra = F.when(F.col("extra").isNotNull(), F.coalesce(F.try_parse_json("extra"), F.parse_json(F.substr(text, F.lit(2), F.length(text) - 2))))
    # a bundle's rows meet once, before they are texts; its tiers and its document are made where they are
    made = rows.filter(F.col("tier_type").isin(*JSON_ROWS)).repartition("bundle_id").withColumn("extra", extra).withColumn("id", F.col("annotation_id"))
    begin = F.coalesce("start_seconds", "time_seconds", F.lit(0.0))
    item = F.coalesce(*[F.when(F.col("tier_type") == kind, F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})) for kind, (_, columns) in JSON_ROWS.items()])
    listing = F.coalesce(*[F.when(F.col("tier_type") == kind, F.lit(name)) for kind, (name, _) in JSON_ROWS.items()])
    # a variant has no order, so rows are sorted by their keys and the items fetched after them
    grouped = made.groupBy("bundle_id", "tier_id", "tier_name", "tier_type").agg(F.array_sort(F.collect_list(F.struct(begin.alias("at"), F.col("id").alias("row"), item.alias("item")))).alias("items"))
    body = F.concat(F.lit('{"id":'), F.col("tier_id").cast("string"), F.lit(',"name":'), _quoted("tier_name"), F.lit(',"type":"'), "tier_type", F.lit('","'), listing, F.lit('":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}"))
    tiers = grouped.select("bundle_id", "tier_id", body.alias("tier"))
    listed = tiers.groupBy("bundle_id").agg(F.array_sort(F.collect_list(F.struct("tier_id", "tier"))).alias("tiers"))
    about = F.struct(F.col("bundle_id").alias("id"), "name", "sample_rate", "n_frames", (F.col("n_frames") / F.col("sample_rate")).alias("duration_seconds"))
    head = F.to_json(about, {"ignoreNullFields": "false"})
    all_tiers = F.array_join(F.transform(F.coalesce("tiers", F.array().cast("array<struct<tier_id: bigint, tier: string>>")), lambda x: x["tier"]), ",")
    return bundles.join(listed, "bundle_id", "left").select("bundle_id", F.concat(F.lit('{"bundle":'), head, F.lit(',"tiers":['), all_tiers, F.lit("]}")).alias("json"))


def _quoted(column: str):
    text = F.to_json(F.array(F.coalesce(column, F.lit(""))))
    return F.substr(text, F.lit(2), F.length(text) - 2)


def parsed_json(documents: DataFrame) -> DataFrame:
    """Interval and point rows of documents (bundle_id, json): bundle_id, tier, kind, start, end, label, note, extra.

    Reference, dense and unknown tiers are skipped; a document without tiers or a
    row without its times is an error.  An ``extra`` object becomes its text.
    """
    row = "array<struct<start_seconds: double, end_seconds: double, time_seconds: double, label: string, note: string, extra: variant>>"
    read = F.from_json("json", f"struct<tiers: array<struct<name: string, type: string, intervals: {row}, points: {row}>>>")
    tiers = F.coalesce(read["tiers"], F.raise_error(F.lit("JSON missing a `tiers` array")).cast(f"array<struct<name: string, type: string, intervals: {row}, points: {row}>>"))
    each = documents.select("bundle_id", F.explode(tiers).alias("t")).filter(F.col("t.type").isin("interval", "point"))
    is_interval = F.col("t.type") == "interval"
    rows = each.select("bundle_id", F.coalesce("t.name", F.lit("")).alias("tier"), F.col("t.type").alias("kind"), F.explode(F.when(is_interval, F.col("t.intervals")).otherwise(F.col("t.points"))).alias("a"))
    begin, end = (F.when(F.col("kind") == "interval", F.col(c)).otherwise(F.col("a.time_seconds")) for c in ("a.start_seconds", "a.end_seconds"))
    sure = lambda c: F.coalesce(c, F.raise_error(F.lit("a row lacks its times")).cast("double"))
    return rows.select("bundle_id", "tier", "kind", sure(begin).alias("start"), sure(end).alias("end"), "a.label", "a.note", F.variant_get("a.extra", "$", "string").alias("extra"))


def write_dense(samples: DataFrame, path: str, n_dims: int | None = None) -> None:
    """A dense signal: i and value, never null, sorted by i inside files; written once only."""
    value = F.col("value")
    if n_dims is not None:
        value = F.when(F.size(value) == n_dims, value).otherwise(F.raise_error(F.lit(f"expected {n_dims} values")).cast(samples.schema["value"].dataType))
    value = F.coalesce(value, F.raise_error(F.lit("null sample")).cast(samples.schema["value"].dataType))
    samples.select("i", value.alias("value")).repartitionByRange("i").sortWithinPartitions("i").write.mode("errorifexists").option("compression", "snappy").parquet(path)


def read_dense(spark: SparkSession, path: str, rate: float) -> DataFrame:
    """i, t and value.  Time is i over the rate; files without an index get one from their row order."""
    rows = spark.read.parquet(path)
    if "i" not in rows.columns:
        rows = rows.select(F.col("_metadata.row_index").alias("i"), "value")
    return rows.withColumn("t", F.col("i") / rate)


#: Characters of small documents that travel together.
BATCH_CHARS = 1 << 20


def write_textgrids(rows: DataFrame, durations: DataFrame) -> DataFrame:
    """bundle_id and the text of its TextGrid; rows come in order, and one bundle's are held at a time."""
    columns = ["bundle_id", "tier_id", "tier", "kind", "start", "end", "label", "duration"]

    def text(part: list[tuple]) -> str:
        tiers = [(name, kind, [(r[4], r[5], r[6] or "") for r in rows]) for (_, name, kind), rows in groupby(part, key=lambda r: r[1:4])]
        return formats.write_textgrid(tiers, part[0][7])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        made: dict[str, list] = {"bundle_id": [], "text": []}
        chars = 0

        def documents() -> Iterator[list[tuple]]:
            nonlocal held
            for batch in batches:
                for bundle, part in groupby(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: r[0]):
                    if held and held[0][0] != bundle:
                        yield held
                        held = []
                    held += part
            if held:
                yield held

        def taken() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(made["bundle_id"], pa.int64()), pa.array(made["text"], pa.string())], list(made))

        for part in documents():
            made["bundle_id"].append(part[0][0])
            made["text"].append(text(part))
            chars += len(made["text"][-1])
            if chars >= BATCH_CHARS:
                yield taken()
                made, chars = {"bundle_id": [], "text": []}, 0
        if made["text"]:
            yield taken()

    found = rows.join(durations, "bundle_id").select(*columns)
    return found.repartition("bundle_id").sortWithinPartitions("bundle_id", "tier_id", "start").mapInArrow(write, "bundle_id long, text string")


def concat_wavs(audio: DataFrame, key: str, order: str) -> DataFrame:
    """Recordings of a key put end to end."""
    parts = F.sort_array(F.collect_list(F.struct(order, "samples")))
    return audio.groupBy(key, "sample_rate", "channels").agg(F.flatten(F.transform(parts, lambda p: p["samples"])).alias("samples"))


def indexed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    return rows.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1)


def samples_frame(spark: SparkSession, recordings: list[tuple[int, int, np.ndarray]]) -> DataFrame:
    """In-memory mono recordings (bundle_id, rate, samples) as a DataFrame."""
    return spark.createDataFrame([(b, r, np.asarray(x, dtype=float).tolist()) for b, r, x in recordings], "bundle_id long, sample_rate int, samples array<double>")

"""A corpus as append-only Parquet logs: checked changes, cascades and an audit trail, committed together.

Every change writes the rows it touches, and nothing else, as a new batch of
each table and of the audit log; a marker file written last makes all of them
visible at once, so a failed change leaves the old state.  Every attempt writes to
paths of its own that its marker names, so what a failed one left is never read
and never in the way.  A table is its batches up to the last marker: their union
while rows were only added, the latest row of each id otherwise.  ``compact``
rewrites a table as one batch.  Of two writers that meet, the second is told by
the marker.  A change may carry a token, such as a stream's name and epoch: a
token that is there already makes the change do nothing, so a replayed batch lands
once.  ``as_of`` reads an earlier version.
"""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = {
    "speaker": "id long, name string, sex string, birth_year int, extra string",
    "instrument": "id long, name string, calibration string",
    "session": "id long, name string, instrument_id long, extra string",
    "bundle": "id long, name string, audio_relative_path string, sample_rate int, channels int, n_frames long, session_id long, speaker_id long, extra string",
    "audio": "id long, bundle_id long, content binary, first_frame long",
    "recording_part": "id long, recording string, sample_rate int, first_frame long, n_frames long, lost long, content binary, closed boolean",
    "tier": "id long, bundle_id long, name string, type string, parent_id long, cardinality string, extra string",
    "annotation_interval": "id long, tier_id long, start_seconds double, end_seconds double, label string, parent_annotation_id long, status string, note string, processing_run_id long, extra string",
    "annotation_point": "id long, tier_id long, time_seconds double, label string, parent_annotation_id long, status string, note string, processing_run_id long, extra string",
    "annotation_reference": "id long, tier_id long, target_kind string, target_id long, label string, parent_annotation_id long, extra string",
    "derived_signal": "id long, tier_id long, relative_path string, n_frames long, n_dims int, sample_rate_hz double, dtype string",
    "rubric": "id long, name string, version long, guidelines string",
    "rubric_status": "id long, name string, description string",
    "rubric_tier": "id long, tier_name string, description string, closed_vocabulary boolean",
    "vocabulary": "id long, tier_name string, value string",
    "rubric_version": "id long, version long, note string, snapshot string",
    "criterion": "id long, name string, description string, kind string, body string, target_tier string",
    "target": "id long, bundle_id long, start_seconds double, end_seconds double, label string, status string, note string, criterion_id long",
    "assignment": "id long, target_id long, annotator string, role string, status string",
    "processing_run": "id long, bundle_id long, kind string, processor_id string, parameters string, status string, recipe_run_id long",
    "recipe_run": "id long, name string, parameters string, status string, error_message string",
    "notebook_entry": "id long, kind string, text string, measurement string, target_type string, target_id long, promoted string",
    "refdist_pin": "id long, refdist string, version string",
    "audit_log": "id long, table_name string, row_id long, op string, before string, after string, user string, at string",
}
# The type, status and kind names of the exchange formats.
TIER_TYPES = ("interval", "point", "reference", "continuous_numeric", "continuous_vector", "categorical_sampled")
TARGET_STATUSES = ("unassigned", "assigned", "in_progress", "done", "skipped")
#: What goes with a deleted row: table -> [(child table, its column)].
CASCADES = {
    "bundle": [("tier", "bundle_id"), ("target", "bundle_id"), ("processing_run", "bundle_id"), ("audio", "bundle_id")],
    "tier": [("annotation_interval", "tier_id"), ("annotation_point", "tier_id"), ("annotation_reference", "tier_id"), ("derived_signal", "tier_id")],
    "target": [("assignment", "target_id")],
}
CHECKS = {
    "tier": f"type in {TIER_TYPES} and trim(name) <> ''",
    "bundle": "trim(name) <> ''",
    "annotation_interval": "end_seconds > start_seconds",
    "target": f"end_seconds > start_seconds and status in {TARGET_STATUSES}",
    "assignment": "trim(annotator) <> ''",
}
UNIQUE = {
    "tier": ["bundle_id", "name"], "assignment": ["target_id", "annotator"], "bundle": ["audio_relative_path"], "vocabulary": ["tier_name", "value"], "criterion": ["name"], "derived_signal": ["tier_id"],
    "rubric_status": ["name"], "rubric_tier": ["tier_name"], "rubric_version": ["version"], "refdist_pin": ["refdist"], "recipe_run": ["name"],
}
PARENTS = {
    "tier": ("bundle_id", "bundle"), "annotation_interval": ("tier_id", "tier"), "annotation_point": ("tier_id", "tier"), "annotation_reference": ("tier_id", "tier"), "target": ("bundle_id", "bundle"),
    "assignment": ("target_id", "target"), "derived_signal": ("tier_id", "tier"), "audio": ("bundle_id", "bundle"),
}
ANNOTATIONS = ("annotation_interval", "annotation_point", "annotation_reference")

#: Ids of a table and bytes of a staged frame from which its joins are shuffled: ids take few bytes in files and many in the driver's memory.
LARGE_ROWS, LARGE_BYTES = 1 << 19, 1 << 20


class StoreError(ValueError):
    """A change breaks a rule of the corpus."""


def names(table: str) -> list[str]:
    return [c.split()[0] for c in TABLES[table].split(", ")]


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows, which the optimizer knows: joins with them need no job and no Python."""
    return spark.range(0).filter(F.lit(False)).select(*[F.lit(None).cast(t).alias(c) for c, t in (f.split() for f in schema.split(", "))])


class Corpus:
    def __init__(self, spark: SparkSession, root: str, user: str = "unknown", clock=None):
        self.spark, self.root, self.user = spark, root.rstrip("/"), user
        self.clock = clock or (lambda: datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")[:-3] + "Z")
        self._markers: dict[int, dict] = {}
        self._staged = 0
        #: the last commit that reads see; none: all
        self.version: int | None = None

    # ---- the log

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _read_markers(self) -> list[dict]:
        """All commits in order; each marker is read once."""
        path, fs = self._path("_commits")
        if not fs.exists(path):
            return []
        numbers = sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit())
        for n in numbers:
            if n not in self._markers:
                stream = fs.open(self._path(f"_commits/{n}")[0])
                self._markers[n] = json.loads(bytes(stream.readAllBytes()).decode())
                stream.close()
        return [{"n": n, **self._markers[n]} for n in numbers if self.version is None or n <= self.version]

    def as_of(self, version: int) -> Corpus:
        """The corpus as it was after commit ``version``, to read only."""
        seen = Corpus(self.spark, self.root, self.user, self.clock)
        seen.version = version
        return seen

    def versions(self) -> list[int]:
        return [m["n"] for m in self._read_markers()]

    def has(self, token: str) -> bool:
        """Whether a change with this token has landed."""
        return any(m.get("token") == token for m in self._read_markers())

    def _next(self) -> tuple[int, str]:
        """The number of the next commit, and a name for this attempt at it."""
        if self.version is not None:
            raise StoreError("an earlier version is read only")
        return max((m["n"] for m in self._read_markers()), default=0) + 1, uuid.uuid4().hex

    def _batches(self, name: str) -> tuple[list[str], list[str]]:
        """Folders of a table's batches, and those of them that may change earlier rows."""
        found: list[str] = []
        changes: list[str] = []
        for marker in self._read_markers():
            op = marker["tables"].get(name, {}).get("op")
            path = f"batch={marker['n']}/attempt={marker['attempt']}"
            if op == "base":
                found, changes = [path], []
            elif op:
                found.append(path)
                if op != "insert":
                    changes.append(path)
        return found, changes

    def table(self, name: str) -> DataFrame:
        """The current rows; an empty frame before the first.

        What changes say of an id's last batch meets the rows in one join, so that only
        the columns asked for are read.
        """
        found, changes = self._batches(name)
        if not found:
            return empty(self.spark, TABLES[name])
        reader = self.spark.read.schema(f"{TABLES[name]}, _deleted boolean, batch long").option("basePath", f"{self.root}/{name}")
        rows = reader.parquet(*[f"{self.root}/{name}/{path}" for path in found]).drop("attempt")
        if not changes:
            return self._met(rows.select(*names(name)), name)
        rows = self._met(rows, name)
        last = reader.parquet(*[f"{self.root}/{name}/{path}" for path in changes]).groupBy("id").agg(F.max("batch").alias("_last"))
        return self._met(rows.join(last, "id", "left").filter("not _deleted and (_last is null or batch >= _last)").select(*names(name)), name)

    def _met(self, rows: DataFrame, name: str) -> DataFrame:
        """``rows`` of a table, which are never sent to all tasks through the driver where the table is large."""
        return rows.hint("merge") if self.next_id(name) > LARGE_ROWS else rows

    def next_id(self, name: str) -> int:
        """One past the largest id ever given, deleted rows included."""
        return max((m["tables"].get(name, {}).get("last_id", 0) for m in self._read_markers()), default=0) + 1

    def commit(self, changes: list[tuple[str, str, DataFrame]], token: str | None = None) -> None:
        """(table, "insert", "update" or "delete", rows): all of them or none.  Inserted rows have ids, deleted ones are the rows that go."""
        if token is not None and self.has(token):
            return
        n, attempt = self._next()
        marker: dict = {"user": self.user, "at": self.clock(), "attempt": attempt, "token": token, "tables": {}}
        tables: dict[str, list[tuple[str, DataFrame]]] = {}
        for name, op, rows in changes:
            tables.setdefault(name, []).append((op, rows.select(*names(name))))
        audit: DataFrame | None = None
        for name, parts in tables.items():
            path = f"{self.root}/{name}/batch={n}/attempt={attempt}"
            both: DataFrame | None = None
            for op, rows in parts:
                rows = rows.withColumns({"_deleted": F.lit(op == "delete"), "_op": F.lit(op)})
                both = rows if both is None else both.unionByName(rows)
            both.write.parquet(path)
            kept = self.spark.read.schema(f"{TABLES[name]}, _deleted boolean, _op string").parquet(path)
            ops = {op for op, _ in parts}
            marker["tables"][name] = {"op": "insert" if ops == {"insert"} else "update", "last_id": kept.agg(F.max("id")).first()[0] or 0}
            packed = F.to_json(F.struct(*names(name)), {"ignoreNullFields": "false"})
            none = F.lit(None).cast("string")
            new = kept.select(F.col("id").alias("row_id"), F.col("_op").alias("op"), F.when(F.col("_op") == "delete", packed).alias("before"), F.when(F.col("_op") != "delete", packed).alias("after"))
            if "update" in ops:
                old = self.table(name).join(kept.filter("_op = 'update'").select("id"), "id", "left_semi").select(F.col("id").alias("row_id"), packed.alias("_old"))
                new = self._met(new, name).join(old, "row_id", "left").withColumn("before", F.coalesce("before", F.when(F.col("op") == "update", F.col("_old")))).drop("_old").filter("op <> 'update' or not (before <=> after)")
            new = new.withColumn("table_name", F.lit(name)).withColumn("before", F.coalesce("before", none))
            audit = new if audit is None else audit.unionByName(new)
        if audit is None:
            return
        log = audit.withColumns({"id": F.lit(n << 40) + F.monotonically_increasing_id(), "user": F.lit(self.user), "at": F.lit(marker["at"])})
        log.select(*names("audit_log")).withColumn("_deleted", F.lit(False)).write.parquet(f"{self.root}/audit_log/batch={n}/attempt={attempt}")
        marker["tables"]["audit_log"] = {"op": "insert", "last_id": 0}
        self._mark(n, marker)

    def _mark(self, n: int, marker: dict) -> None:
        path, fs = self._path(f"_commits/{n}")
        if fs.exists(path):
            raise StoreError(f"another writer has made commit {n}")
        # written aside and renamed: a marker is there as a whole or not at all, and of two writers one fails here
        aside = self._path(f"_commits/_{n}-{marker['attempt']}")[0]
        stream = fs.create(aside, False)
        stream.write(bytearray(json.dumps(marker).encode()))
        stream.close()
        if not fs.rename(aside, path):
            fs.delete(aside, False)
            raise StoreError(f"another writer has made commit {n}")

    def compact(self, *tables: str) -> None:
        """Rewrite tables as one batch each."""
        n, attempt = self._next()
        marker: dict = {"user": self.user, "at": self.clock(), "attempt": attempt, "tables": {}}
        for name in tables:
            self.table(name).withColumn("_deleted", F.lit(False)).write.parquet(f"{self.root}/{name}/batch={n}/attempt={attempt}")
            marker["tables"][name] = {"op": "base", "last_id": self.next_id(name) - 1}
        self._mark(n, marker)

    def swept(self) -> list[str]:
        """Delete what failed attempts left, and what is staged; returns the folders.  No other writer may be at work."""
        kept, gone = {f"batch={m['n']}/attempt={m['attempt']}" for m in self._read_markers()}, []
        for name in (*TABLES, "_staged"):
            path, fs = self._path(name)
            for batch in fs.listStatus(path) if fs.exists(path) else []:
                for attempt in fs.listStatus(batch.getPath()) if name != "_staged" else [batch]:
                    at = attempt.getPath()
                    if f"{batch.getPath().getName()}/{at.getName()}" not in kept:
                        fs.delete(at, True)
                        gone.append(f"{name}/{batch.getPath().getName()}" + f"/{at.getName()}" * (name != "_staged"))
        return sorted(gone)

    def staged(self, rows: DataFrame, met: bool = True) -> DataFrame:
        """Rows written outside the log and read back, so that a plan is computed once.  ``met``: they will meet other rows, which is shuffled where they are many."""
        self._staged += 1
        path = f"{self.root}/_staged/{self._staged}-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        kept = self.spark.read.schema(rows.schema).parquet(path)
        at, fs = self._path(path.removeprefix(f"{self.root}/"))
        return kept.hint("merge") if met and fs.getContentSummary(at).getLength() > LARGE_BYTES else kept

    def numbered(self, name: str, rows: DataFrame, column: str = "id") -> DataFrame:
        """Rows with new ids, one after another: tasks count their rows, and number them from the sum of those before."""
        rows = self.staged(rows.drop(column), False).withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id() % (1 << 33)})
        at, offsets = self.next_id(name), []
        for r in rows.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # a row for each task
            offsets.append((r["_part"], at))
            at += r["n"]
        starts = self.spark.createDataFrame(offsets, "_part int, _first long")
        made = rows.join(F.broadcast(starts), "_part").withColumn(column, F.col("_first") + F.col("_row")).drop("_part", "_row", "_first")
        return made.hint("merge") if at - self.next_id(name) > LARGE_ROWS else made

    # ---- rules

    def violations(self, name: str, rows: DataFrame) -> DataFrame:
        """(id, rule) for rows that may not be written: check, unique, parent, type, vocabulary, status, cardinality."""
        bad: list[DataFrame] = []

        def broken(found: DataFrame, rule: str) -> None:
            bad.append(found.select("id", F.lit(rule).alias("rule")))

        if name in CHECKS:
            broken(rows.filter(f"not coalesce({CHECKS[name]}, false)"), "check")
        if name in UNIQUE:
            keys = UNIQUE[name]
            broken(rows.join(rows.groupBy(*keys).count().filter("count > 1"), keys, "left_semi"), "unique")
            others = self.table(name).join(rows.select("id"), "id", "left_anti")
            broken(rows.join(others.select(*keys), keys, "left_semi"), "unique")
        if name in PARENTS:
            column, parent = PARENTS[name]
            broken(rows.join(self.table(parent).select(F.col("id").alias(column)), column, "left_anti"), "parent")
        if name in ANNOTATIONS:
            tiers = self.table("tier").select(F.col("id").alias("tier_id"), F.col("name").alias("tier_name"), "type", "parent_id", "cardinality")
            own = rows.join(tiers, "tier_id")
            broken(own.filter(F.col("type") != name.removeprefix("annotation_")), "type")
            kind = F.coalesce("cardinality", F.lit("none"))
            with_parent = own.filter("parent_annotation_id is not null")
            broken(with_parent.filter(kind.isin("none", "many_to_one")), "cardinality")
            linked = with_parent.filter(~kind.isin("none", "many_to_one"))
            parents = self.table("annotation_interval").select("id", "tier_id").unionByName(self.table("annotation_point").select("id", "tier_id")).select(F.col("id").alias("parent_annotation_id"), F.col("tier_id").alias("parent_id"))
            broken(linked.join(parents, ["parent_annotation_id", "parent_id"], "left_anti"), "cardinality")
            single = linked.filter(kind == "one_to_one").select("id", "tier_id", "parent_annotation_id")
            siblings = self.table(name).join(rows.select("id"), "id", "left_anti").select("tier_id", "parent_annotation_id").unionByName(single.drop("id"))
            broken(single.join(siblings.groupBy("tier_id", "parent_annotation_id").count().filter("count > 1"), ["tier_id", "parent_annotation_id"], "left_semi"), "cardinality")
            if name != "annotation_reference":
                closed = own.join(self.table("rubric_tier").filter("closed_vocabulary").select("tier_name"), "tier_name").filter("coalesce(label, '') <> ''")
                broken(closed.join(self.table("vocabulary").select("tier_name", F.col("value").alias("label")), ["tier_name", "label"], "left_anti"), "vocabulary")
                broken(rows.filter("status is not null").join(self.table("rubric_status").select(F.col("name").alias("status")), "status", "left_anti"), "status")
        out = empty(self.spark, "id long, rule string")
        for found in bad:
            out = out.unionByName(found)
        return out

    def _checked(self, name: str, rows: DataFrame) -> None:
        first = self.violations(name, rows).first()
        if first is not None:
            raise StoreError(f"{name}: row {first['id']} breaks its {first['rule']} rule")

    # ---- changes

    def frame(self, name: str, rows: list[dict]) -> DataFrame:
        return self.spark.createDataFrame([tuple(r.get(c) for c in names(name)) for r in rows], TABLES[name])

    def add(self, name: str, rows: list[dict]) -> list[int]:
        """Append a few rows; returns their ids."""
        first = self.next_id(name)
        self.append(name, self.frame(name, [{**r, "id": first + i} for i, r in enumerate(rows)]))
        return list(range(first, first + len(rows)))

    def append(self, name: str, rows: DataFrame, checked: bool = True) -> DataFrame:
        """Append rows of a DataFrame; those without an ``id`` column get ids.  Missing columns are null."""
        if "id" not in rows.columns:
            rows = self.numbered(name, rows)
        types = {c.split()[0]: c.split()[1] for c in TABLES[name].split(", ")}
        rows = rows.select(*[(F.col(c) if c in rows.columns else F.lit(None)).cast(t).alias(c) for c, t in types.items()])
        if checked:
            self._checked(name, rows)
        changes = [(name, "insert", rows)]
        if name == "assignment":
            opened = self.table("target").filter("status = 'unassigned'").join(rows.select(F.col("target_id").alias("id")), "id", "left_semi")
            changes.append(("target", "update", opened.withColumn("status", F.lit("assigned"))))
        self.commit(changes)
        return rows

    def update(self, name: str, where: Column, values: dict[str, Column]) -> int:
        """Rewrite the rows that match; returns how many."""
        types = {c.split()[0]: c.split()[1] for c in TABLES[name].split(", ")}
        changed = self.staged(self.table(name).filter(where).withColumns({c: v.cast(types[c]) for c, v in values.items()}))
        n = changed.count()
        if n:
            self._checked(name, changed)
            self.commit([(name, "update", changed)])
        return n

    def replace(self, name: str, rows: DataFrame) -> int:
        """Update whole rows, matched by id; ids that are not there are an error."""
        rows = self.staged(rows.select(*names(name)))
        if not rows.join(self.table(name).select("id"), "id", "left_anti").isEmpty():
            raise StoreError(f"{name}: no such row")
        self._checked(name, rows)
        self.commit([(name, "update", rows)])
        return rows.count()

    def doomed(self, name: str, gone: DataFrame) -> list[tuple[str, str, DataFrame]]:
        """What a delete of rows takes with it, children first."""
        out: list[tuple[str, str, DataFrame]] = []
        for child, column in CASCADES.get(name, []):
            out += self.doomed(child, self.table(child).join(gone.select(F.col("id").alias(column)), column, "left_semi"))
        return [*out, (name, "delete", gone)]

    def delete(self, name: str, where: Column | DataFrame) -> int:
        """Delete rows, by a condition or by ids (a frame of ``id``), and all that hangs on them, in one commit; a tier with child tiers that stay is refused."""
        rows = self.table(name)
        gone = self.staged(rows.join(where.select("id").distinct(), "id", "left_semi").select(*names(name)) if isinstance(where, DataFrame) else rows.filter(where))
        n = gone.count()
        if not n:
            return 0
        if name == "tier":
            children = self.table("tier").join(gone.select(F.col("id").alias("parent_id")), "parent_id", "left_semi").join(gone.select("id"), "id", "left_anti")
            if not children.isEmpty():
                raise StoreError("tier: it has child tiers")
        changes = [(t, op, self.staged(rows)) for t, op, rows in self.doomed(name, gone)]
        if name == "assignment":
            left = self.table("assignment").join(gone.select("id"), "id", "left_anti").select(F.col("target_id").alias("id"))
            free = self.table("target").filter("status = 'assigned'").join(gone.select(F.col("target_id").alias("id")), "id", "left_semi").join(self._met(left, name), "id", "left_anti")
            changes.append(("target", "update", free.withColumn("status", F.lit("unassigned"))))
        self.commit(changes)
        return n

    # ---- reads

    def get(self, name: str, row_id: int):
        return self.table(name).filter(F.col("id") == row_id).first()

    def tiers(self, bundle_id: int | None = None) -> DataFrame:
        rows = self.table("tier")
        return (rows if bundle_id is None else rows.filter(F.col("bundle_id") == bundle_id)).orderBy("id")

    def intervals(self, tier_id: int) -> DataFrame:
        return self.table("annotation_interval").filter(F.col("tier_id") == tier_id).orderBy("start_seconds", "id")

    def points(self, tier_id: int) -> DataFrame:
        return self.table("annotation_point").filter(F.col("tier_id") == tier_id).orderBy("time_seconds", "id")

    def references(self, tier_id: int) -> DataFrame:
        return self.table("annotation_reference").filter(F.col("tier_id") == tier_id).orderBy("id")

    def query(self, tier_id: int) -> DataFrame:
        """A tier's rows with fixed columns by its type."""
        tier = self.get("tier", tier_id)
        if tier is None:
            raise StoreError("no such tier")
        if tier["type"] == "interval":
            return self.intervals(tier_id).select("id", "start_seconds", "end_seconds", (F.col("end_seconds") - F.col("start_seconds")).alias("duration_seconds"), "label", "parent_annotation_id", "extra")
        if tier["type"] == "point":
            return self.points(tier_id).select("id", "time_seconds", "label", "parent_annotation_id", "extra")
        if tier["type"] == "reference":
            return self.references(tier_id)
        signal = self.table("derived_signal").filter(F.col("tier_id") == tier_id).first()
        from sonospan.sources.readers import read_dense

        return read_dense(self.spark, f"{self.root}/{signal['relative_path']}", signal["sample_rate_hz"])

    def tier_rows(self, tier_id: int) -> DataFrame:
        """A sparse tier's rows; a dense tier is an error."""
        tier = self.get("tier", tier_id)
        if tier is None or tier["type"] not in ("interval", "point", "reference"):
            raise StoreError("no such sparse tier")
        return self.query(tier_id)

    def timeline(self, tier_names: list[str] | None = None) -> DataFrame:
        """All interval and point rows with their tier: bundle_id, tier, kind, id, start, end, label."""
        tiers = self.table("tier").select(F.col("id").alias("tier_id"), "bundle_id", F.col("name").alias("tier"), F.col("type").alias("kind"))
        tiers = tiers if tier_names is None else tiers.filter(F.col("tier").isin(*tier_names))
        iv = self.table("annotation_interval").select("tier_id", "id", F.col("start_seconds").alias("start"), F.col("end_seconds").alias("end"), "label", "processing_run_id")
        pt = self.table("annotation_point").select("tier_id", "id", F.col("time_seconds").alias("start"), F.col("time_seconds").alias("end"), "label", "processing_run_id")
        return iv.unionByName(pt).join(tiers, "tier_id")

    def calibrations(self) -> DataFrame:
        """bundle_id and the calibration of its instrument; unreadable text gives nulls."""
        b = self.table("bundle").select(F.col("id").alias("bundle_id"), "session_id")
        s = self.table("session").select(F.col("id").alias("session_id"), "instrument_id")
        i = self.table("instrument").select(F.col("id").alias("instrument_id"), F.from_json("calibration", "reference_spl_db double, reference_db_fs double").alias("c"))
        return b.join(s, "session_id").join(i, "instrument_id").select("bundle_id", "c.*")

    def calibration(self, bundle_id: int) -> DataFrame:
        return self.calibrations().filter(F.col("bundle_id") == bundle_id).drop("bundle_id")

    def assignments(self, bundle_id: int | None = None) -> DataFrame:
        """Assignments with their target's bundle."""
        targets = self.table("target").select(F.col("id").alias("target_id"), "bundle_id")
        rows = self._met(self.table("assignment").join(targets, "target_id"), "assignment")
        return rows if bundle_id is None else rows.filter(F.col("bundle_id") == bundle_id)

    def set_proposals(self, bundle_id: int, target_tier: str, proposals: DataFrame, run_id: int | None = None) -> int:
        """Replace a bundle's preview tier "<target> (auto)" by proposals (start, end, label), all points or all spans."""
        from sonospan.workflow import set_proposals

        rows = proposals.select(F.lit(bundle_id).cast("long").alias("bundle_id"), "start", "end", "label", F.lit(run_id).cast("long").alias("processing_run_id"))
        return set_proposals(self, target_tier, rows, self.spark.createDataFrame([(bundle_id,)], "bundle_id long"))

"""A table with snapshot history on plain Parquet.

Every commit writes its rows to a folder of its own and then publishes one log entry under the next version number. An
entry names the folder that it adds (or the one that replaces all), so the log grows by one small file a commit; a
snapshot is what the entries up to its version add up to, read with the schema of that entry.

A backfill writes no rows of the table: its folder is an overlay, the rules' keys and values with the default, which
readers join to the folders that are older. Compaction writes the current rows, overlays applied, to one folder that takes
the place of those it read; it holds beside appends that came meanwhile. Expiry deletes what no kept snapshot names.

Entries are published by a rename that fails if the version is there: of two writers with the same parent, one raises
``CommitConflict`` and none is lost. Rows of a commit without an entry are in a folder that no snapshot names, so readers
never see half a commit.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import build_side, row_bytes, stage

LOG = T.StructType(
    [
        T.StructField("version", T.LongType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("parent_id", T.StringType()),
        T.StructField("made_current_at", T.TimestampType()),
        T.StructField("operation", T.StringType()),
        T.StructField("folder", T.StringType()),
        T.StructField("replaces", T.BooleanType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("schema_json", T.StringType()),
        T.StructField("batch", T.StringType()),
        T.StructField("overlay", T.StringType()),
        T.StructField("removes", T.ArrayType(T.StringType())),
        T.StructField("oldest", T.LongType()),
    ]
)

NOT_SNAPSHOTS = ("create", "alter", "compact", "expire")


class CommitConflict(RuntimeError):
    """Another writer has published the version that this commit wanted."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark = spark
        self.path = path.rstrip("/")
        self._known: list[dict] = []
        self._view: str | None = None

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: T.StructType) -> VersionedTable:
        """An empty table, all columns nullable. Raises ``CommitConflict`` if there is one at ``path``."""
        table = cls(spark, path)
        nullable = T.StructType([T.StructField(f.name, f.dataType, True, f.metadata) for f in schema.fields])
        table._publish("create", None, None, False, 0, nullable)
        return table

    def log(self) -> DataFrame:
        return self.spark.read.schema(LOG).json(f"{self.path}/log")

    def history(self) -> DataFrame:
        """Snapshots in the order in which they became current. The history is linear, so all are ancestors."""
        return (
            self.log()
            .filter(~F.col("operation").isin(*NOT_SNAPSHOTS))
            .select(
                "version",
                "made_current_at",
                "snapshot_id",
                "parent_id",
                "operation",
                "row_count",
                F.lit(True).alias("is_current_ancestor"),
            )
            .orderBy("made_current_at", "version")
        )

    def current_snapshot_id(self) -> str | None:
        return self.entries()[-1]["snapshot_id"]

    def read(self, snapshot_id: str | None = None) -> DataFrame:
        """The rows and the schema of a snapshot, by default the current state (with columns added since)."""
        entries = self._upto(snapshot_id)
        return self._of_steps(_steps(entries), _schema(entries[-1]))

    def _of_steps(self, steps: list[dict], schema: T.StructType) -> DataFrame:
        """Rows of folders, each with the overlays after it; folders with the same overlays are read together."""
        groups: list[tuple[list[str], list[dict]]] = []
        overlays: list[dict] = []
        for step in reversed(steps):
            if step["overlay"] is not None:
                overlays = _needed([step, *overlays])
            elif groups and groups[-1][1] == overlays:
                groups[-1][0].append(step["folder"])
            else:
                groups.append(([step["folder"]], overlays))
        if not groups:
            return self.spark.createDataFrame([], schema)
        parts = []
        for folders, applied in reversed(groups):
            part = self.spark.read.schema(schema).parquet(*[f"{self.path}/data/{f}" for f in reversed(folders)])
            for step in applied:
                part = self._overlaid(part, step)
            parts.append(part)
        return functools.reduce(DataFrame.unionAll, parts)

    def _overlaid(self, rows: DataFrame, step: dict) -> DataFrame:
        """``rows`` with an overlay's column set: by the rule of the row's key, else to the default."""
        facts = json.loads(step["overlay"])
        if facts["column"] not in rows.columns:
            return rows  # a later schema
        stored = self.spark.read.schema(T.StructType.fromJson(facts["schema"])).parquet(f"{self.path}/data/{step['folder']}")
        kind = rows.schema[facts["column"]].dataType
        default = _literal(stored.filter("_default").first()["_value"], stored.schema["_value"].dataType)
        rules = stored.filter("NOT _default").select("_key", "_value", F.lit(True).alias("_hit"))
        return _set_column(rows, build_side(rules, facts["bytes"]), facts["key"], facts["column"], default.cast(kind))

    def expose(self, name: str) -> None:
        """Make the current state readable as ``spark.table(name)``; commits through this object keep it current."""
        self._view = name
        self.read().createOrReplaceTempView(name)

    def append(self, df: DataFrame, batch: str | None = None) -> str:
        """Add rows; a column the rows lack is NULL. A ``batch`` that is in the log already adds nothing."""
        entries = self.entries()
        if batch is not None:
            done = [e for e in entries if e["batch"] == batch]
            if done:
                return done[-1]["snapshot_id"]
        schema = _schema(entries[-1])
        extra = set(df.columns) - set(schema.names)
        if extra:
            raise ValueError(f"add these columns first: {sorted(extra)}")
        folder, rows = self._write(_conform(df, schema))
        return self._publish("append", entries[-1], folder, False, entries[-1]["row_count"] + rows, schema, batch)

    def replace(self, df: DataFrame, operation: str = "overwrite", batch: str | None = None) -> str:
        """Replace all rows in one commit; earlier snapshots stay readable, also while ``df`` reads this table."""
        parent = self.entries()[-1]
        folder, rows = self._write(df)
        return self._publish(operation, parent, folder, True, rows, df.schema, batch)

    def add_columns(self, fields: Sequence[T.StructField]) -> None:
        """New nullable columns, without touching any data."""
        parent = self.entries()[-1]
        wider = T.StructType([*_schema(parent).fields, *fields])
        self._publish("alter", parent, None, False, parent["row_count"], wider)

    def backfill(self, rules: DataFrame, *, key: str, column: str, default: Column) -> str:
        """Set ``column`` on every row in one commit: from the rule with the row's key, else ``default``.

        ``rules`` is (key, column). A NULL key matches no rule; two rules for one key are an error. What is written
        grows with the rules, not with the table, unless ``default`` looks at the row: then the rows are written anew.
        """
        parent = self.entries()[-1]
        schema = _schema(parent)
        kind, value = schema[column].dataType, default.cast(schema[column].dataType)
        if not _is_constant(self.spark, value):
            return self.replace(conditional_update(self.read(), rules, key=key, column=column, default=default), "merge")
        fixed, size = _checked_rules(rules, key, column)
        listed = fixed.select("_key", F.col("_value").cast(kind).alias("_value"), F.lit(False).alias("_default"))
        constant = self.spark.range(1).select(F.lit(None).cast(fixed.schema["_key"].dataType), value, F.lit(True))
        folder, _ = self._write(listed.unionAll(constant))
        overlay = {"key": key, "column": column, "bytes": size, "schema": listed.schema.jsonValue()}
        rows = parent["row_count"]
        return self._publish("merge", parent, folder, False, rows, schema, overlay=json.dumps(overlay))

    def compact(self, files: int | None = None) -> int:
        """Write the current rows to one folder that takes the place of those read, overlays applied.

        The snapshots stay as they are and the current one gets no new id. Appends that are published meanwhile are
        kept; if another commit has changed what was read, ``CommitConflict`` is raised. Returns how many folders went.
        """
        entries = self.entries()
        steps = _steps(entries)
        if len(steps) < 2:
            return 0
        rows = self._of_steps(steps, _schema(entries[-1]))
        folder, _ = self._write(rows if files is None else rows.coalesce(files))
        read = [step["folder"] for step in steps]
        while True:
            now = self.entries()
            later = _steps(now)
            kept = [step["folder"] for step in later[: len(read)]] == read
            if not kept or any(step["overlay"] is not None for step in later[len(read) :]):
                raise CommitConflict(f"what was compacted of {self.path} has changed")
            parent = now[-1]
            try:
                self._publish("compact", parent, folder, False, parent["row_count"], _schema(parent), removes=read)
                return len(read)
            except CommitConflict:
                continue

    def expire(self, keep: int) -> int:
        """Forget all but the last ``keep`` snapshots and delete the folders that those don't name.

        The history still lists what is forgotten; reading it raises ValueError. Readers that hold a forgotten snapshot
        open lose it. Returns how many folders were deleted.
        """
        if keep < 1:
            raise ValueError("the current snapshot is kept")
        entries = self.entries()
        snapshots = [e for e in entries if e["operation"] not in NOT_SNAPSHOTS]
        if len(snapshots) <= keep:
            return 0
        oldest, parent = snapshots[-keep]["version"], entries[-1]
        self._publish("expire", parent, None, False, parent["row_count"], _schema(parent), oldest=oldest)
        kept = [_steps(self._upto(e["snapshot_id"])) for e in snapshots[-keep:]] + [_steps(entries)]
        named = {step["folder"] for steps in kept for step in steps}
        gone = {e["folder"] for e in entries if e["folder"] is not None} - named
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        deleted = 0
        for folder in sorted(gone):
            path = hadoop.Path(f"{self.path}/data/{folder}")
            deleted += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return deleted

    def added_since(self, snapshot_id: str | None, upto: str | None = None) -> DataFrame:
        """The rows that appends have added after one snapshot (None: all rows) up to another, without reading others.

        Raises ValueError if rows have been changed or replaced in between, so that there is more to it than new rows.
        """
        if snapshot_id is None:
            return self.read(upto)
        seen = len(self._upto(snapshot_id))
        entries = self._upto(upto)
        later = entries[seen:]
        if any(e["replaces"] or e.get("overlay") for e in later):
            raise ValueError(f"rows have changed since snapshot {snapshot_id}")
        new = [{"folder": e["folder"], "overlay": None} for e in later if e["operation"] == "append"]
        return self._of_steps(new, _schema(entries[-1]))

    def entries(self) -> list[dict]:
        """All log entries by version, one small file each; known ones are not read again."""
        hadoop = self.spark._jvm.org.apache.hadoop
        folder = hadoop.fs.Path(f"{self.path}/log")
        system = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(folder):
            raise ValueError(f"no table at {self.path}")
        names = sorted(f.getPath().getName() for f in system.listStatus(folder))
        for name in names[len(self._known) :]:
            stream = system.open(hadoop.fs.Path(folder, name))
            try:
                self._known.append(json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            finally:
                stream.close()
        return list(self._known)

    def _upto(self, snapshot_id: str | None) -> list[dict]:
        entries = self.entries()
        if snapshot_id is None:
            return entries
        at = [k for k, e in enumerate(entries) if e["snapshot_id"] == snapshot_id and e["operation"] not in NOT_SNAPSHOTS]
        if not at:
            raise ValueError(f"no snapshot {snapshot_id}")
        oldest = max((e.get("oldest") or 0 for e in entries), default=0)
        if entries[at[0]]["version"] < oldest:
            raise ValueError(f"snapshot {snapshot_id} has expired")
        end = at[0] + 1
        # compactions that follow at once have the same rows in other folders
        while end < len(entries) and entries[end]["operation"] in ("compact", "expire"):
            end += 1
        return entries[:end]

    def _write(self, df: DataFrame) -> tuple[str, int]:
        folder, counted = uuid.uuid4().hex, Observation()
        df.observe(counted, F.count(F.lit(1)).alias("n")).write.parquet(f"{self.path}/data/{folder}")
        return folder, counted.get["n"]

    def _publish(
        self,
        operation: str,
        parent: dict | None,
        folder: str | None,
        replaces: bool,
        rows: int,
        schema: T.StructType,
        batch: str | None = None,
        overlay: str | None = None,
        removes: list[str] | None = None,
        oldest: int | None = None,
    ) -> str | None:
        kept = operation in NOT_SNAPSHOTS and operation != "create"
        parent_id = parent["snapshot_id"] if parent else None
        entry = {
            "version": parent["version"] + 1 if parent else 0,
            "snapshot_id": parent_id if kept else (None if operation == "create" else uuid.uuid4().hex),
            "parent_id": parent["parent_id"] if kept and parent else parent_id,
            "made_current_at": datetime.now(timezone.utc).isoformat(),
            "operation": operation,
            "folder": folder,
            "replaces": replaces,
            "row_count": rows,
            "schema_json": schema.json(),
            "batch": batch,
            "overlay": overlay,
            "removes": removes,
            "oldest": oldest,
        }
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        conf = self.spark._jsc.hadoopConfiguration()
        log = hadoop.Path(f"{self.path}/log")
        draft = hadoop.Path(f"{self.path}/drafts/{uuid.uuid4().hex}")
        system = log.getFileSystem(conf)
        system.mkdirs(log)
        with_bytes = system.create(draft, False)
        with_bytes.write(bytearray(json.dumps(entry).encode()))
        with_bytes.close()
        target = hadoop.Path(log, f"{entry['version']:020d}.json")
        no_options = self.spark.sparkContext._gateway.new_array(self.spark._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(log.toUri(), conf).rename(
                system.makeQualified(draft), system.makeQualified(target), no_options
            )
        except Exception as error:
            system.delete(draft, False)
            if system.exists(target):
                raise CommitConflict(f"version {entry['version']} of {self.path} is there already") from error
            raise
        if self._view is not None:
            self.expose(self._view)
        return entry["snapshot_id"]


def _schema(entry: dict) -> T.StructType:
    return T.StructType.fromJson(json.loads(entry["schema_json"]))


def _conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        value = F.col(f"`{field.name}`") if field.name in present else F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name, metadata=field.metadata or {}))
    return df.select(*columns)


def _steps(entries: list[dict]) -> list[dict]:
    """What the entries add up to: folders of rows and overlays on the folders before them, in order."""
    steps: list[dict] = []
    for entry in entries:
        if entry["folder"] is None:
            continue
        step = {"folder": entry["folder"], "overlay": entry.get("overlay")}
        removes = entry.get("removes")
        if removes:
            # the compacted folder stands where those it replaces stood, before what came after them
            steps = [step, *[s for s in steps if s["folder"] not in removes]]
        else:
            steps = [step] if entry["replaces"] else [*steps, step]
    return steps


def _needed(overlays: list[dict]) -> list[dict]:
    """Overlays in order, without those whose column a later one sets anew before any other looks at it."""
    facts = [json.loads(step["overlay"]) for step in overlays]
    kept = []
    for k, own in enumerate(facts):
        later = facts[k + 1 :]
        again = next((n for n, f in enumerate(later) if f["column"] == own["column"]), None)
        if again is None or any(f["key"] == own["column"] for f in later[: again + 1]):
            kept.append(overlays[k])
    return kept


def _is_constant(spark: SparkSession, value: Column) -> bool:
    """Whether a value is the same for every row: it names no column and draws nothing."""
    try:
        plan = spark.range(1).select(value.alias("v"))._jdf.queryExecution().analyzed()
    except AnalysisException:
        return False
    return plan.deterministic() and plan.expressions().head().references().isEmpty()


def _literal(value: object, kind: T.DataType) -> Column:
    if value is None:
        return F.lit(None).cast(kind)
    if isinstance(kind, T.StructType):
        return F.struct(*[_literal(value[f.name], f.dataType).alias(f.name) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return F.array(*[_literal(v, kind.elementType) for v in value]).cast(kind)
    if isinstance(kind, T.MapType):
        both = [_literal(x, t) for pair in value.items() for x, t in zip(pair, (kind.keyType, kind.valueType))]
        return F.create_map(*both).cast(kind)
    if isinstance(kind, T.TimestampNTZType):
        return F.lit(value.isoformat(sep=" ")).cast(kind)
    return F.lit(value).cast(kind)


def _checked_rules(rules: DataFrame, key: str, column: str) -> tuple[DataFrame, int]:
    """Rules as (_key, _value, _hit), written once, and their size; two rules for one key are an error."""
    # Staged once: a generated id or time in a rule is one value for all rows it applies to.
    fixed = stage(rules.select(F.col(key).alias("_key"), F.col(column).alias("_value"), F.lit(True).alias("_hit")), "rules")
    facts = (
        fixed.groupBy("_key")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(row_bytes(fixed)).alias("b"))
        .agg(F.max(F.when(F.col("_key").isNotNull(), F.col("n"))).alias("most"), F.sum("b").alias("bytes"))
        .first()
    )
    if (facts["most"] or 0) > 1:
        raise ValueError("several rules have the same key")
    return fixed, facts["bytes"] or 0


def _set_column(target: DataFrame, rules: DataFrame, key: str, column: str, default: Column) -> DataFrame:
    value = F.when(F.col("_hit"), F.col("_value").cast(target.schema[column].dataType)).otherwise(default)
    joined = target.join(rules, F.col(key) == F.col("_key"), "left")
    return joined.select(*[value.alias(c) if c == column else F.col(f"`{c}`") for c in target.columns])


def conditional_update(target: DataFrame, rules: DataFrame, *, key: str, column: str, default: Column) -> DataFrame:
    """All rows of ``target`` with ``column`` taken from the matching rule, or ``default`` where none matches."""
    fixed, size = _checked_rules(rules, key, column)
    return _set_column(target, build_side(fixed, size), key, column, default.cast(target.schema[column].dataType))

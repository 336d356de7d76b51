"""Session settings and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

BROADCAST_BYTES = 64 * 1024 * 1024

_local_scratch: dict[str, str] = {}


def build_session(app_name: str = "tallyhouse", master: str | None = None, **extra: str) -> SparkSession:
    """A session with the settings the toolkit is tested with; ``extra`` uses ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master is not None:
        builder = builder.master(master)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    for key, value in extra.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir``, or a temp folder in local mode only."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return qualified(spark, configured)
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="tallyhouse-")
        atexit.register(shutil.rmtree, _local_scratch[app], ignore_errors=True)
    return _local_scratch[app]


def qualified(spark: SparkSession, folder: str) -> str:
    """A folder as ``scheme://authority/path``, which Spark, Hadoop and Arrow all read alike, or a plain local path.

    Spark also accepts ``file:/path``, which Arrow doesn't, and plain paths of a default file system that isn't local,
    which Arrow would take for local ones.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toUri()
    if uri.getScheme() == "file" and folder.startswith("/"):
        return folder.rstrip("/")
    return f"{uri.getScheme()}://{uri.getAuthority() or ''}{uri.getPath().rstrip('/')}"


def arrow_uri(path: str) -> str:
    """A path of the shared folder as the URI that Arrow's file systems take."""
    return quote(path if "://" in path else f"file://{path}", safe=":/@")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A path below this application's part of the shared folder that no other call gets."""
    return f"{_own_scratch(spark)}/{label}-{uuid.uuid4().hex}"


def _own_scratch(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/tallyhouse-{spark.sparkContext.applicationId}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all that this application has staged. Results that read staged tables cannot be read after that."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(_own_scratch(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stage(df: DataFrame, label: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used for summaries that several later steps read: the work is done once, a lost executor costs nothing, and
    Catalyst plans the next join from the exact file size (broadcast below its threshold, shuffled above it).
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(df: DataFrame) -> Column:
    """Width of a row: eight bytes per fixed-size value, the actual length of text and nested values."""
    total = F.lit(0).cast("long")
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0)) + 8
        elif kind.startswith(("array", "map", "struct")):
            width = F.coalesce(F.octet_length(F.to_json(F.struct(F.col(f"`{name}`")))), F.lit(0)) + 16
        else:
            width = F.lit(8)
        total = total + width
    return total


def measured_bytes(df: DataFrame) -> int:
    """Size of all rows from their column widths; one aggregation pass."""
    return df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0)).alias("b")).first()["b"]


def broadcast_within(df: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """The build side of a join: broadcast if its measured size stays within the limit, else a sort-merge join."""
    return build_side(df, measured_bytes(df), limit_bytes)


def build_side(df: DataFrame, size: int, limit_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Fix the join strategy from a known size.

    The planner's own estimate can be far off (an exploded table counts as large as its source), so it is overridden
    both ways. A sort-merge join spills, and AQE splits its hot keys.
    """
    return F.broadcast(df) if size <= limit_bytes else df.hint("merge")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Give a file scan of fewer splits than there are cores a partition per core, before costly row work.

    Such a scan is at most a split per core in size, so the exchange is small; a larger one is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, F.xxhash64(F.col(key)))

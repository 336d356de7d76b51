"""File sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def scan_parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Parquet files or a Hive-partitioned tree; with a schema the files are read as declared, without inference."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(path)


def scan_text(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files in column ``value``; an unreadable path is an error."""
    return spark.read.option("lineSep", "\n").text(path)


def list_objects(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """One row per file with its metadata; contents are not read because the column is pruned."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    return files.load(path).select("path", "modificationTime", "length")


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_partitioned(
    df: DataFrame, path: str, *columns: str, rows_per_file: int = 20_000_000, balance: bool = True
) -> None:
    """Hive-partitioned Parquet, replacing the path.

    The rebalance hint brings the rows of a partition value together, so files do not multiply by tasks, and AQE
    splits a value that holds a large share of the rows over several writers. ``balance=False`` saves that exchange
    where every task holds large enough shares of few values.
    """
    balanced = df.hint("rebalance", *[F.col(c) for c in columns]) if balance else df
    balanced.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*columns).parquet(path)


def write_clustered(df: DataFrame, path: str, key: str, spread_by: str, files: int | None = None) -> None:
    """Parquet sorted by ``key`` over range partitions, replacing the path.

    Ranges are cut on (key, hash of ``spread_by``), so one hot key is cut into several ranges instead of filling one
    task. Readers get row groups with narrow key ranges, and a grouping by key folds almost fully before its exchange.
    """
    order = [F.col(key), F.xxhash64(F.col(spread_by))]
    ranged = df.repartitionByRange(*order) if files is None else df.repartitionByRange(files, *order)
    ranged.sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def write_text(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\n").text(path)


def schema_rows(df: DataFrame) -> DataFrame:
    """The schema as rows (name, type, nullable, comment)."""
    rows = [
        (f.name, f.dataType.simpleString(), f.nullable, (f.metadata or {}).get("comment")) for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean, comment string")

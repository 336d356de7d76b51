"""Catalog tables, views and literal rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def quoted(name: str) -> str:
    return ".".join(f"`{part.replace('`', '``')}`" for part in name.split("."))


def _literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def create_schema(spark: SparkSession, name: str, location: str | None = None) -> None:
    place = f" LOCATION {_literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(name)}{place}")


def create_table(spark: SparkSession, name: str, schema: T.StructType, location: str) -> None:
    """Empty typed table over ``location``, column comments included, replacing the catalog entry.

    A location that holds files is refused, as they would be rows of the table.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(location)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if system.exists(place) and len(system.listStatus(place)):
        raise ValueError(f"{location} is not empty")
    columns = []
    for field in schema.fields:
        comment = (field.metadata or {}).get("comment")
        note = f" COMMENT {_literal(comment)}" if comment else ""
        columns.append(f"{quoted(field.name)} {field.dataType.simpleString()}{note}")
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")
    spark.sql(
        f"CREATE TABLE {quoted(name)} ({', '.join(columns)}) USING parquet LOCATION {_literal(location)}"
    )


def add_columns(spark: SparkSession, name: str, fields: Sequence[T.StructField]) -> None:
    """New columns in the catalog; existing files stay as they are and read as NULL."""
    columns = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in fields)
    spark.sql(f"ALTER TABLE {quoted(name)} ADD COLUMNS ({columns})")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def replace_table(df: DataFrame, name: str, location: str | None = None) -> None:
    """Create or replace a table from a query result. ``df`` must not read the table itself."""
    writer = df.write.mode("overwrite").format("parquet")
    if location is not None:
        writer = writer.option("path", location)
    writer.saveAsTable(quoted(name))


def replace_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def drop_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {quoted(name)}")


def drop_schema(spark: SparkSession, name: str) -> None:
    """Drop a schema with everything in it."""
    spark.sql(f"DROP DATABASE IF EXISTS {quoted(name)} CASCADE")


def literal_rows(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def rows_from_dicts(spark: SparkSession, batch: Sequence[Mapping[str, Any]], schema: T.StructType) -> DataFrame:
    """A batch of records as rows of ``schema``.

    The first record decides which columns are filled: a key that a later record lacks is NULL, a key the first
    record lacks is left out. Nested records become structs. Types come from the schema, never from the text.
    """
    names = set(batch[0]) if batch else set()
    unknown = names - set(schema.names)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    rows = [tuple(record.get(c) if c in names else None for c in schema.names) for record in batch]
    return spark.createDataFrame(rows, schema)


def append_batch(spark: SparkSession, batch: Sequence[Mapping[str, Any]], schema: T.StructType, path: str) -> int:
    """Append a batch to Parquet files; visible when the call returns. An empty batch writes nothing."""
    if not batch:
        return 0
    rows_from_dicts(spark, batch, schema).write.mode("append").parquet(path)
    return len(batch)


def union_by_position(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, columns by position, names from the first."""
    for other in others:
        first = first.union(other)
    return first


def union_evolved(first: DataFrame, *others: DataFrame) -> DataFrame:
    """All rows, columns by name, a missing column or struct field NULL."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first

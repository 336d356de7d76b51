"""Append ingest from a landing folder, each file taken exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.sources.versions import VersionedTable


def ingest_files(
    spark: SparkSession, landing: str, schema: T.StructType, table: str, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append all files not taken yet to ``table``, in batches of at most ``files_per_batch`` files, then stop.

    ``landing`` is a folder, or a glob that may match single files.

    The checkpoint remembers the files taken and the sink the batches committed: a repeated run, or one restarted
    after a loss, adds nothing twice. The last batch may be smaller.
    """
    arrivals = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        arrivals.writeStream.format("parquet")
        .outputMode("append")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_into(
    table: VersionedTable, landing: str, schema: T.StructType, checkpoint: str, files_per_batch: int = 1000
) -> StreamingQuery:
    """Append all files not taken yet to a versioned table, a commit for each batch, then stop.

    Commits carry the checkpoint and the number of their batch: a batch that Spark gives again after a loss adds nothing.
    """

    def commit(batch: DataFrame, number: int) -> None:
        table.append(batch, batch=f"{checkpoint}#{number}")

    arrivals = table.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        arrivals.writeStream.foreachBatch(commit)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

"""Trades judged as they arrive, against baselines that every batch keeps up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyhouse.operators.outliers import outside, trade_zscores
from tallyhouse.operators.running import RunningSummary
from tallyhouse.session import stage
from tallyhouse.sources.versions import VersionedTable

def price_baselines(trades: VersionedTable, path: str) -> RunningSummary:
    """A running summary of the price per (ticker, day)."""
    keys = {"ticker": F.col("ticker"), "trade_date": F.to_date("trade_timestamp")}
    return RunningSummary.create(trades, path, keys, {"price": F.col("price")})


def baselines_of(summary: RunningSummary) -> DataFrame:
    return summary.read().select(
        "ticker", "trade_date", F.col("price_mean").alias("avg_price"), F.col("price_stddev").alias("stddev_price")
    )


def judge_arrivals(
    trades: VersionedTable,
    summary: RunningSummary,
    outliers: VersionedTable,
    landing: str,
    schema: T.StructType,
    checkpoint: str,
    *,
    limit: float,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Take all files not taken yet, batch by batch, then stop.

    A batch is appended to ``trades``, the baselines take in its rows, and those of its rows whose price lies more than
    ``limit`` deviations from the mean so far are appended to ``outliers`` with their score. All three remember the
    batch: one that Spark gives again after a loss adds to none of them twice.
    """

    def take(batch: DataFrame, number: int) -> None:
        token = f"{checkpoint}#{number}"
        trades.append(batch, batch=token)
        summary.update(trades)
        known = stage(baselines_of(summary), "baselines")
        outliers.append(outside(trade_zscores(batch, known), "price_z_score", limit), batch=token)

    arrivals = trades.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(landing)
    query = (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query

"""Daily trade measures and statistical outliers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import ratio
from tallyhouse.session import stage


def with_trade_date(trades: DataFrame) -> DataFrame:
    return trades.withColumn("trade_date", F.to_date("trade_timestamp"))


def daily_ticker_summary(trades: DataFrame) -> DataFrame:
    """Volume and volume-weighted price per (day, ticker); no price for a day without volume."""
    price_volume = F.sum(F.col("price") * F.col("quantity"))
    return (
        with_trade_date(trades)
        .groupBy("trade_date", "ticker")
        .agg(F.sum("quantity").alias("total_volume"), ratio(price_volume, F.sum("quantity")).alias("vwap"))
    )


def daily_ticker_baselines(trades: DataFrame) -> DataFrame:
    """Mean and sample standard deviation of the price per (ticker, day); no deviation for a single trade."""
    return (
        with_trade_date(trades)
        .groupBy("ticker", "trade_date")
        .agg(F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("stddev_price"))
    )


def trade_zscores(trades: DataFrame, baselines: DataFrame | None = None) -> DataFrame:
    """All trades with ``price_z_score``; NULL where the day has no deviation.

    The baseline is a written table, as it is for its users, and is joined back rather than computed by a window
    over the trades: a window would sort all trades of one (day, ticker) in one task. The join is planned from the
    table's size: broadcast while small, otherwise a shuffled join whose hot keys AQE splits.
    """
    if baselines is None:
        baselines = stage(daily_ticker_baselines(trades), "baselines")
    columns = trades.columns
    z = ratio(F.col("price") - F.col("avg_price"), F.col("stddev_price")).alias("price_z_score")
    return with_trade_date(trades).join(baselines, ["ticker", "trade_date"], "left").select(*columns, z)


def outside(df: DataFrame, column: str, limit: float) -> DataFrame:
    """Rows whose absolute value is strictly above ``limit``; NULL is never outside."""
    return df.filter(F.abs(F.col(column)) > F.lit(limit))

"""Orderings with a limit. Each plans as TakeOrderedAndProject: n rows per task, no full sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest_rows(df: DataFrame, time: str, key: str, n: int = 10) -> DataFrame:
    """The ``n`` newest rows, ties broken by key."""
    return df.orderBy(F.col(time).desc(), F.col(key)).limit(n)


def largest_rows(df: DataFrame, measure: str, key: str | Sequence[str], n: int = 5) -> DataFrame:
    """The ``n`` rows with the largest measure, ties broken by key (one column, or several that are unique together)."""
    keys = [key] if isinstance(key, str) else key
    return df.orderBy(F.col(measure).desc(), *keys).limit(n)


def sample_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The first ``n`` rows by key, so that a display shows the same rows each time."""
    return df.orderBy(key).limit(n)


def last_tickers(trades: DataFrame, n: int = 3) -> DataFrame:
    """The tickers of the ``n`` newest trades, oldest of them first, as one comma-separated value."""
    newest = latest_rows(trades.select("trade_timestamp", "trade_id", "ticker"), "trade_timestamp", "trade_id", n)
    entries = F.array_sort(F.collect_list(F.struct("trade_timestamp", F.col("trade_id"), F.col("ticker"))))
    return newest.agg(F.concat_ws(", ", F.transform(entries, lambda e: e["ticker"])).alias("last_tickers"))

"""Grouped measures and table summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.labels import customer_tier
from tallyhouse.functions.numbers import ratio


def join_customers(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Inner equi-join on ``customer_id`` with one key column in the output."""
    return sales.join(customers, "customer_id", "inner")


def spend_per_customer(sales: DataFrame) -> DataFrame:
    """Sales folded to one row per (customer, region) before any join.

    Partial aggregation runs before the exchange, so a customer holding a large share of the sales reaches the
    exchange as one row per task, and the join below sees customers instead of sales.
    """
    return sales.groupBy("customer_id", "region").agg(
        F.sum("transaction_amount").alias("amount"),
        F.count("transaction_amount").alias("n_amounts"),
    )


def tier_summary(sales: DataFrame, customers: DataFrame) -> DataFrame:
    """Total, mean and distinct customers per (region, state, tier)."""
    spend = spend_per_customer(sales)
    tiers = customers.select("customer_id", "state", customer_tier(F.col("state")).alias("customer_tier"))
    return (
        spend.join(tiers, "customer_id", "inner")
        .groupBy("region", "state", "customer_tier")
        .agg(
            F.sum("amount").alias("total_sales"),
            ratio(F.sum("amount"), F.sum("n_amounts")).alias("average_sale_amount"),
            F.count_distinct("customer_id").alias("distinct_customers"),
        )
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"))


def latest_value(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.max(column).alias(f"latest_{column}"))


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """Distinct values; NULL is one of them."""
    return df.select(column).distinct()


def distinct_rows_count(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, a NULL value counted as one (unlike ``count(distinct)``)."""
    return distinct_values(df, column).agg(F.count(F.lit(1)).alias("n_distinct"))


def table_status(trades: DataFrame) -> DataFrame:
    """Metric/value rows about a trades table in one pass over three columns."""
    has_null = F.coalesce(F.max(F.col("ticker").isNull().cast("int")), F.lit(0))
    facts = trades.agg(
        F.count(F.lit(1)).alias("n"),
        (F.count_distinct("ticker") + has_null).alias("tickers"),
        F.max("trade_timestamp").alias("latest"),
    )
    return facts.select(
        F.expr(
            "stack(3,"
            " 'Total Trades', format_number(n, 0),"
            " 'Active Tickers', cast(tickers as string),"
            " 'Latest Trade', coalesce(date_format(latest, 'yyyy-MM-dd HH:mm:ss'), 'N/A')"
            ") as (metric, value)"
        )
    )


def side_counts(trades: DataFrame) -> DataFrame:
    """BUY count; every other row, also a missing side, counts as SELL."""
    buys = F.count_if(F.col("trade_side") == "BUY")
    return trades.agg(buys.alias("buys"), (F.count(F.lit(1)) - buys).alias("sells"))

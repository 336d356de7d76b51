"""Cost ratios against the mean of their year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.functions.numbers import ratio
from tallyhouse.session import stage

FIRST_RECORD_YEAR = 2020


def cost_ratios(accounts: DataFrame, first_year: int = FIRST_RECORD_YEAR) -> DataFrame:
    return accounts.filter(F.col("record_year") >= first_year).withColumn(
        "individual_cost_ratio", ratio(F.col("total_costs"), F.col("revenue"))
    )


def with_group_mean(df: DataFrame, group: str, value: str, mean: str) -> DataFrame:
    """Each row with the mean of its group; the rows of ``avg(value) over (partition by group)``.

    Aggregated first and joined back from a written table of one row per group, because a window would sort a whole
    group in one task. A NULL group keeps its own mean, as in the window.
    """
    means = stage(df.groupBy(F.col(group).alias("_group")).agg(F.avg(value).alias(mean)), "group-mean")
    return df.join(means, F.col(group).eqNullSafe(F.col("_group")), "inner").drop("_group")


def performance_index(ratios: DataFrame) -> DataFrame:
    """100 times the own ratio over the market mean of the year."""
    market = with_group_mean(ratios, "record_year", "individual_cost_ratio", "market_avg_cost_ratio")
    index = ratio(F.col("individual_cost_ratio"), F.col("market_avg_cost_ratio")) * 100
    return market.select(
        "record_id",
        "account_id",
        "record_year",
        "individual_cost_ratio",
        "market_avg_cost_ratio",
        index.alias("performance_index"),
    )


def flag_deviating(benchmarks: DataFrame, limit: float = 100.0) -> DataFrame:
    """``is_deviating`` for an index strictly above ``limit``; NULL index gives NULL."""
    return benchmarks.withColumn("is_deviating", F.col("performance_index") > F.lit(limit))

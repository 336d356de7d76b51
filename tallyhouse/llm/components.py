"""Connected components of a table of links, by rounds of joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import stage


def _towards_least(links: DataFrame, larger_only: bool) -> DataFrame:
    """Every node's neighbours linked to the least among them and itself; partial minima before each shuffle."""
    if larger_only:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("least"))
    # read back, so that the join's own exchange lets hubs be split
    least = stage(least, "least")
    joined = both.join(least, "a")
    if larger_only:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).unionAll(
            least.select("a", F.col("least").alias("b"))
        )
    return moved.filter(F.col("a") != F.col("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node of ``links`` (a, b): root is the least node that links lead to.

    Alternates large-star and small-star rounds, whose number grows with the logarithm of the longest chain; every round
    is written to the shared folder. Nodes without links to others are not returned.
    """
    current = stage(links.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "links")
    known = None
    while True:
        current = stage(_towards_least(_towards_least(current, True), False), "links")
        sums = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"),
        ).first()
        if known == (sums["n"], sums["s"]):
            break
        known = (sums["n"], sums["s"])
    stars = current.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.unionAll(stars.select(F.col("root").alias("node"), "root").distinct())

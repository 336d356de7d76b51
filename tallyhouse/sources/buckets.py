"""Catalog tables bucketed by a key for joins without an exchange, with hot keys split over several buckets.

Facts and dimension have the same number of buckets over (key, salt). A key with more rows than a bucket should hold has a
salt from 0 up to its number of parts, drawn from a hash of the row; the dimension has such a key's rows once for each
salt. Fewer keys than there are buckets can be that large, so that the table of them is small whatever the data.

A null key is a key like others in the files and matches nothing in joins; repeated rows are kept; empty tables give empty
buckets. Columns named ``_salt`` and ``_split`` are added and must not be there before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import stage
from tallyhouse.sources.tables import quoted

SALT, SPLIT = "_salt", "_split"

#: Parts of a hot key for each even share of a bucket that it has: more of them lie more evenly.
PARTS_PER_SHARE = 2


def hot_keys(facts: DataFrame, key: str, buckets: int) -> DataFrame:
    """(_hot, parts) of the keys with more rows than an even share of a bucket; fewer than ``buckets`` rows."""
    counts = facts.groupBy(F.col(key).alias("_hot")).agg(F.count(F.lit(1)).alias("n"))
    share = max(facts.count() / buckets, 1.0)
    parts = F.ceil(PARTS_PER_SHARE * F.col("n") / share).cast("int").alias("parts")
    return stage(counts.filter(F.col("n") > share).select("_hot", parts), "hot")


def _marked(rows: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    taken = {SALT, SPLIT} & set(rows.columns)
    if taken:
        raise ValueError(f"columns {sorted(taken)} are there already")
    # a bounded table, see hot_keys
    return rows.join(F.broadcast(hot), F.col(key).eqNullSafe(F.col("_hot")), "left").drop("_hot")


def write_bucketed(
    facts: DataFrame,
    dimension: DataFrame,
    key: str,
    spread_by: str,
    names: tuple[str, str],
    locations: tuple[str, str],
    buckets: int = 200,
) -> None:
    """Write both tables to ``locations`` and enter them in the catalog as ``names``, replacing what is there."""
    hot = hot_keys(facts, key, buckets)
    drawn = F.pmod(F.xxhash64(F.col(spread_by)), F.coalesce("parts", F.lit(1))).cast("int")
    salted = _marked(facts, key, hot).withColumn(SALT, drawn).withColumn(SPLIT, F.col("parts").isNotNull())
    every = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))
    repeated = _marked(dimension, key, hot).withColumn(SALT, every)
    for rows, name, location in zip((salted, repeated), names, locations):
        # dealt by the same hash as the buckets, so that each bucket is one file
        dealt = rows.drop("parts").repartition(buckets, key, SALT)
        writer = dealt.write.mode("overwrite").format("parquet").option("path", location)
        writer.bucketBy(buckets, key, SALT).sortBy(key, SALT).saveAsTable(quoted(name))


def join_bucketed(facts: DataFrame, dimension: DataFrame, key: str) -> DataFrame:
    """Inner join of two such tables, or of rows folded by key and salt: neither side is exchanged."""
    return facts.join(dimension.hint("merge"), [key, SALT])

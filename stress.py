"""Times the operators on generated tables in which one key, account or vector holds a third of all rows.

    python stress.py [rows]        default 10,000,000; data goes to the shared folder

Each operator is run next to the plain form it replaces, with the same result.
"""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, Window  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from tallyhouse.functions.numbers import draw  # noqa: E402
from tallyhouse.operators.outliers import outside, trade_zscores  # noqa: E402
from tallyhouse.operators.periods import match_periods  # noqa: E402
from tallyhouse.operators.vector_search import nearest_for_each  # noqa: E402
from tallyhouse.plans.sales import sales_summary  # noqa: E402
from tallyhouse.session import build_session, scratch_path  # noqa: E402
from tallyhouse.sources import generate  # noqa: E402
from tallyhouse.sources.files import scan_parquet, write_clustered, write_parquet  # noqa: E402


def hot(value, other):
    return F.when(F.col("id") % 3 == 0, value).otherwise(other)


def timed(label: str, df: DataFrame) -> None:
    """The second of two runs."""
    for _ in range(2):
        start = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
    print(f"{label:<52}{time.perf_counter() - start:8.1f} s", flush=True)


def written(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(spark, f"stress-{label}")
    write_parquet(df, path)
    return scan_parquet(spark, path)


def sales(spark: SparkSession, rows: int) -> None:
    buyers = rows // 20
    customers = written(spark, generate.customers(spark.range(buyers)), "customers")
    facts = generate.sales(spark.range(rows), buyers)
    one_buyer = F.when(F.col("transaction_id") % 3 == 0, F.lit(5).cast("long")).otherwise(F.col("customer_id"))
    raw = written(spark, facts.withColumn("customer_id", one_buyer), "sales")
    path = scratch_path(spark, "stress-clustered")
    write_clustered(raw, path, "customer_id", "transaction_id")
    timed("sales summary", sales_summary(raw, customers))
    timed("sales summary, clustered files", sales_summary(scan_parquet(spark, path), customers))
    plain = raw.join(customers, "customer_id").groupBy("region", "state").agg(
        F.sum("transaction_amount"), F.avg("transaction_amount"), F.count_distinct("customer_id")
    )
    timed("  plain: join, then group", plain)


def trades(spark: SparkSession, rows: int) -> None:
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 250).cast("int"))
    ids = spark.range(rows).select("id", hot(F.lit("2024-03-01").cast("date"), day).alias("day"))
    made = generate.trades(ids, F.col("day"))
    one_ticker = F.when(F.to_date("trade_timestamp") == "2024-03-01", "NVDA").otherwise(F.col("ticker"))
    data = written(spark, made.withColumn("ticker", one_ticker), "trades")
    timed("trade z-scores", outside(trade_zscores(data), "price_z_score", 1.5))
    group = Window.partitionBy(F.to_date("trade_timestamp"), "ticker")
    z = (F.col("price") - F.avg("price").over(group)) / F.stddev_samp("price").over(group)
    timed("  plain: window over each day and ticker", outside(data.withColumn("z", z), "z", 1.5))


def periods(spark: SparkSession, rows: int) -> None:
    def dated(n: int, stream: int, name: str) -> DataFrame:
        account = hot(F.lit("hot"), F.concat(F.lit("k"), draw(F.col("id"), stream) % 100_000))
        start = F.date_add(F.lit("2015-01-01").cast("date"), (draw(F.col("id"), stream + 1) % 3650).cast("int"))
        return spark.range(n).select(F.col("id").alias(name), account.alias("account"), start.alias("day"))

    events = written(spark, dated(rows // 5, 31, "event"), "events")
    terms = dated(rows // 50, 41, "period").select("period", "account", F.col("day").alias("s"), F.date_add("day", 1).alias("e"))
    terms = written(spark, terms, "periods")
    matched = match_periods(events, terms, on="account", date="day", start="s", end="e")
    timed("events in two-day periods, grain chosen", matched.agg(F.count(F.lit(1)), F.sum("period")))
    monthly = match_periods(events, terms, on="account", date="day", start="s", end="e", grain="month")
    timed("  monthly buckets", monthly.agg(F.count(F.lit(1)), F.sum("period")))


def vectors(spark: SparkSession, rows: int) -> None:
    entries = F.sequence(F.lit(1), F.lit(64))
    vector = F.transform(entries, lambda i: (draw(F.col("src") * 64 + i, 51) / 2147483647.0 - 0.5).cast("float"))
    source = spark.range(rows // 25).select("id", hot(F.lit(1), F.col("id")).alias("src"))
    corpus = written(spark, source.select("id", vector.alias("v")), "vectors")
    queries = corpus.orderBy("id").limit(1000).select(F.col("id").alias("q"), F.col("v").alias("qv"))
    found = nearest_for_each(corpus, queries, 10, key="id", vector="v", query_key="q", query_vector="qv")
    timed("ten nearest of 1,000 queries, a third are copies", found)


def main() -> None:
    rows = int(sys.argv[1]) if len(sys.argv) > 1 else 10_000_000
    spark = build_session(
        "tallyhouse-stress",
        spark__sql__shuffle__partitions="64",
        spark__ui__enabled="false",
        spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    print(f"{rows:,} rows")
    for part in (sales, trades, periods, vectors):
        part(spark, rows)
    spark.stop()


if __name__ == "__main__":
    main()

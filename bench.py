"""Headline reports at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of three runs after a warm-up, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyhouse.session import build_session  # noqa: E402
from workload.spark_queries import QUERIES  # noqa: E402

HEADLINE = {
    "m1_sales_summary": "orders",
    "m2_sales_summary_sql": "orders",
    "m2_sales_summary_clustered": "orders",
    "m3_compliance_review": "events",
    "m4_daily_ticker_summary": "events",
    "m5_table_life": "events",
    "m6_portfolio_scores": "orders",
    "m6_riskiest_surveys": "orders",
    "m7_account_benchmarks": "lineitem",
    "m8_text_search": "documents",
    "m8_passage_search": "documents",
    "m9_shared_equipment": "lineitem",
    "m10_handling_features": "events",
    "d3_weights": "lineitem",
    "f5_nearest": "embeddings",
    "i1_stream_ingest": "events",
    "i4_sales": "lineitem",
}
RUNS = 3


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tallyhouse-bench",
        f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="12g",
        spark__sql__warehouse__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in sorted(set(HEADLINE.values()))}
    seconds, rate = {}, {}
    for name, table in HEADLINE.items():
        run(spark, name, sf_dir)
        seconds[name] = round(statistics.median(run(spark, name, sf_dir) for _ in range(RUNS)), 4)
        rate[name] = round(rows[table] / seconds[name])
    spark.stop()
    result = {
        "metric": "sum of the median seconds of the headline reports",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "rows_per_sec": rate,
        "sf": os.path.basename(sf_dir).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()

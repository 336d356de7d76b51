"""Life of a trades table: append, new column, backfill, append, read old and new."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.sources.versions import VersionedTable

# Fixed values of the backfill: record of the named ticker, record of all other trades.
HFT_TICKER = "NVDA"
HFT = {"reporter_id": "CAT_DESK_HFT", "order_event_type": "TRD_POST", "handling_instructions": "algorithmic"}
LEGACY = {
    "reporter_id": "CAT_DESK_LEGACY",
    "order_event_type": "TRD_HISTORICAL",
    "handling_instructions": "unspecified",
}


def compliance_record(values: dict[str, str], session_id: Column, reported_at: Column) -> Column:
    texts = [F.lit(values[k]).alias(k) for k in ("reporter_id", "order_event_type", "handling_instructions")]
    return F.struct(*texts, session_id.alias("session_id"), reported_at.alias("reported_timestamp"))


def compliance_rules(
    spark: SparkSession, ticker: str = HFT_TICKER, session_id: Column | None = None, reported_at: Column | None = None
) -> DataFrame:
    """One rule row: the record for trades of ``ticker``. By default a new session id and the current time."""
    session_id = F.expr("uuid()") if session_id is None else session_id
    reported_at = F.current_timestamp() if reported_at is None else reported_at
    record = compliance_record(HFT, session_id, reported_at)
    return spark.range(1).select(F.lit(ticker).alias("ticker"), record.alias("cat_compliance"))


def legacy_record() -> Column:
    return compliance_record(LEGACY, F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz"))


def table_life(
    spark: SparkSession, path: str, first: DataFrame, column: T.StructField, rules: DataFrame, later: DataFrame
) -> tuple[VersionedTable, list[str]]:
    """Run the whole life; returns the table and the ids of its three snapshots."""
    table = VersionedTable.create(spark, path, first.schema)
    before = table.append(first)
    table.add_columns([column])
    filled = table.backfill(rules, key="ticker", column=column.name, default=legacy_record())
    after = table.append(later)
    return table, [before, filled, after]

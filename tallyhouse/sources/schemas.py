"""Declared schemas; column comments travel in the field metadata."""

from __future__ import annotations

from pyspark.sql import types as T


def _field(name: str, kind: T.DataType, comment: str | None = None) -> T.StructField:
    return T.StructField(name, kind, True, {"comment": comment} if comment else {})


CUSTOMERS = T.StructType(
    [
        _field("customer_id", T.LongType()),
        _field("name", T.StringType()),
        _field("state", T.StringType()),
        _field("signup_date", T.TimestampType()),
    ]
)

SALES = T.StructType(
    [
        _field("transaction_id", T.LongType()),
        _field("customer_id", T.LongType()),
        _field("product_id", T.LongType()),
        _field("transaction_amount", T.DoubleType()),
        _field("timestamp", T.TimestampType()),
        _field("region", T.StringType()),
    ]
)

TRADES = T.StructType(
    [
        _field("trade_id", T.StringType(), "Identifier of the trade."),
        _field("trade_timestamp", T.TimestampType(), "Time of execution, UTC."),
        _field("ticker", T.StringType(), "Stock symbol."),
        _field("price", T.DoubleType(), "Price per share at execution."),
        _field("quantity", T.LongType(), "Number of shares."),
        _field("trade_side", T.StringType(), "BUY or SELL."),
        _field("executing_account", T.StringType(), "Account that placed the trade."),
    ]
)

CAT_COMPLIANCE = T.StructType(
    [
        _field("reporter_id", T.StringType()),
        _field("order_event_type", T.StringType()),
        _field("handling_instructions", T.StringType()),
        _field("session_id", T.StringType()),
        _field("reported_timestamp", T.TimestampType()),
    ]
)

TRADES_WITH_COMPLIANCE = T.StructType([*TRADES.fields, _field("cat_compliance", CAT_COMPLIANCE)])


def without_zone(schema: T.StructType) -> T.StructType:
    """The same schema with zone-less timestamps, for files written without a zone."""

    def convert(kind: T.DataType) -> T.DataType:
        if isinstance(kind, T.TimestampType):
            return T.TimestampNTZType()
        if isinstance(kind, T.StructType):
            return without_zone(kind)
        return kind

    return T.StructType([T.StructField(f.name, convert(f.dataType), f.nullable, f.metadata) for f in schema.fields])

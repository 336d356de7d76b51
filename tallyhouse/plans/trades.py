"""Trade reports."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyhouse.operators.features import index_labels, struct_field
from tallyhouse.operators.outliers import outside, trade_zscores

REVIEW_LIMIT = 1.5


def compliance_review(trades: DataFrame, limit: float = REVIEW_LIMIT) -> DataFrame:
    """Trades whose price lies more than ``limit`` deviations from the mean of their day and ticker."""
    return outside(trade_zscores(trades), "price_z_score", limit)


def handling_features(trades: DataFrame) -> DataFrame:
    """Handling code of the compliance record as a column and as a numeric index."""
    typed = struct_field(trades, "cat_compliance.handling_instructions", "handling_type")
    return index_labels(typed, "handling_type", "handling_index")

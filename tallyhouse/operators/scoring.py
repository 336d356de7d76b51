"""Rating scores, loss weights and the weighted composite."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyhouse.functions.labels import HAZARD_AREAS, hazard_area, rating_points, rating_score
from tallyhouse.functions.numbers import ratio

# Fixed values of the composite: stand-ins for an unassessed area and for an area without losses.
UNASSESSED_SCORE = 2.5
UNWEIGHTED_SHARE = 0.125
FIRST_ACCIDENT_YEAR = 2020


def score_column(area: str) -> str:
    return f"score_{area.lower()}"


def rating_column(area: str) -> str:
    return f"rating_{area.lower()}"


def rating_scores(surveys: DataFrame, keep: Sequence[str], areas: Sequence[str] = HAZARD_AREAS) -> DataFrame:
    """One score column per rating column, plus the ``keep`` columns."""
    scale = rating_points()
    scores = [rating_score(F.col(rating_column(a)), scale).alias(score_column(a)) for a in areas]
    return surveys.select(*keep, *scores)


def losses_by_account(claims: DataFrame, first_year: int = FIRST_ACCIDENT_YEAR) -> DataFrame:
    """Incurred loss per (account, hazard area) since ``first_year``."""
    return (
        claims.filter(F.col("accident_year") >= first_year)
        .groupBy("account_id", hazard_area(F.col("cause_code")).alias("hazard_area"))
        .agg(F.sum("incurred_loss_amount").alias("total_hazard_loss"))
    )


def segment_weights(losses: DataFrame) -> DataFrame:
    """Share of the total loss per hazard area, ``Other`` left out.

    The window runs over one row per area, after the aggregation.
    """
    total = F.sum("area_loss").over(Window.partitionBy(F.lit(1)))
    return (
        losses.filter(F.col("hazard_area") != "Other")
        .groupBy("hazard_area")
        .agg(F.sum("total_hazard_loss").alias("area_loss"))
        .select("hazard_area", ratio(F.col("area_loss"), total).alias("area_weight"))
    )


def composite_scores(
    scores: DataFrame,
    weights: DataFrame,
    keep: Sequence[str],
    *,
    areas: Sequence[str] = HAZARD_AREAS,
    unassessed: float = UNASSESSED_SCORE,
    unweighted: float = UNWEIGHTED_SHARE,
    digits: int | None = 2,
    normalise: bool = False,
) -> DataFrame:
    """Sum over the areas of score times weight.

    An area without a score counts ``unassessed`` and an area without losses weighs ``unweighted``, on top of shares
    that already sum to one; ``normalise=True`` divides by the sum of the weights used. The weights, at most one per
    area, enter as one scalar subquery, so the surveys are neither joined nor shuffled.
    """
    wanted = weights.filter(F.col("hazard_area").isin(*areas))
    by_area = wanted.agg(F.map_from_entries(F.collect_list(F.struct("hazard_area", "area_weight"))).alias("w"))
    filled = [F.coalesce(F.try_element_at("w", F.lit(a)), F.lit(unweighted)) for a in areas]
    lookup = by_area.select(F.array(*filled)).scalar()
    missing = F.lit(unassessed)
    total = F.lit(0.0)
    for position, area in enumerate(areas):
        total = total + F.coalesce(score_column(area), missing) * F.col("_weights")[position]
    value = total
    if normalise:
        value = ratio(total, F.aggregate("_weights", F.lit(0.0), lambda used, weight: used + weight))
    if digits is not None:
        value = F.round(value, digits)
    return scores.withColumn("_weights", lookup).select(*keep, value.alias("loss_weighted_composite_score"))

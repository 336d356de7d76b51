"""Recoding and labelling of columns."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of the Gold tier.
GOLD_STATES = ("CA", "NY")

# Points per rating. Everything else ("Not Applicable", "Not Enough Info", NULL) has no score.
RATING_POINTS = {"Excellent": 10.0, "Good": 20.0, "Fair": 30.0, "Poor": 40.0}

# Claim cause codes per hazard area.
CAUSE_CODES = {
    "Lifting": ("LIFT_01", "STRAIN_04"),
    "Lacerations": ("CUT_02", "SHARP_09"),
    "Material_Handling": ("LOADING_03", "CARGO_11"),
    "Overhead_Lifting": ("CRANE_05", "HOIST_12"),
    "Machine_Guarding": ("GUARD_06", "ELEC_07", "LOTO_13"),
    "Occ_Disease": ("DUST_08", "CHEM_14", "TOXIC_15"),
    "Walking_Surfaces": ("SLIP_09", "TRIP_10", "SURFACE_16"),
    "Elevated_Surfaces": ("FALL_17", "SCAFFOLD_18"),
}
HAZARD_AREAS = tuple(CAUSE_CODES)


def customer_tier(state: Column, gold: Sequence[str] = GOLD_STATES) -> Column:
    """Two tiers; an unknown (NULL) state is Silver."""
    return F.when(state.isin(*gold), F.lit("Gold")).otherwise(F.lit("Silver"))


def rating_points(points: Mapping[str, float] = RATING_POINTS) -> Column:
    """The scale as a constant map, to be shared by all rating columns."""
    return F.create_map(*[F.lit(entry) for label, value in points.items() for entry in (label, float(value))])


def rating_score(rating: Column, scale: Column | None = None) -> Column:
    """Points of a rating as double, NULL if it is not on the scale."""
    return F.try_element_at(rating_points() if scale is None else scale, rating)


def hazard_area(
    cause: Column, areas: Mapping[str, Sequence[str]] = CAUSE_CODES, default: str = "Other"
) -> Column:
    """Area whose code list holds the cause; ``default`` for any other code and for NULL."""
    area = F.lit(default)
    for label, codes in reversed(list(areas.items())):
        area = F.when(cause.isin(*codes), F.lit(label)).otherwise(area)
    return area

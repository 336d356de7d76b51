"""Assignment of dated events to contract periods (valid-time join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyhouse.session import build_side, row_bytes, stage

GRAINS = ("day", "month", "year")
SPREADS = ("calendar", "stretches")
MAX_REPEATS = 16

#: Pairs of events and periods of one key from which on the key is spread over calendar buckets.
HOT_PAIRS = 20_000_000

#: Stretches that a hot key's events are cut into, of about equal numbers of events.
STRETCHES = 64


def _bucket(date: Column, grain: str) -> Column:
    day = F.to_date(date)
    return day if grain == "day" else F.trunc(day, grain)


def _bucket_count(first: Column, last: Column, grain: str) -> Column:
    years = F.year(last) - F.year(first)
    if grain == "day":
        return F.datediff(last, first) + 1
    if grain == "month":
        return years * 12 + F.month(last) - F.month(first) + 1
    return years + 1


def _covered(on: str, date: str, start: str, end: str, closed: str) -> Column:
    before_end = F.col(f"e.{date}") <= F.col(f"p.{end}") if closed == "both" else F.col(f"e.{date}") < F.col(f"p.{end}")
    return (F.col(f"e.{on}") == F.col(f"p.{on}")) & (F.col(f"e.{date}") >= F.col(f"p.{start}")) & before_end


def match_periods(
    events: DataFrame,
    periods: DataFrame,
    *,
    on: str,
    date: str,
    start: str,
    end: str,
    how: str = "inner",
    closed: str = "both",
    grain: str | None = None,
    hot_pairs: int = HOT_PAIRS,
    spread: str = "calendar",
) -> DataFrame:
    """Events with every period of the same key that covers their date or time.

    ``closed="both"`` includes both ends, so an event on a renewal day matches the old and the new period;
    ``closed="left"`` leaves the end out. ``how="left"`` keeps events without a period. Dates and times compare as Spark
    compares them: a date is its midnight.

    The join is on the key with the period as a condition. Keys with ``hot_pairs`` or more pairs of events and periods
    are joined on (key, calendar bucket) instead, with the same condition: their periods are repeated once per bucket
    that they cover, so that rows only meet within a bucket. Which keys these are is counted beforehand, both sides
    aggregated by key; the rows returned do not depend on it. A ``grain`` puts all keys into buckets of that size.

    ``spread="stretches"`` cuts a hot key at quantiles of its own event times instead of calendar buckets, and repeats a
    period once for each cut that it crosses. It suits long periods, and events that crowd in a part of the calendar.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be 'inner' or 'left'")
    if closed not in ("both", "left"):
        raise ValueError("closed must be 'both' or 'left'")
    if grain is not None and grain not in GRAINS:
        raise ValueError(f"grain must be one of {GRAINS}")
    if spread not in SPREADS:
        raise ValueError(f"spread must be one of {SPREADS}")
    names = {"on": on, "date": date, "start": start, "end": end}
    if grain is not None:
        return _bucketed(events, periods, **names, how=how, closed=closed, grain=grain)

    n_events = events.groupBy(on).agg(F.count(F.lit(1)).alias("_events"))
    per_key = periods.groupBy(on).agg(F.count(F.lit(1)).alias("_periods"), F.sum(row_bytes(periods)).alias("_bytes"))
    pairs = F.coalesce(F.col("_events") * F.col("_periods"), F.lit(0))
    counted = per_key.join(n_events, on, "left").select(on, "_bytes", (pairs >= hot_pairs).alias("_hot"))
    facts = counted.agg(
        F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes"), F.coalesce(F.max("_hot"), F.lit(False)).alias("hot")
    ).first()
    if not facts["hot"]:
        return _plain(events, build_side(periods, facts["bytes"]), **names, how=how, closed=closed, columns=periods.columns)

    hot = stage(counted.filter("_hot").select(on), "hot-keys")
    cold_events, cold_periods = (df.join(hot, on, "left_anti").select(*df.columns) for df in (events, periods))
    hot_events, few_periods = (df.join(hot, on, "left_semi").select(*df.columns) for df in (events, periods))
    cold = _plain(
        cold_events, build_side(cold_periods, facts["bytes"]), **names, how=how, closed=closed, columns=periods.columns
    )
    if spread == "stretches":
        return cold.unionAll(_stretched(hot_events, few_periods, **names, how=how, closed=closed))
    return cold.unionAll(_bucketed(hot_events, few_periods, **names, how=how, closed=closed, grain=None))


def _plain(events, periods, *, on, date, start, end, how, closed, columns) -> DataFrame:
    kept = [F.col(f"e.{c}") for c in events.columns] + [F.col(f"p.{c}") for c in columns if c != on]
    return events.alias("e").join(periods.alias("p"), _covered(on, date, start, end, closed), how).select(*kept)


def _stretch(cuts: Column, time: Column) -> Column:
    """How many cuts are not after ``time``. It never falls as time goes on, which is all that the join relies on."""
    return F.size(F.filter(cuts, lambda cut: cut <= time))


def stretched_periods(periods: DataFrame, cuts: DataFrame, *, on: str, start: str, end: str) -> DataFrame:
    """``periods`` once for each stretch ``_stretch`` that they meet, by their key's ``_cuts``."""
    first, last = _stretch(F.col("_cuts"), F.col(start)), _stretch(F.col("_cuts"), F.col(end))
    sound = periods.filter(F.col(start) <= F.col(end))
    return sound.join(cuts, on).withColumn("_stretch", F.explode(F.sequence(first, last))).drop("_cuts")


def _stretched(events, periods, *, on, date, start, end, how, closed) -> DataFrame:
    """The join on (key, stretch). An event lies in one stretch, so no pair appears twice."""
    shares = [k / STRETCHES for k in range(1, STRETCHES)]
    # one row a hot key; read back, so that the joins' own exchanges let hot keys be split
    cuts = events.groupBy(on).agg(
        F.coalesce(F.array_distinct(F.percentile_approx(date, shares)), F.array()).alias("_cuts")
    )
    cuts = stage(cuts, "cuts")
    placed = events.join(cuts, on).withColumn("_stretch", _stretch(F.col("_cuts"), F.col(date))).drop("_cuts")
    repeated = stretched_periods(periods, cuts, on=on, start=start, end=end)
    covered = _covered(on, date, start, end, closed) & (F.col("e._stretch") == F.col("p._stretch"))
    kept = [F.col(f"e.{c}") for c in events.columns] + [F.col(f"p.{c}") for c in periods.columns if c != on]
    return placed.alias("e").join(repeated.alias("p"), covered, how).select(*kept)


def _bucketed(events, periods, *, on, date, start, end, how, closed, grain) -> DataFrame:
    """The join on (key, bucket). An event lies in one bucket, so no pair appears twice.

    Periods are clipped to the times that occur in ``events``. One aggregation over them counts the buckets: it picks
    the finest grain that repeats periods at most ``MAX_REPEATS`` times on average, unless one is given, and yields the
    size of the repeated periods, which decides between a broadcast and a sort-merge join.
    """
    span = events.agg(F.struct(F.min(date).alias("lo"), F.max(date).alias("hi")).alias("span")).scalar()
    clipped = (
        periods.withColumn("_span", span)
        .withColumn("_first", F.to_date(F.greatest(F.col(start), F.col("_span.lo"))))
        .withColumn("_last", F.to_date(F.least(F.col(end), F.col("_span.hi"))))
        .filter(F.col("_span.lo").isNotNull() & (F.col("_first") <= F.col("_last")))
        .drop("_span")
    )
    width = row_bytes(periods) + 8
    counts = {g: _bucket_count(F.col("_first"), F.col("_last"), g).cast("long") for g in GRAINS}
    sums = [F.coalesce(F.sum(counts[g]), F.lit(0)).alias(f"{g}_rows") for g in GRAINS]
    sums += [F.coalesce(F.sum(counts[g] * width), F.lit(0)).alias(f"{g}_bytes") for g in GRAINS]
    facts = clipped.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    if grain is None:
        fitting = [g for g in GRAINS if facts[f"{g}_rows"] <= MAX_REPEATS * facts["n"]]
        grain = fitting[0] if fitting else GRAINS[-1]

    buckets = F.sequence(_bucket(F.col("_first"), grain), _bucket(F.col("_last"), grain), F.expr(f"interval 1 {grain}"))
    repeated = clipped.withColumn("_bucket", F.explode(buckets)).drop("_first", "_last")
    covered = _covered(on, date, start, end, closed) & (F.col("e._bucket") == F.col("p._bucket"))
    bucketed = events.withColumn("_bucket", _bucket(F.col(date), grain))
    kept = [F.col(f"e.{c}") for c in events.columns]
    kept += [F.col(f"p.{c}") for c in periods.columns if c != on]
    build = build_side(repeated, facts[f"{grain}_bytes"])
    return bucketed.alias("e").join(build.alias("p"), covered, how).select(*kept)

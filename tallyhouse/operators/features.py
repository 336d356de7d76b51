"""Feature columns: nested fields, category indexes, typed values from stored model output."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.session import broadcast_within, stage

#: Labels that a fitted model may hold in the driver.
MODEL_LABELS = 100_000


def struct_field(df: DataFrame, path: str, name: str) -> DataFrame:
    """A nested field as a top-level column."""
    return df.withColumn(name, F.col(path))


def index_labels(df: DataFrame, label: str, index: str) -> DataFrame:
    """Number the labels by frequency: most frequent 0.0, ties alphabetical; a NULL label is an error.

    Fitting is one distributed count per label. The model holds the distinct labels; where there are more than about
    ``MODEL_LABELS``, the numbers come from ``index_many_labels``.
    """
    if df.agg(F.approx_count_distinct(label)).first()[0] > MODEL_LABELS:
        return index_many_labels(df, label, index)
    return StringIndexer(inputCol=label, outputCol=index).fit(df).transform(df)


def index_many_labels(df: DataFrame, label: str, index: str) -> DataFrame:
    """The numbers of ``index_labels`` for any number of labels, none of which reaches the driver.

    Labels are counted, range-partitioned by (frequency, label) and numbered within their partitions; the labels in the
    partitions before are added, one number a partition. Rows get theirs by a join, whose hot labels AQE splits.
    """
    if not df.filter(F.col(label).isNull()).isEmpty():
        raise ValueError(f"{label} has null labels")
    text = F.col(label).cast("string").alias("_label")
    counts = stage(df.groupBy(text).agg(F.count(F.lit(1)).alias("_n")), "label-counts")
    order = [F.desc("_n"), F.asc("_label")]
    ranged = counts.repartitionByRange(*order).sortWithinPartitions(*order)
    # a partition's number in the upper bits, the place within it in the lower 33
    placed = stage(ranged.select("_label", F.monotonically_increasing_id().alias("_at")), "labels")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    numbered = placed.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    numbers = stage(numbered.select("_label", (F.col("_before") + place).cast("double").alias(index)), "label-numbers")
    joined = df.join(broadcast_within(numbers), F.col(label).cast("string") == F.col("_label"))
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], index)


def parse_payload(df: DataFrame, payload: str, schema: T.StructType, flag: str = "is_parsed") -> DataFrame:
    """Typed columns from a JSON payload; a row whose payload is bad or missing stays, with NULLs and ``flag`` false."""
    corrupt = "_corrupt"
    full = T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())])
    parsed = F.from_json(payload, full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt})
    good = F.col("_parsed").isNotNull() & F.col(f"_parsed.{corrupt}").isNull()
    fields = [F.when(good, F.col(f"_parsed.{f.name}")).alias(f.name) for f in schema.fields]
    kept = [F.col(c) for c in df.columns]
    return df.withColumn("_parsed", parsed).select(*kept, *fields, good.alias(flag))

"""The test tables in the shape of the reports' inputs. Whole tables, renamed and recoded, nothing left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.labels import HAZARD_AREAS
from tallyhouse.operators.scoring import rating_column
from tallyhouse.session import spread, stage
from tallyhouse.sources.files import scan_parquet

PREFIX = "vault/sample-survey-"
SUFFIX = ".pdf"
RATINGS = ("Excellent", "Good", "Fair", "Poor", "Not Applicable", "Not Enough Info")
STATE_OF_SEGMENT = {"BUILDING": "CA", "MACHINERY": "NY", "AUTOMOBILE": "TX", "FURNITURE": "FL", "HOUSEHOLD": "PA"}
CAUSE_OF_TYPE = {
    "ECONOMY": "LIFT_01",
    "SMALL": "CUT_02",
    "LARGE": "GUARD_06",
    "MEDIUM": "CRANE_05",
    "PROMO": "SLIP_09",
    "STANDARD": "CLERICAL",
}
# Declared, so that no query starts with a job that infers a schema from the files.
TABLES = {
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
    "l_shipdate timestamp_ntz",
    "part": "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "embeddings": "vec_id long, embedding array<float>, label int",
    "benchmark": "item_id long, text string",
}
DIMENSIONS = 64  # of the embeddings
YEAR_SHIFT = 24  # the test tables start in 1995, the reports in 2020
MODEL = "Brand#17"
RULE_TICKER = "purchase"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return scan_parquet(spark, f"{sf}/{name}.parquet", TABLES[name])


def texts(spark: SparkSession, sf: str) -> DataFrame:
    return spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")


def _recode(column: str, mapping: dict[str, str]) -> Column:
    value = F.lit(None).cast("string")
    for key, label in mapping.items():
        value = F.when(F.col(column) == key, F.lit(label)).otherwise(value)
    return value


def sales(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderpriority").alias("region"),
        F.col("o_totalprice").alias("transaction_amount"),
        F.col("o_orderdate").alias("timestamp"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("name"),
        _recode("c_mktsegment", STATE_OF_SEGMENT).alias("state"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("trade_id"),
        F.col("ts").alias("trade_timestamp"),
        F.col("event_type").alias("ticker"),
        F.col("value").alias("price"),
        (F.col("user_id") + 1).alias("quantity"),
        F.when(F.col("user_id") % 2 == 0, "BUY").otherwise("SELL").alias("trade_side"),
        F.concat(F.lit("ACC-TRD-0"), (F.col("user_id") % 5 + 1).cast("string")).alias("executing_account"),
    )


def surveys(spark: SparkSession, sf: str) -> DataFrame:
    labels = F.array(*[F.lit(r) for r in RATINGS])
    number = F.lpad(F.col("o_custkey").cast("string"), 9, "0")
    ratings = [
        F.element_at(labels, ((F.col("o_orderkey") + 7 * j) % 6 + 1).cast("int")).alias(rating_column(area))
        for j, area in enumerate(HAZARD_AREAS)
    ]
    return table(spark, sf, "orders").select(
        F.concat(F.lit(PREFIX + "customer-"), number, F.lit(SUFFIX)).alias("survey_filename"),
        *ratings,
        F.to_date("o_orderdate").alias("survey_date"),
        "o_orderkey",
    )


def policies(spark: SparkSession, sf: str) -> DataFrame:
    year = (F.lit(1995) + F.col("c_custkey") % 7).cast("int")
    return table(spark, sf, "customer").select(
        F.concat(F.lit("POL_"), F.col("c_custkey").cast("string")).alias("policy_id"),
        F.concat(F.lit("ACC_"), F.col("c_custkey").cast("string")).alias("account_id"),
        F.col("c_name").alias("account_name"),
        F.make_date(year, F.lit(1), F.lit(1)).alias("effective_date"),
        F.make_date(year + 1, F.lit(1), F.lit(1)).alias("expiration_date"),
        F.round(F.col("c_acctbal") * 100).cast("long").alias("earned_premium"),
    )


def claims(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey", _recode("p_type", CAUSE_OF_TYPE).alias("cause_code"))
    lines = table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("p_partkey"),
        F.concat(F.lit("ACC_"), F.col("l_suppkey").cast("string")).alias("account_id"),
        F.col("l_extendedprice").alias("incurred_loss_amount"),
        (F.year("l_shipdate") + YEAR_SHIFT).cast("long").alias("accident_year"),
    )
    return lines.join(part, "p_partkey").drop("p_partkey")


def accounts(spark: SparkSession, sf: str) -> DataFrame:
    """Revenue and cost per customer and year, as a written table.

    Lines are folded per order before they meet the orders.
    """
    per_order = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("o_orderkey"))
        .agg(
            F.sum("l_extendedprice").alias("revenue"),
            F.sum(F.col("l_extendedprice") * F.col("l_discount")).alias("total_costs"),
        )
    )
    orders = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", (F.year("o_orderdate") + YEAR_SHIFT).cast("long").alias("record_year")
    )
    yearly = (
        per_order.join(orders, "o_orderkey")
        .groupBy("o_custkey", "record_year")
        .agg(F.sum("revenue").alias("revenue"), F.sum("total_costs").alias("total_costs"))
    )
    key = F.col("o_custkey").cast("string")
    records = yearly.select(
        F.concat(F.lit("ACC_"), key).alias("account_id"),
        F.concat(F.lit("REC_"), F.col("record_year").cast("string"), F.lit("_"), key).alias("record_id"),
        "record_year",
        "revenue",
        "total_costs",
    )
    return stage(records, "accounts")


def network(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Customers inspect orders, orders operate parts."""
    orders = table(spark, sf, "orders")
    return {
        "inspectors": table(spark, sf, "customer").select(
            F.col("c_custkey").alias("inspector_id"), F.col("c_name").alias("inspector_name")
        ),
        "policyholders": orders.select(
            F.col("o_orderkey").alias("policyholder_id"), F.col("o_orderpriority").alias("company_name")
        ),
        "machinery": table(spark, sf, "part").select(
            F.col("p_partkey").alias("machine_id"), F.col("p_brand").alias("model_name")
        ),
        "inspects": orders.select(
            F.col("o_custkey").alias("inspector_id"), F.col("o_orderkey").alias("policyholder_id")
        ),
        "operates": table(spark, sf, "lineitem").select(
            F.col("l_orderkey").alias("policyholder_id"), F.col("l_partkey").alias("machine_id")
        ),
    }


def mean_vectors(spark: SparkSession, sf: str, *by: str) -> DataFrame:
    """Mean embedding per group, over all vectors."""
    means = [F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIMENSIONS)]
    return table(spark, sf, "embeddings").groupBy(*by).agg(F.array(*means).alias("query"))


def grants(spark: SparkSession, sf: str) -> DataFrame:
    """Each source of the documents is granted to one of two principals."""
    tenants = table(spark, sf, "documents").select(F.col("source").alias("tenant")).distinct()
    return tenants.withColumn("principal", F.when(F.col("tenant") < "src15", "finance").otherwise("marketing"))

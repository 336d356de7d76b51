"""Sales per region, state and customer tier."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyhouse.functions.labels import GOLD_STATES, customer_tier
from tallyhouse.functions.numbers import ratio
from tallyhouse.operators.grouping import tier_summary
from tallyhouse.sources import generate
from tallyhouse.sources.buckets import SALT, SPLIT, join_bucketed, write_bucketed
from tallyhouse.sources.files import scan_parquet, write_clustered, write_parquet, write_partitioned

# Names of the two tables.
SALES = "sales_transactions.parquet"
CUSTOMERS = "customer_master.parquet"

SUMMARY_SQL = """
WITH spend AS (
  SELECT customer_id, region, sum(transaction_amount) AS amount, count(transaction_amount) AS n_amounts
  FROM {sales}
  GROUP BY customer_id, region
)
SELECT s.region, c.state,
       CASE WHEN c.state IN ({gold}) THEN 'Gold' ELSE 'Silver' END AS customer_tier,
       sum(s.amount) AS total_sales,
       try_divide(sum(s.amount), sum(s.n_amounts)) AS average_sale_amount,
       count(DISTINCT s.customer_id) AS distinct_customers
FROM spend s JOIN {customers} c ON s.customer_id = c.customer_id
GROUP BY 1, 2, 3
ORDER BY total_sales DESC
"""


def sales_summary(sales: DataFrame, customers: DataFrame) -> DataFrame:
    return tier_summary(sales, customers).orderBy(F.col("total_sales").desc())


def sales_summary_sql(spark: SparkSession, sales: DataFrame, customers: DataFrame) -> DataFrame:
    """The same report in SQL, over any layout of the two tables."""
    gold = ", ".join(f"'{state}'" for state in GOLD_STATES)
    return spark.sql(SUMMARY_SQL.replace("{gold}", gold), sales=sales, customers=customers)


def generate_sales_dataset(
    spark: SparkSession,
    path: str,
    num_customers: int = 50_000_000,
    num_transactions: int = 20_000_000_000,
    tasks: int = 4000,
) -> None:
    """Write the skewed dimension and the fact table partitioned by region.

    No exchange: a task draws its rows in all four regions and writes a file for each.
    """
    write_parquet(generate.customers(spark.range(num_customers)), f"{path}/{CUSTOMERS}")
    facts = generate.sales(spark.range(0, num_transactions, 1, tasks), num_customers)
    write_partitioned(facts, f"{path}/{SALES}", "region", balance=False)


def load_clustered(spark: SparkSession, input_path: str, output_path: str) -> None:
    """Copy both tables into files sorted by customer, replacing what is there."""
    sales = scan_parquet(spark, f"{input_path}/{SALES}")
    customers = scan_parquet(spark, f"{input_path}/{CUSTOMERS}")
    write_clustered(sales, f"{output_path}/{SALES}", "customer_id", "transaction_id")
    write_clustered(customers, f"{output_path}/{CUSTOMERS}", "customer_id", "name")


def load_bucketed(
    sales: DataFrame, customers: DataFrame, names: tuple[str, str], path: str, buckets: int = 200
) -> None:
    """Both tables as bucketed catalog tables below ``path``, customers with very many sales split."""
    places = f"{path}/{SALES}", f"{path}/{CUSTOMERS}"
    write_bucketed(sales, customers, "customer_id", "transaction_id", names, places, buckets)


def sales_summary_bucketed(spark: SparkSession, names: tuple[str, str]) -> DataFrame:
    """The same report from bucketed tables. Only the rows of the report, folded in each task, are exchanged.

    A customer whose sales are split has a row for each salt; those few are counted as distinct ones, the others
    as rows.
    """
    sales, customers = (spark.table(name) for name in names)
    spend = sales.groupBy("customer_id", SALT, "region").agg(
        F.sum("transaction_amount").alias("amount"),
        F.count("transaction_amount").alias("n_amounts"),
        F.first(SPLIT).alias(SPLIT),
    )
    tiers = customers.select("customer_id", SALT, "state", customer_tier(F.col("state")).alias("customer_tier"))
    split = F.when(F.col(SPLIT), F.col("customer_id"))
    report = join_bucketed(spend, tiers, "customer_id").groupBy("region", "state", "customer_tier").agg(
        F.sum("amount").alias("total_sales"),
        ratio(F.sum("amount"), F.sum("n_amounts")).alias("average_sale_amount"),
        (F.count_if(~F.col(SPLIT)) + F.count_distinct(split)).alias("distinct_customers"),
    )
    return report.orderBy(F.col("total_sales").desc())


def run_sales_summary(spark: SparkSession, input_path: str, output_path: str) -> None:
    """Read the two tables, write the report. One pass over the sales: nothing is cached or counted on the way."""
    sales = scan_parquet(spark, f"{input_path}/{SALES}")
    customers = scan_parquet(spark, f"{input_path}/{CUSTOMERS}")
    write_parquet(sales_summary(sales, customers), f"{output_path}/final_summary")

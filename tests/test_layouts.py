"""Bucketed tables with split hot keys, and numbers of very many labels."""

import re
import uuid

import pytest
from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from tallyhouse import session
from tallyhouse.operators import features
from tallyhouse.operators.grouping import tier_summary
from tallyhouse.plans import sales as sales_plan
from tallyhouse.sources import buckets, generate


def _rows(df):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.collect()), key=str)


def test_a_third_of_the_rows_on_one_key_without_an_exchange(spark):
    n = 3000
    facts = generate.sales(spark.range(n), 40).withColumn(
        "customer_id", F.when(F.col("transaction_id") % 3 == 0, 7).when(F.col("transaction_id") % 50 == 1, None).otherwise(F.col("customer_id"))
    )
    customers = generate.customers(spark.range(40))
    names = tuple(f"t_{uuid.uuid4().hex}" for _ in range(2))
    sales_plan.load_bucketed(facts, customers, names, session.scratch_path(spark, "buckets"), buckets=10)
    report = sales_plan.sales_summary_bucketed(spark, names)
    assert _rows(report) == _rows(tier_summary(facts, customers))

    joined = buckets.join_bucketed(spark.table(names[0]), spark.table(names[1]), "customer_id")
    assert joined.count() == facts.join(customers, "customer_id").count()
    for plan in (joined, report):
        text = plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
        # exchanges of the report's rows stand above the join, none between it and the scans
        below = text[text.index("SortMergeJoin") :]
        assert "Exchange" not in below and len(re.findall("Bucketed: true", below)) == 2
    sizes = spark.table(names[0]).groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0]
    assert sizes < n / 4


def test_hot_keys_are_fewer_than_buckets_and_empty_tables_work(spark):
    facts = spark.range(100).selectExpr("id % 4 AS k", "id AS r")
    assert buckets.hot_keys(facts, "k", 16).count() == 4
    assert buckets.hot_keys(facts, "k", 4).count() == 0
    names = tuple(f"t_{uuid.uuid4().hex}" for _ in range(2))
    path = session.scratch_path(spark, "buckets")
    buckets.write_bucketed(facts.limit(0), facts.limit(0), "k", "r", names, (f"{path}/a", f"{path}/b"), 4)
    assert buckets.join_bucketed(spark.table(names[0]), spark.table(names[1]).drop("r"), "k").count() == 0
    with pytest.raises(ValueError, match="_salt"):
        buckets.write_bucketed(facts.withColumn("_salt", F.lit(1)), facts, "k", "r", names, (f"{path}/c", f"{path}/d"), 4)


def test_many_labels_have_the_numbers_of_the_model(spark):
    rows = spark.range(5000).selectExpr("id", "concat('x', IF(id % 3 = 0, 0, id % 1700)) AS label").repartition(6)
    expected = StringIndexer(inputCol="label", outputCol="i").fit(rows).transform(rows)
    assert _rows(features.index_many_labels(rows, "label", "i")) == _rows(expected)
    empty = features.index_many_labels(rows.limit(0), "label", "i")
    assert empty.count() == 0 and empty.dtypes == expected.dtypes
    with pytest.raises(ValueError, match="null"):
        features.index_many_labels(rows.withColumn("label", F.lit(None).cast("string")), "label", "i")


def test_the_model_is_left_for_many_labels(spark, monkeypatch):
    rows = spark.range(300).selectExpr("id", "string(id % 90) AS label")
    small = features.index_labels(rows, "label", "i").collect()
    monkeypatch.setattr(features, "MODEL_LABELS", 10)
    assert sorted(small) == sorted(features.index_labels(rows, "label", "i").collect())

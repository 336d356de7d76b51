"""Properties of the physical plans that decide how the queries behave on large tables."""

import os
import re

import pytest

import __spark_entry__ as entry_point
from tallyhouse.operators.vector_search import nearest_for_each

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def plan(spark, name):
    return plan_of(entry_point.queries()[name](spark, SF_DIR))


OURS = sorted(n for n in entry_point.queries() if not re.match(r"op[0-9]+_|pipeline$", n))


@pytest.mark.parametrize("name", OURS)
def test_no_pairwise_joins_and_no_row_udfs(spark, name):
    text = plan(spark, name)
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "FlatMapGroupsInPandas"):
        assert operator not in text


def test_only_needed_columns_are_read(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "m1_sales_summary"))
    assert "o_custkey:bigint,o_totalprice:double,o_orderpriority:string" in read
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, "d8_daily_summary"))
    assert read == ["ts:timestamp_ntz,user_id:bigint,event_type:string,value:double"]


def test_filters_reach_the_files(spark):
    text = plan(spark, "c6_equipment_paths")
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(p_brand,Brand#17\)", text)


def test_sales_are_folded_before_the_join(spark):
    text = plan(spark, "d1_tier_summary")
    join = text.index("Join [customer_id")
    assert "partial_sum(transaction_amount" in text[join:]
    assert "transaction_amount" not in text[:join]


@pytest.mark.parametrize("name", ["f2_latest_rows", "f3_top_rows", "f4_sample_rows", "f5_nearest", "m6_riskiest_surveys"])
def test_top_rows_need_no_full_sort(spark, name):
    text = plan(spark, name)
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


@pytest.mark.parametrize("name", ["c5_zscores", "e1_market_average", "m3_compliance_review", "m7_account_benchmarks"])
def test_baselines_need_no_window(spark, name):
    assert "Window" not in plan(spark, name)


def test_search_ranks_only_the_best_of_each_task(spark):
    text = plan(spark, "c9_distance_to_corpus")
    assert re.search(r"WindowGroupLimit.*Partial", text)


@pytest.mark.parametrize("name", ["b2_scores", "i2_trades", "i4_customers", "i5_compliance", "j4_extraction"])
def test_row_local_work_is_not_shuffled(spark, name):
    assert "Exchange" not in plan(spark, name)


def test_a_search_reads_the_corpus_once_for_any_number_of_queries(spark, tmp_path):
    spark.range(500).selectExpr("id", "array(cast(id as double), 1.0D) as v").write.parquet(f"{tmp_path}/corpus")
    corpus = spark.read.parquet(f"{tmp_path}/corpus")
    queries = spark.range(40).selectExpr("id as q", "array(1.0D, cast(id as double)) as qv")
    found = nearest_for_each(corpus, queries, 3, key="id", vector="v", query_key="q", query_vector="qv", block=7)
    assert plan_of(found).count("FileScan") == 1 and found.count() == 120

"""Every registered query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse.functions import labels, text
from tallyhouse.functions.numbers import ratio
from tallyhouse.operators import benchmarks, embedding, features, grouping, outliers, scoring, tenancy, topk
from tallyhouse.operators.dense_embedding import fit_dense
from tallyhouse.operators.paths import Edge, Node, match_path
from tallyhouse.operators.text_index import TextIndex
from tallyhouse.operators.vector_index import DenseIndex
from tallyhouse.operators.vector_search import nearest, nearest_for_each
from tallyhouse.plans import lakehouse, sales as sales_plan, surveys as survey_plan, trades as trade_plan
from tallyhouse.operators.periods import match_periods
from tallyhouse.session import broadcast_within, scratch_path, stage
from tallyhouse.sources import files, generate, schemas, tables
from tallyhouse.sources.versions import VersionedTable, conditional_update
from tallyhouse.operators.running import RunningSummary
from tallyhouse.streaming import arrivals
from tallyhouse.streaming.ingest import ingest_into
from workload import inputs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

QUESTION = "liquid leaks, wet floors, slip and fall hazards"
SPLIT_TIME = "2024-01-16 00:00:00"
SESSION_ID = "SESS-BACKFILL"
REPORTED_AT = "2024-02-01 00:00:00"


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _r(column: str, digits: int):
    return F.round(column, digits).alias(column)


# --- scans and sinks -------------------------------------------------------------------------------------------


@query
def a1_scan_parquet(spark, sf):
    return files.scan_parquet(spark, f"{sf}/orders.parquet")


@query
def a2_scan_partitioned(spark, sf):
    path = scratch_path(spark, "a2")
    lines = inputs.table(spark, sf, "lineitem")
    files.write_partitioned(lines, path, "l_returnflag")
    return files.scan_parquet(spark, path).select(*lines.columns)


@query
def a3_declared_schema(spark, sf):
    declared = "p_partkey long, p_name string, p_brand string, p_size long, p_retailprice double"
    return files.scan_parquet(spark, f"{sf}/part.parquet", declared)


@query
def a4_clustered_load(spark, sf):
    path = scratch_path(spark, "a4")
    files.write_clustered(inputs.sales(spark, sf), path, "customer_id", "transaction_id")
    return files.scan_parquet(spark, path)


@query
def a5_text_lines(spark, sf):
    path = scratch_path(spark, "a5")
    files.write_text(inputs.table(spark, sf, "documents"), "text", path)
    return files.scan_text(spark, path)


@query
def a6_object_listing(spark, sf):
    path = scratch_path(spark, "a6")
    files.write_partitioned(inputs.table(spark, sf, "documents").drop("text"), path, "lang", "source")
    objects = files.list_objects(spark, path, "*.parquet").filter(F.col("length") > 0)
    return objects.select(
        F.regexp_extract("path", "/lang=([^/]*)/", 1).alias("lang"),
        F.regexp_extract("path", "/source=([^/]*)/", 1).alias("source"),
    ).distinct()


@query
def a7_catalog_table(spark, sf):
    path = scratch_path(spark, "a7")
    name = f"tallyhouse_orders_{path[-32:]}"
    tables.replace_table(inputs.table(spark, sf, "orders"), name, path)
    return tables.scan_table(spark, name)


@query
def a9_parquet_sink(spark, sf):
    path = scratch_path(spark, "a9")
    source, target = f"{path}/in", f"{path}/out"
    files.write_parquet(inputs.sales(spark, sf), f"{source}/{sales_plan.SALES}")
    files.write_parquet(inputs.customers(spark, sf), f"{source}/{sales_plan.CUSTOMERS}")
    sales_plan.run_sales_summary(spark, source, target)
    return _summary(files.scan_parquet(spark, f"{target}/final_summary"))


@query
def a10_partitioned_sink(spark, sf):
    path = scratch_path(spark, "a10")
    files.write_partitioned(inputs.sales(spark, sf), path, "region")
    return files.scan_parquet(spark, path).groupBy("region").agg(
        F.count(F.lit(1)).alias("n_rows"), F.round(F.sum("transaction_amount"), 2).alias("amount")
    )


@query
def a11_replace_table(spark, sf):
    path = scratch_path(spark, "a11")
    name = f"tallyhouse_summary_{path[-32:]}"
    trades = inputs.trades(spark, sf)
    tables.replace_table(outliers.daily_ticker_baselines(trades), name, path)
    tables.replace_table(outliers.daily_ticker_summary(trades), name, path)
    return tables.scan_table(spark, name).select("trade_date", "ticker", "total_volume", _r("vwap", 6))


@query
def a12_view(spark, sf):
    tables.replace_view(_scores(spark, sf), "tallyhouse_numeric_survey_scores")
    return spark.table("tallyhouse_numeric_survey_scores")


@query
def a14_typed_table(spark, sf):
    path = scratch_path(spark, "a14")
    schema = f"tallyhouse_{path[-32:]}"
    tables.create_schema(spark, schema, f"{path}/db")
    tables.create_table(spark, f"{schema}.trades", schemas.without_zone(schemas.TRADES), f"{path}/trades")
    inputs.trades(spark, sf).write.mode("append").insertInto(f"{schema}.trades")
    return tables.scan_table(spark, f"{schema}.trades")


@query
def a15_append_visible(spark, sf):
    first, later = _halves(spark, sf)
    table = VersionedTable.create(spark, scratch_path(spark, "a15"), first.schema)
    seen = []
    for step, batch in (("first", first), ("second", later.drop("cat_compliance"))):
        table.append(batch)
        facts = table.read().agg(F.count(F.lit(1)).alias("n_rows"), F.max("trade_timestamp").alias("latest"))
        seen.append(facts.select(F.lit(step).alias("after_append"), "n_rows", "latest"))
    return tables.union_by_position(*seen)


@query
def a8_literal_lookup(spark, sf):
    """Causes as literal rows, left-joined to the claims."""
    causes = [(code, area) for area, codes in labels.CAUSE_CODES.items() for code in codes]
    lookup = tables.literal_rows(spark, causes, "cause_code string, hazard_area string")
    joined = inputs.claims(spark, sf).join(broadcast_within(lookup), "cause_code", "left")
    return joined.groupBy("cause_code", "hazard_area").agg(F.count(F.lit(1)).alias("n_claims"))


@query
def a15_record_batch(spark, sf):
    """All trades as the first commit, then a batch of records (one without a side) and an empty one."""
    trades = inputs.trades(spark, sf).withColumn("cat_compliance", F.lit(None).cast(_compliance_type()))
    table = VersionedTable.create(spark, scratch_path(spark, "a15"), trades.schema)
    table.append(trades)
    record = {"trade_id": "batch-1", "ticker": "NVDA", "price": 150.25, "quantity": 10, "trade_side": "BUY"}
    record["cat_compliance"] = {**lakehouse.HFT, "session_id": SESSION_ID}
    bare = {"trade_id": "batch-2", "ticker": "NVDA", "price": 150.5, "quantity": 20}
    for batch in ([record, bare], []):
        if batch:
            table.append(tables.rows_from_dicts(spark, batch, table.read().schema))
    shown = table.read().select("trade_id", "ticker", "price", "quantity", "trade_side", "cat_compliance.reporter_id")
    return shown


@query
def a16_given_schema(spark, sf):
    """Name and type of the columns of the given tables."""
    shown = [
        files.schema_rows(spark.read.parquet(f"{sf}/{name}.parquet")).select(F.lit(name).alias("table_name"), "name", "type")
        for name in ("orders", "events", "customer")
    ]
    return tables.union_by_position(*shown)


@query
def k6_drop(spark, sf):
    """A table made from the orders, counted, and dropped: its rows, and the tables of its name before and after."""
    path = scratch_path(spark, "k6")
    name = f"tallyhouse_drop_{path[-32:]}"
    tables.replace_table(inputs.table(spark, sf, "orders"), name, f"{path}/orders")
    counted = tables.scan_table(spark, name).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = stage(counted)
    before = int(spark.catalog.tableExists(name))
    tables.drop_table(spark, name)
    after = int(spark.catalog.tableExists(name))
    return counted.select("o_orderstatus", "n_rows", F.lit(before).alias("listed"), F.lit(after).alias("listed_after"))


@query
def a16_schema(spark, sf):
    table, (before, _, after) = _life(spark, sf)
    shown = [
        files.schema_rows(table.read(snapshot)).select(F.lit(label).alias("snapshot"), "name", "type")
        for label, snapshot in (("first", before), ("last", after))
    ]
    return tables.union_by_position(*shown)


# --- projections and filters -----------------------------------------------------------------------------------


@query
def b1_customer_tier(spark, sf):
    return inputs.customers(spark, sf).withColumn("customer_tier", labels.customer_tier(F.col("state")))


def _assigned(spark, sf):
    return survey_plan.assign_policies(
        inputs.surveys(spark, sf), inputs.policies(spark, sf), prefix=inputs.PREFIX, separator="#"
    )


def _scores(spark, sf):
    return scoring.rating_scores(inputs.surveys(spark, sf), ["o_orderkey"])


@query
def b2_scores(spark, sf):
    return _scores(spark, sf)


@query
def b3_hazard_areas(spark, sf):
    claims = inputs.claims(spark, sf)
    return claims.groupBy("cause_code", labels.hazard_area(F.col("cause_code")).alias("hazard_area")).agg(
        F.count(F.lit(1)).alias("n_claims")
    )


def _compliant_trades(spark, sf):
    id_ = F.col("trade_id").cast("long")
    return inputs.trades(spark, sf).withColumn("cat_compliance", generate.compliance(id_, F.col("trade_timestamp")))


@query
def b4_struct_field(spark, sf):
    typed = features.struct_field(_compliant_trades(spark, sf), "cat_compliance.handling_instructions", "handling_type")
    return typed.select("trade_id", "handling_type")


@query
def b5_all_columns_plus(spark, sf):
    orders = inputs.table(spark, sf, "orders").alias("s")
    return orders.select("s.*", F.year("o_orderdate").cast("long").alias("order_year"))


@query
def b6_comparisons(spark, sf):
    claims = inputs.claims(spark, sf).withColumn("hazard_area", labels.hazard_area(F.col("cause_code")))
    kept = claims.filter(
        (F.col("accident_year") >= 2020) & (F.col("hazard_area") != "Other") & (F.col("cause_code") != "CUT_02")
    )
    return kept.groupBy("hazard_area", "accident_year").agg(F.count(F.lit(1)).alias("n_claims"))


@query
def b7_outliers(spark, sf):
    review = outliers.outside(outliers.trade_zscores(inputs.trades(spark, sf)), "price_z_score", 1.5)
    return review.select("trade_id", _r("price_z_score", 6))


@query
def b8_between_dates(spark, sf):
    surveys = inputs.surveys(spark, sf)
    low, high = F.lit("1996-01-01").cast("date"), F.lit("1997-01-01").cast("date")
    return surveys.filter(F.col("survey_date").between(low, high)).select("o_orderkey", "survey_date")


@query
def b9_safe_ratio(spark, sf):
    lines = inputs.table(spark, sf, "lineitem")
    return lines.select(
        "l_orderkey", "l_linenumber", F.round(ratio(F.col("l_tax"), F.col("l_discount")), 9).alias("tax_per_discount")
    )


@query
def b10_null_defaults(spark, sf):
    scores = _scores(spark, sf)
    return scores.select(
        "o_orderkey", F.coalesce("score_lifting", F.lit(scoring.UNASSESSED_SCORE)).alias("score_lifting")
    )


@query
def b11_text_preview(spark, sf):
    documents = inputs.table(spark, sf, "documents")
    return documents.select("doc_id", text.preview(F.col("text")).alias("text_preview"))


@query
def b12_deviation_flag(spark, sf):
    marked = survey_plan.account_benchmarks(inputs.accounts(spark, sf))
    return marked.select("record_id", "is_deviating")


# --- joins -----------------------------------------------------------------------------------------------------


@query
def c1_broadcast_join(spark, sf):
    joined = grouping.join_customers(inputs.sales(spark, sf), broadcast_within(inputs.customers(spark, sf)))
    return joined.select("transaction_id", "customer_id", "region", "state", "transaction_amount")


@query
def c2_join(spark, sf):
    joined = grouping.join_customers(inputs.sales(spark, sf), inputs.customers(spark, sf))
    return joined.select("transaction_id", "customer_id", "name", "timestamp")


@query
def c3_computed_key_left_join(spark, sf):
    assigned = survey_plan.assign_policies(
        inputs.surveys(spark, sf), inputs.policies(spark, sf), prefix=inputs.PREFIX, separator="#", how="left"
    )
    return assigned.select("o_orderkey", "survey_filename", "policy_id")


@query
def c4_timed_assignment(spark, sf):
    """Events, with their time of day, in short periods made from the customers."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 25).cast("int"))
    length = (F.col("c_custkey") % 4).cast("int")
    periods = inputs.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("user_id"), day.alias("start_day"), F.date_add(day, length).alias("end_day")
    )
    events = inputs.table(spark, sf, "events").select("event_id", "user_id", "ts")
    return match_periods(events, periods, on="user_id", date="ts", start="start_day", end="end_day", closed="left")


@query
def c4_stretched_assignment(spark, sf):
    """Events in long periods of their type, of which there are few: each type is cut at quantiles of its own times."""
    number = F.col("n_nationkey").cast("int")
    kind = F.when(number % 3 == 0, "click").when(number % 3 == 1, "view").otherwise("error")
    first = F.date_add(F.lit("2023-12-01").cast("date"), number * 3)
    periods = spark.read.parquet(f"{sf}/nation.parquet").select(
        kind.alias("event_type"), "n_nationkey", first.alias("start_day"), F.date_add(first, number * 9 % 200).alias("end_day")
    )
    events = inputs.table(spark, sf, "events").select("event_id", "event_type", "ts")
    matched = match_periods(
        events, periods, on="event_type", date="ts", start="start_day", end="end_day", hot_pairs=10_000, spread="stretches"
    )
    return matched.select("event_id", "n_nationkey")


@query
def c4_policy_assignment(spark, sf):
    return _assigned(spark, sf).select(
        "o_orderkey", *survey_plan.ASSIGNED, "survey_date", "effective_date", "expiration_date"
    )


@query
def c5_zscores(spark, sf):
    scored = outliers.trade_zscores(inputs.trades(spark, sf))
    return scored.select("trade_id", "trade_timestamp", "ticker", "price", "quantity", _r("price_z_score", 6))


@query
def c6_equipment_paths(spark, sf):
    net = inputs.network(spark, sf)
    found = match_path(
        [
            Node("i", net["inspectors"], "inspector_id", ["inspector_id"]),
            Node("p", net["policyholders"], "policyholder_id", ["policyholder_id"]),
            Node("m", net["machinery"], "machine_id", ["machine_id"], F.col("model_name") == inputs.MODEL),
        ],
        [Edge(net["inspects"], "inspector_id", "policyholder_id"), Edge(net["operates"], "policyholder_id", "machine_id")],
    )
    return found.toDF("inspector_id", "policyholder_id", "machine_id")


@query
def c7_weight_lookup(spark, sf):
    weights = scoring.segment_weights(scoring.losses_by_account(inputs.claims(spark, sf)))
    scores = scoring.composite_scores(_scores(spark, sf), weights, ["o_orderkey"], digits=6, normalise=True)
    return scores.withColumnRenamed("loss_weighted_composite_score", "mean_score")


@query
def c8_matched_by_rule(spark, sf):
    rules = lakehouse.compliance_rules(spark, inputs.RULE_TICKER, F.lit(SESSION_ID), _reported_at())
    target = inputs.trades(spark, sf).withColumn("cat_compliance", F.lit(None).cast(_compliance_type()))
    updated = conditional_update(
        target, rules, key="ticker", column="cat_compliance", default=lakehouse.legacy_record()
    )
    return updated.groupBy("ticker", F.col("cat_compliance.reporter_id").alias("reporter_id")).agg(
        F.count(F.lit(1)).alias("n_trades")
    )


@query
def c9_distance_to_corpus(spark, sf):
    found = nearest_for_each(
        inputs.table(spark, sf, "embeddings"),
        inputs.mean_vectors(spark, sf, "label"),
        2,
        key="vec_id",
        vector="embedding",
        query_key="label",
        query_vector="query",
    )
    return found.select("label", "vec_id", _r("distance", 6))


@query
def c10_tenant_read(spark, sf):
    documents = inputs.table(spark, sf, "documents").withColumnRenamed("source", "tenant")
    grants = inputs.grants(spark, sf)
    reads = [
        tenancy.readable_rows(documents, grants, p).select(F.lit(p).alias("principal"), "tenant", "doc_id", "text")
        for p in ("finance", "marketing")
    ]
    return tables.union_by_position(*reads)


# --- aggregations ----------------------------------------------------------------------------------------------


def _summary(summary):
    return summary.select(
        "region", "state", "customer_tier", _r("total_sales", 2), _r("average_sale_amount", 6), "distinct_customers"
    )


@query
def d1_tier_summary(spark, sf):
    return _summary(grouping.tier_summary(inputs.sales(spark, sf), inputs.customers(spark, sf)))


@query
def d2_losses(spark, sf):
    return scoring.losses_by_account(inputs.claims(spark, sf)).select(
        "account_id", "hazard_area", _r("total_hazard_loss", 2)
    )


@query
def d3_weights(spark, sf):
    weights = scoring.segment_weights(scoring.losses_by_account(inputs.claims(spark, sf)))
    return weights.select("hazard_area", _r("area_weight", 9))


@query
def d4_row_count(spark, sf):
    return grouping.row_count(inputs.table(spark, sf, "lineitem"))


@query
def d5_latest_time(spark, sf):
    return grouping.latest_value(inputs.trades(spark, sf), "trade_timestamp")


@query
def d6_distinct_count(spark, sf):
    return grouping.distinct_rows_count(inputs.trades(spark, sf), "ticker")


@query
def d7_table_status(spark, sf):
    return grouping.table_status(inputs.trades(spark, sf))


@query
def d8_daily_summary(spark, sf):
    summary = outliers.daily_ticker_summary(inputs.trades(spark, sf))
    return summary.select("trade_date", "ticker", "total_volume", _r("vwap", 6))


@query
def d9_baselines(spark, sf):
    baselines = outliers.daily_ticker_baselines(inputs.trades(spark, sf))
    return baselines.select("ticker", "trade_date", _r("avg_price", 6), _r("stddev_price", 6))


@query
def d10_composite(spark, sf):
    weights = scoring.segment_weights(scoring.losses_by_account(inputs.claims(spark, sf)))
    return scoring.composite_scores(_scores(spark, sf), weights, ["o_orderkey"], digits=6)


@query
def d11_side_counts(spark, sf):
    return grouping.side_counts(inputs.trades(spark, sf))


# --- windows ---------------------------------------------------------------------------------------------------


@query
def e1_market_average(spark, sf):
    ratios = benchmarks.cost_ratios(inputs.accounts(spark, sf))
    means = benchmarks.with_group_mean(ratios, "record_year", "individual_cost_ratio", "market_avg_cost_ratio")
    return means.select("record_id", _r("individual_cost_ratio", 9), _r("market_avg_cost_ratio", 9))


@query
def e2_share_of_total(spark, sf):
    lines = inputs.table(spark, sf, "lineitem")
    flags = lines.groupBy(F.col("l_returnflag").alias("hazard_area")).agg(
        F.sum("l_extendedprice").alias("total_hazard_loss")
    )
    return scoring.segment_weights(flags).select("hazard_area", _r("area_weight", 9))


@query
def e3_performance_index(spark, sf):
    index = benchmarks.performance_index(benchmarks.cost_ratios(inputs.accounts(spark, sf)))
    return index.select("record_id", "account_id", "record_year", _r("performance_index", 6))


# --- orderings -------------------------------------------------------------------------------------------------


@query
def f1_total_sort(spark, sf):
    return _summary(sales_plan.sales_summary(inputs.sales(spark, sf), inputs.customers(spark, sf)))


@query
def f2_latest_rows(spark, sf):
    return topk.latest_rows(inputs.trades(spark, sf), "trade_timestamp", "trade_id", 10)


@query
def f3_top_rows(spark, sf):
    return topk.largest_rows(inputs.sales(spark, sf), "transaction_amount", "transaction_id", 5)


@query
def f4_sample_rows(spark, sf):
    surveys = inputs.surveys(spark, sf).select("o_orderkey", "survey_filename", "rating_lifting")
    return topk.sample_rows(surveys, "o_orderkey", 5)


@query
def f5_nearest(spark, sf):
    found = nearest(
        inputs.table(spark, sf, "embeddings"), inputs.mean_vectors(spark, sf), 3, key="vec_id", vector="embedding"
    )
    return found.select("vec_id", _r("distance", 6))


@query
def f6_last_tickers(spark, sf):
    return topk.last_tickers(inputs.trades(spark, sf))


# --- set operations --------------------------------------------------------------------------------------------


@query
def g1_union_all(spark, sf):
    orders = inputs.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("amount"))
    lines = inputs.table(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice")
    return tables.union_by_position(orders, lines)


@query
def g2_union_evolved(spark, sf):
    both = tables.union_evolved(inputs.trades(spark, sf), _compliant_trades(spark, sf))
    return both.select("trade_id", "price", F.col("cat_compliance.order_event_type").alias("order_event_type"))


@query
def g3_distinct(spark, sf):
    return grouping.distinct_values(inputs.table(spark, sf, "orders"), "o_orderpriority")


# --- scalar functions ------------------------------------------------------------------------------------------


@query
def h_scalar_functions(spark, sf):
    orders = inputs.table(spark, sf, "orders")
    amount = F.col("o_totalprice")
    boxed = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    return orders.select(
        "o_orderkey",
        text.name_slug(F.col("o_orderpriority")).alias("slug"),
        F.substring("o_orderpriority", 3, 4).alias("part"),
        F.round(amount / 7, 2).alias("rounded"),
        F.abs(amount - 200000).alias("gap"),
        F.coalesce(ratio(amount, F.col("o_custkey")), F.lit(-1.0)).alias("per_customer_key"),
        F.to_date("o_orderdate").alias("day"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("stamp"),
        boxed["status"].alias("status"),
        F.element_at(F.array(F.lit("West"), F.lit("East")), (F.col("o_custkey") % 2 + 1).cast("int")).alias("side"),
        F.floor(amount / 1000).alias("thousands"),
        F.col("o_totalprice").between(1000, 100000).alias("is_small"),
        F.col("o_orderstatus").isin("F", "O").alias("is_known"),
    )


# --- streaming and generation ----------------------------------------------------------------------------------


@query
def i1_stream_ingest(spark, sf):
    path = scratch_path(spark, "i1")
    events = inputs.table(spark, sf, "events")
    events.repartition(6, "event_id").write.parquet(f"{path}/landing")
    table = VersionedTable.create(spark, f"{path}/events", events.schema)
    for _ in range(2):  # the second run finds nothing new
        ingest_into(table, f"{path}/landing", events.schema, f"{path}/checkpoint", files_per_batch=2)
    return table.read()


@query
def i1_judged_arrivals(spark, sf):
    """Baselines after a stream of files has been judged batch by batch, with a restart in between."""
    path, trades = scratch_path(spark, "arrivals"), inputs.trades(spark, sf)
    trades.repartition(4, "trade_id").write.parquet(f"{path}/landing")
    table = VersionedTable.create(spark, f"{path}/trades", trades.schema)
    scored = T.StructType([*trades.schema.fields, T.StructField("price_z_score", T.DoubleType())])
    found = VersionedTable.create(spark, f"{path}/outliers", scored)
    summary = arrivals.price_baselines(table, f"{path}/baselines")
    for folder in (f"{path}/landing/part-0000[01]*", f"{path}/landing/part-*"):
        arrivals.judge_arrivals(
            table, summary, found, folder, trades.schema, f"{path}/checkpoint", limit=1.5, files_per_batch=1
        )
    baselines = arrivals.baselines_of(summary)
    return baselines.select("ticker", "trade_date", _r("avg_price", 6), _r("stddev_price", 6))


@query
def i2_trades(spark, sf):
    ids = inputs.table(spark, sf, "events").select("event_id", F.to_date("ts").alias("day"))
    return generate.trades(ids, F.col("day"), "event_id").drop("trade_timestamp")


@query
def i3_market_hours(spark, sf):
    events = inputs.table(spark, sf, "events")
    return events.select("event_id", generate.market_time(F.to_date("ts"), F.col("event_id")).alias("trade_timestamp"))


@query
def i4_customers(spark, sf):
    return generate.customers(inputs.table(spark, sf, "customer"), "c_custkey")


def _generated_sales(spark, sf):
    ids = inputs.table(spark, sf, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"))
    return generate.sales(ids, inputs.table(spark, sf, "customer").agg(F.count(F.lit(1))).scalar())


@query
def i4_sales(spark, sf):
    return _generated_sales(spark, sf).withColumn("transaction_amount", F.round("transaction_amount", 6))


@query
def i4_generated_summary(spark, sf):
    customers = generate.customers(inputs.table(spark, sf, "customer"), "c_custkey")
    return _summary(sales_plan.sales_summary(_generated_sales(spark, sf), customers))


@query
def i5_compliance(spark, sf):
    return _compliant_trades(spark, sf).select("trade_id", "cat_compliance.*")


# --- features, vectors and texts -------------------------------------------------------------------------------


@query
def j1_string_index(spark, sf):
    indexed = features.index_labels(inputs.trades(spark, sf), "ticker", "ticker_index")
    return indexed.select("trade_id", "ticker", "ticker_index")


@query
def j1_many_labels(spark, sf):
    """A label for nearly every row: part names numbered by how often they are ordered."""
    names = inputs.table(spark, sf, "part").select("p_partkey", "p_name")
    ordered = inputs.table(spark, sf, "lineitem").join(names, F.col("l_partkey") == F.col("p_partkey"))
    label = F.concat_ws(" ", "p_name", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"))
    labelled = ordered.select("l_orderkey", "l_linenumber", label.alias("label"))
    return features.index_many_labels(labelled, "label", "label_index")


@query
def j2_vector_search(spark, sf):
    found = nearest(
        inputs.table(spark, sf, "embeddings"), inputs.mean_vectors(spark, sf), 2, key="vec_id", vector="embedding"
    )
    return found.select("vec_id", F.round("distance", 3).alias("cosine_distance"))


@query
def j2_indexed_search(spark, sf):
    """The nearest two of each label's mean, read from some clusters of an index."""
    index = DenseIndex.build(
        inputs.table(spark, sf, "embeddings"), scratch_path(spark, "index"), key="vec_id", vector="embedding"
    )
    found = index.search(inputs.mean_vectors(spark, sf, "label"), 2, query_key="label", query_vector="query").found
    return found.select("label", "vec_id", _r("distance", 6))


@query
def j3_embedding(spark, sf):
    documents = inputs.texts(spark, sf)
    _, vectors = embedding.embed_corpus(documents, "doc_id", "text", "vector")
    entries = vectors.select("doc_id", F.inline(F.arrays_zip("vector.bucket", "vector.weight")))
    return entries.filter(F.col("weight") > 0).select(
        "doc_id", F.col("bucket").cast("long").alias("bucket"), _r("weight", 9)
    )


@query
def j4_extraction(spark, sf):
    payload = T.StructType([T.StructField("k", T.LongType())])
    parsed = features.parse_payload(inputs.table(spark, sf, "events").select("event_id", "props"), "props", payload)
    return parsed.select("event_id", "k", "is_parsed")


@query
def j4_survey_ratings(spark, sf):
    """Ratings and date from JSON made of the orders' surveys, every ninth of it broken."""
    surveys = inputs.surveys(spark, sf)
    columns = [c for c in surveys.columns if c.startswith("rating_")]
    payload = F.to_json(F.struct(*columns, "survey_date"))
    broken = F.when(F.col("o_orderkey") % 9 == 0, F.expr("left(payload, length(payload) - 2)")).otherwise(F.col("payload"))
    outputs = surveys.select("o_orderkey", payload.alias("payload")).select("o_orderkey", broken.alias("payload"))
    return survey_plan.extract_ratings(outputs)


@query
def j5_verbatim_text(spark, sf):
    path = scratch_path(spark, "j5")
    files.write_parquet(inputs.table(spark, sf, "documents").select("doc_id", "text"), path)
    return files.scan_parquet(spark, path).select("doc_id", "text", F.length("text").cast("long").alias("n_chars"))


# --- table versions --------------------------------------------------------------------------------------------


def _reported_at():
    return F.lit(REPORTED_AT).cast("timestamp_ntz")


def _compliance_type():
    return schemas.without_zone(schemas.CAT_COMPLIANCE)


def _halves(spark, sf):
    early = F.col("trade_timestamp") < F.lit(SPLIT_TIME).cast("timestamp_ntz")
    return inputs.trades(spark, sf).filter(early), _compliant_trades(spark, sf).filter(~early)


def _life(spark, sf):
    first, later = _halves(spark, sf)
    rules = lakehouse.compliance_rules(spark, inputs.RULE_TICKER, F.lit(SESSION_ID), _reported_at())
    column = T.StructField("cat_compliance", _compliance_type())
    return lakehouse.table_life(spark, scratch_path(spark, "life"), first, column, rules, later)


def _flat(df):
    fields = [F.col(f"cat_compliance.{n}").alias(n) for n in _compliance_type().names]
    return df.select("trade_id", "ticker", "price", "quantity", *fields)


@query
def k1_history(spark, sf):
    table, _ = _life(spark, sf)
    return table.history().select(
        "operation", "row_count", F.col("parent_id").isNotNull().alias("has_parent"), "is_current_ancestor"
    )


@query
def k2_time_travel(spark, sf):
    table, (before, _, _) = _life(spark, sf)
    return table.read(before)


@query
def k2_latest_at_snapshot(spark, sf):
    table, (_, filled, _) = _life(spark, sf)
    return _flat(topk.latest_rows(table.read(filled), "trade_timestamp", "trade_id", 20))


@query
def k3_added_column(spark, sf):
    first, later = _halves(spark, sf)
    table = VersionedTable.create(spark, scratch_path(spark, "k3"), first.schema)
    table.append(first)
    table.add_columns([T.StructField("cat_compliance", _compliance_type())])
    table.append(later)
    return _flat(table.read())


@query
def k4_backfill(spark, sf):
    table, (_, filled, _) = _life(spark, sf)
    return _flat(table.read(filled))


@query
def k5_replace(spark, sf):
    trades = inputs.trades(spark, sf)
    table = VersionedTable.create(spark, scratch_path(spark, "k5"), trades.schema)
    old = table.append(trades)
    table.replace(outliers.daily_ticker_summary(trades))
    current = table.read().select(F.lit("new").alias("state"), F.col("ticker"), F.col("total_volume").alias("volume"))
    earlier = table.read(old).select(F.lit("old"), F.col("ticker"), F.col("quantity"))
    return current.union(earlier).groupBy("state", "ticker").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("volume").alias("volume")
    )


# --- reports ---------------------------------------------------------------------------------------------------


@query
def m1_sales_summary(spark, sf):
    return _summary(sales_plan.sales_summary(inputs.sales(spark, sf), inputs.customers(spark, sf)))


@query
def m2_sales_summary_sql(spark, sf):
    return _summary(sales_plan.sales_summary_sql(spark, inputs.sales(spark, sf), inputs.customers(spark, sf)))


@query
def m2_sales_summary_clustered(spark, sf):
    path = scratch_path(spark, "m2")
    files.write_clustered(inputs.sales(spark, sf), f"{path}/clustered/{sales_plan.SALES}", "customer_id", "transaction_id")
    files.write_clustered(inputs.customers(spark, sf), f"{path}/clustered/{sales_plan.CUSTOMERS}", "customer_id", "name")
    sales = files.scan_parquet(spark, f"{path}/clustered/{sales_plan.SALES}")
    customers = files.scan_parquet(spark, f"{path}/clustered/{sales_plan.CUSTOMERS}")
    return _summary(sales_plan.sales_summary_sql(spark, sales, customers))


@query
def m2_sales_summary_bucketed(spark, sf):
    path = scratch_path(spark, "m2")
    names = tuple(f"{kind}_{path.rpartition('-')[2]}" for kind in ("sales", "customers"))
    sales_plan.load_bucketed(inputs.sales(spark, sf), inputs.customers(spark, sf), names, path, buckets=8)
    return _summary(sales_plan.sales_summary_bucketed(spark, names))


@query
def m3_compliance_review(spark, sf):
    review = trade_plan.compliance_review(inputs.trades(spark, sf))
    return review.withColumn("price_z_score", F.round("price_z_score", 6))


@query
def m4_daily_ticker_summary(spark, sf):
    summary = outliers.daily_ticker_summary(inputs.trades(spark, sf))
    return summary.select("trade_date", "ticker", "total_volume", _r("vwap", 6)).orderBy("trade_date", "ticker")


@query
def m4_running_summary(spark, sf):
    """The daily summary, kept up from the commits of a trades table."""
    path, trades = scratch_path(spark, "running"), inputs.trades(spark, sf)
    table = VersionedTable.create(spark, f"{path}/trades", trades.schema)
    keys = {"trade_date": F.to_date("trade_timestamp"), "ticker": F.col("ticker")}
    measures = {"quantity": F.col("quantity"), "notional": F.col("price") * F.col("quantity")}
    summary = RunningSummary.create(table, f"{path}/summary", keys, measures)
    for k in range(3):
        table.append(trades.filter(F.pmod(F.xxhash64("trade_id"), F.lit(3)) == k))
        summary.update(table)
    return summary.read().select(
        "trade_date", "ticker", F.col("quantity_sum").alias("total_volume"), _r("notional_sum", 2).alias("total_value")
    )


@query
def d1_distinct_sketches(spark, sf):
    """Different orders and parts of each return flag, exactly and from sketches kept up from three commits."""
    path, lines = scratch_path(spark, "sketches"), inputs.table(spark, sf, "lineitem")
    table = VersionedTable.create(spark, f"{path}/lines", lines.schema)
    counted = {"orders": F.col("l_orderkey"), "parts": F.col("l_partkey")}
    summary = RunningSummary.create(table, f"{path}/summary", {"l_returnflag": F.col("l_returnflag")}, {}, counted)
    for k in range(3):
        table.append(lines.filter(F.pmod(F.xxhash64("l_orderkey", "l_linenumber"), F.lit(3)) == k))
        summary.update(table)
    exact = lines.groupBy("l_returnflag").agg(
        F.countDistinct("l_orderkey").alias("n_orders"), F.countDistinct("l_partkey").alias("n_parts")
    )
    close = [
        (F.abs(F.col(f"{d}_distinct") - F.col(f"n_{d}")) <= 0.02 * F.col(f"n_{d}")).alias(f"{d}_within_2_percent")
        for d in counted
    ]
    estimated = summary.read().withColumnRenamed("l_returnflag", "flag")
    both = exact.join(estimated, F.col("l_returnflag").eqNullSafe(F.col("flag")))
    return both.select("l_returnflag", "n_orders", "n_parts", *close)


@query
def j3_dense_embedding(spark, sf):
    """Dense vectors of all texts on 32 directions: their width, and that a projection is no longer than a unit vector."""
    _, vectors = fit_dense(inputs.texts(spark, sf), "doc_id", "text", 32)
    squares = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x * x)
    return vectors.select(
        "doc_id", F.when(F.col("vector").isNotNull(), F.size("vector")).alias("width"), (squares <= 1.00001).alias("no_longer")
    )


@query
def m5_table_life(spark, sf):
    table, _ = _life(spark, sf)
    return _flat(table.read())


@query
def m6_portfolio_scores(spark, sf):
    return survey_plan.portfolio_scores(_assigned(spark, sf), inputs.claims(spark, sf), digits=6)


@query
def m6_riskiest_surveys(spark, sf):
    return survey_plan.riskiest_surveys(survey_plan.portfolio_scores(_assigned(spark, sf), inputs.claims(spark, sf)))


@query
def m7_account_benchmarks(spark, sf):
    marked = survey_plan.account_benchmarks(inputs.accounts(spark, sf))
    return marked.select(
        "record_id",
        "account_id",
        "record_year",
        _r("individual_cost_ratio", 9),
        _r("market_avg_cost_ratio", 9),
        _r("performance_index", 6),
        "is_deviating",
    )


@query
def m7_costliest_accounts(spark, sf):
    return survey_plan.costliest_accounts(survey_plan.account_benchmarks(inputs.accounts(spark, sf)))


@query
def m8_text_search(spark, sf):
    documents = inputs.texts(spark, sf)
    found = survey_plan.search_texts(documents, QUESTION, 2, key="doc_id", text="text")
    return found.select("doc_id", "text", "cosine_distance")


@query
def m8_passage_search(spark, sf):
    found = survey_plan.search_texts_for_each(
        inputs.texts(spark, sf),
        inputs.table(spark, sf, "benchmark").withColumnRenamed("text", "passage"),
        key="doc_id",
        text="text",
        question_key="item_id",
        question="passage",
    )
    return found.select("item_id", "doc_id", _r("distance", 6))


@query
def m8_indexed_passages(spark, sf):
    """The two texts nearest to each passage, from posting lists."""
    index = TextIndex.build(inputs.texts(spark, sf), scratch_path(spark, "texts"), key="doc_id", text="text")
    found = index.search(inputs.table(spark, sf, "benchmark"), 2, query_key="item_id", text="text").found
    return found.select("item_id", "doc_id", _r("distance", 6))


@query
def m9_shared_equipment(spark, sf):
    return survey_plan.shared_equipment(**inputs.network(spark, sf), model_name=inputs.MODEL)


@query
def m10_handling_features(spark, sf):
    indexed = trade_plan.handling_features(_compliant_trades(spark, sf))
    return indexed.select("trade_id", "handling_type", "handling_index")

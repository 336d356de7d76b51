import statistics
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyhouse.operators import features, grouping, outliers, topk
from tallyhouse.plans import sales as sales_plan, trades as trade_plan
from tallyhouse.sources import generate, schemas

TRADES = "trade_id string, trade_timestamp timestamp_ntz, ticker string, price double, quantity long, trade_side string"


@pytest.fixture(scope="module")
def trades(spark):
    day = [datetime(2024, 1, 2, 10, m) for m in range(8)]
    prices = [10.0, 10.5, 9.5, 10.0, 10.2, 9.8, 30.0]
    rows = [(str(i), day[i], "AAA", p, 10 * i, "BUY" if i % 2 else "SELL") for i, p in enumerate(prices)]
    rows += [
        ("7", day[7], "BBB", 5.0, 1, "BUY"),
        ("8", datetime(2024, 1, 3, 23, 59, 59), "CCC", 5.0, 0, None),
        ("9", datetime(2024, 1, 4), "DDD", 5.0, 3, "SELL"),
        ("10", datetime(2024, 1, 4), "DDD", 5.0, 3, "SELL"),
        ("11", datetime(2024, 1, 4), None, 5.0, 3, "SELL"),
    ]
    return spark.createDataFrame(rows, TRADES)


def test_daily_summary(trades):
    got = {(r["trade_date"], r["ticker"]): (r["total_volume"], r["vwap"]) for r in outliers.daily_ticker_summary(trades).collect()}
    prices = [10.0, 10.5, 9.5, 10.0, 10.2, 9.8, 30.0]
    vwap = sum(p * 10 * i for i, p in enumerate(prices)) / 210
    assert got[(date(2024, 1, 2), "AAA")] == (210, pytest.approx(vwap))
    assert got[(date(2024, 1, 3), "CCC")] == (0, None)
    assert got[(date(2024, 1, 4), "DDD")] == (6, 5.0)


def test_zscores_keep_all_trades(trades):
    scored = outliers.trade_zscores(trades)
    assert scored.columns == [*trades.columns, "price_z_score"]
    got = {r["trade_id"]: r["price_z_score"] for r in scored.collect()}
    assert len(got) == 12
    prices = [10.0, 10.5, 9.5, 10.0, 10.2, 9.8, 30.0]
    mean, deviation = statistics.mean(prices), statistics.stdev(prices)
    for i, price in enumerate(prices):
        assert got[str(i)] == pytest.approx((price - mean) / deviation)
    assert [got[i] for i in ("7", "8", "9", "10", "11")] == [None] * 5
    assert [r["trade_id"] for r in trade_plan.compliance_review(trades).collect()] == ["6"]


def test_outlier_limit_is_strict(spark):
    df = spark.createDataFrame([(1.5,), (-1.5,), (1.6,), (-1.6,), (None,)], "z double")
    assert sorted(r["z"] for r in outliers.outside(df, "z", 1.5).collect()) == [-1.6, 1.6]


def test_status(spark, trades):
    status = {r["metric"]: r["value"] for r in grouping.table_status(trades).collect()}
    assert status == {"Total Trades": "12", "Active Tickers": "5", "Latest Trade": "2024-01-04 00:00:00"}
    empty = {r["metric"]: r["value"] for r in grouping.table_status(trades.limit(0)).collect()}
    assert empty == {"Total Trades": "0", "Active Tickers": "0", "Latest Trade": "N/A"}


def test_distinct_count_has_null(trades):
    assert grouping.distinct_rows_count(trades, "ticker").first()[0] == 5
    assert trades.agg(F.count_distinct("ticker")).first()[0] == 4


def test_side_counts_and_last_tickers(trades):
    assert tuple(grouping.side_counts(trades).first()) == (4, 8)
    timed = trades.filter(F.col("ticker").isNotNull())
    assert topk.last_tickers(timed, 3).first()[0] == "CCC, DDD, DDD"


def test_latest_breaks_ties_by_key(trades):
    plan = topk.latest_rows(trades, "trade_timestamp", "trade_id", 2)
    assert [r["trade_id"] for r in plan.collect()] == ["10", "11"]
    assert "TakeOrderedAndProject" in plan._jdf.queryExecution().executedPlan().toString()


def test_label_index(spark):
    df = spark.createDataFrame([("b",), ("a",), ("c",), ("c",)], "label string")
    got = {r["label"]: r["i"] for r in features.index_labels(df, "label", "i").collect()}
    assert got == {"c": 0.0, "a": 1.0, "b": 2.0}
    with pytest.raises(Exception, match="NULL value"):
        features.index_labels(df.union(spark.createDataFrame([(None,)], "label string")), "label", "i").collect()


def test_bad_payload_stays_as_null_row(spark):
    df = spark.createDataFrame([(1, '{"k": 3}'), (2, "{oops"), (3, None), (4, '{"k": null}'), (5, '{"k": "x"}')], "id int, p string")
    parsed = features.parse_payload(df, "p", spark.createDataFrame([], "k long").schema)
    assert [(r["id"], r["k"], r["is_parsed"]) for r in parsed.orderBy("id").collect()] == [
        (1, 3, True), (2, None, False), (3, None, False), (4, None, True), (5, None, False)
    ]


@pytest.fixture(scope="module")
def generated(spark):
    customers = generate.customers(spark.range(400))
    return generate.sales(spark.range(0, 4000, 1, 7), 400), customers


def test_all_sales_find_their_customer(generated):
    sales, customers = generated
    assert sales.join(customers, "customer_id", "left_anti").count() == 0
    assert customers.filter(F.col("name") == F.concat(F.col("customer_id"), F.lit("_name"))).count() == 400


def test_generated_rows_do_not_depend_on_partitioning(spark, generated):
    sales, _ = generated
    other = generate.sales(spark.range(4000).repartition(13, F.col("id") % 3), 400)
    assert sales.exceptAll(other).isEmpty() and other.exceptAll(sales).isEmpty()


def test_ids_above_31_bits_draw_other_rows(spark):
    low = generate.sales(spark.range(1000), 400).drop("transaction_id")
    for block in (2147483647, 2147483648, 3 * 2147483648, 10**15):
        high = generate.sales(spark.range(block, block + 1000), 400)
        assert high.agg(F.min("customer_id") >= 0, F.max("transaction_amount") < 500).first() == (True, True)
        assert low.intersect(high.drop("transaction_id")).count() <= 1


def test_zscores_through_a_shuffled_join(spark, trades):
    broadcast = sorted(map(str, outliers.trade_zscores(trades).collect()))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scored = outliers.trade_zscores(trades)
        assert "SortMergeJoin" in scored._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(str, scored.collect())) == broadcast
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_generated_values(generated):
    sales, customers = generated
    shares = {r["state"]: r["count"] / 400 for r in customers.groupBy("state").count().collect()}
    assert 0.85 < shares["CA"] < 0.97
    low, high, products, regions = sales.agg(
        F.min("transaction_amount"), F.max("transaction_amount"), F.count_distinct("product_id"), F.count_distinct("region")
    ).first()
    assert 10 <= low < high < 500 and products == 100 and regions == 4
    assert sales.groupBy("customer_id").agg(F.count_distinct("region").alias("n")).filter("n > 1").isEmpty()
    every = generate.customers(customers.select(F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"), "customer_id").select(
        (F.col("customer_id") * 100 + F.col("k")).alias("id")), skew=0.0)
    assert every.select("state").distinct().count() == 10


def test_market_hours(spark):
    days = ["2024-07-05", "2024-07-06", "2024-07-07", "2024-01-08"]
    ids = spark.createDataFrame([(d, i) for d in days for i in range(50)], "d string, i long")
    times = ids.select("d", generate.market_time(F.col("d").cast("date"), F.col("i")).alias("t"))
    spans = {r["d"]: (r["lo"], r["hi"]) for r in times.groupBy("d").agg(F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    for d in days[:3]:  # the weekend falls back to Friday; New York is four hours behind in July
        assert datetime(2024, 7, 5, 13, 30) <= spans[d][0] <= spans[d][1] <= datetime(2024, 7, 5, 20, 0)
    assert datetime(2024, 1, 8, 14, 30) <= spans[days[3]][0] <= spans[days[3]][1] <= datetime(2024, 1, 8, 21, 0)


def test_generated_trades(spark):
    trades = generate.trades(spark.range(3000), F.lit("2024-01-08").cast("date"))
    assert trades.columns == schemas.TRADES.names
    low, high, few, many = trades.agg(F.min("price"), F.max("price"), F.min("quantity"), F.max("quantity")).first()
    assert 150 <= low < high <= 3000 and 10 <= few < many <= 5000
    assert trades.select("ticker").distinct().count() == 60
    assert trades.select("trade_id").distinct().count() == 3000
    assert {r[0] for r in trades.select("executing_account").distinct().collect()} == {f"ACC-TRD-0{i}" for i in range(1, 6)}
    now = generate.trades(spark.range(3), at=F.current_timestamp())
    assert now.select("trade_timestamp").distinct().count() == 1
    with pytest.raises(ValueError):
        generate.trades(spark.range(3))
    with_record = trades.withColumn("cat_compliance", generate.compliance(F.xxhash64("trade_id"), F.col("trade_timestamp")))
    assert [f.name for f in with_record.schema["cat_compliance"].dataType] == schemas.CAT_COMPLIANCE.names
    codes = trade_plan.handling_features(with_record).select("handling_type", "handling_index").distinct().collect()
    assert sorted(r["handling_index"] for r in codes) == [0.0, 1.0, 2.0, 3.0, 4.0]


def test_summary_matches_its_sql_form(spark, generated):
    sales, customers = generated
    def rounded(df):
        return sorted(
            (r["region"], r["state"], r["customer_tier"], round(r["total_sales"], 4), round(r["average_sale_amount"], 6), r["distinct_customers"])
            for r in df.collect()
        )

    assert rounded(sales_plan.sales_summary(sales, customers)) == rounded(
        sales_plan.sales_summary_sql(spark, sales, customers)
    )


def test_summary_with_repeated_and_missing_customers(spark):
    customers = spark.createDataFrame(
        [(1, "CA"), (1, "CA"), (2, None), (3, "NY"), (None, "TX")], "customer_id long, state string"
    )
    sales = spark.createDataFrame(
        [(1, "W", 10.0), (1, "W", 20.0), (2, "W", 5.0), (2, "W", None), (9, "W", 7.0), (None, "W", 8.0), (3, None, 1.0)],
        "customer_id long, region string, transaction_amount double",
    )
    got = sorted(map(str, grouping.tier_summary(sales, customers).collect()))
    customers.createOrReplaceTempView("tier_customers")
    sales.createOrReplaceTempView("tier_sales")
    plain = spark.sql("""
        SELECT region, state, CASE WHEN state IN ('CA', 'NY') THEN 'Gold' ELSE 'Silver' END AS customer_tier,
               sum(transaction_amount) AS total_sales, avg(transaction_amount) AS average_sale_amount,
               count(DISTINCT customer_id) AS distinct_customers
        FROM tier_sales JOIN tier_customers USING (customer_id) GROUP BY 1, 2, 3""")
    assert got == sorted(map(str, plain.collect()))

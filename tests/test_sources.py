import glob
import uuid
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import jobs, session
from tallyhouse.operators import tenancy
from tallyhouse.operators.vector_search import nearest
from tallyhouse.plans import lakehouse, sales as sales_plan
from tallyhouse.sources import files, schemas, tables
from tallyhouse.sources.versions import CommitConflict, VersionedTable, conditional_update
from tallyhouse.streaming.ingest import ingest_files, ingest_into


@pytest.fixture
def path(spark):
    return session.scratch_path(spark, "test")


def test_partitioned_round_trip_prunes(spark, path):
    df = spark.range(1000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("region"))
    files.write_partitioned(df, path, "region")
    back = files.scan_parquet(spark, path)
    assert back.select(*df.columns).exceptAll(df).isEmpty() and back.count() == 1000
    plan = back.filter(F.col("region") == "hot")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(region" in plan


def test_a_hot_partition_value_gets_several_writers(spark, path):
    df = spark.range(300_000).select(F.xxhash64("id").alias("x"), F.when(F.col("id") % 3 > 0, "hot").otherwise("cold").alias("r"))
    plan = df.hint("rebalance", F.col("r"))._jdf.queryExecution().executedPlan().toString()
    assert "REBALANCE_PARTITIONS_BY_COL" in plan
    size = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "400KB")
    try:
        files.write_partitioned(df.repartition(16), path, "r")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", size)
    assert 1 < len(glob.glob(f"{path}/r=hot/*.parquet")) < 16
    assert files.scan_parquet(spark, path).count() == 300_000


def test_partitioned_write_replaces(spark, path):
    files.write_partitioned(spark.range(5).withColumn("region", F.lit("a")), path, "region")
    files.write_partitioned(spark.range(3).withColumn("region", F.lit("b")), path, "region")
    assert files.scan_parquet(spark, path).count() == 3


def test_clustered_layout_splits_a_hot_key(spark, path):
    df = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("k"))
    files.write_clustered(df, path, "k", "id", files=8)
    back = files.scan_parquet(spark, path).withColumn("file", F.input_file_name())
    assert back.count() == 9000
    assert back.filter("k = 7").select("file").distinct().count() > 1
    assert back.groupBy("file").count().agg(F.max("count")).first()[0] < 3000
    ranges = sorted(tuple(r)[1:] for r in back.groupBy("file").agg(F.min("k"), F.max("k")).collect())
    assert all(a[1] <= b[0] for a, b in zip(ranges, ranges[1:]))


def test_declared_schema_widens(spark, path):
    spark.range(3).select(F.col("id").cast("int").alias("product_id")).write.parquet(path)
    assert files.scan_parquet(spark, path, "product_id long, later string").collect()[0]["later"] is None


def test_text_round_trip_and_unreadable_path(spark, path):
    df = spark.createDataFrame([("one\ntwo",), ("",), ("drei\r",)], "t string")
    files.write_text(df, "t", path)
    assert sorted(r["value"] for r in files.scan_text(spark, path).collect()) == ["", "drei\r", "one", "two"]
    with pytest.raises(AnalysisException):
        files.scan_text(spark, path + "-missing")


def test_object_listing_reads_no_content(spark, path):
    spark.range(10).repartition(2).write.csv(f"{path}/a")
    listed = files.list_objects(spark, path, "*.csv")
    assert listed.columns == ["path", "modificationTime", "length"]
    assert listed.count() == len(glob.glob(f"{path}/a/*.csv"))
    assert files.list_objects(spark, path, "*.pdf").count() == 0
    assert "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>" in (
        listed._jdf.queryExecution().executedPlan().toString()
    )


def test_schema_rows_show_comments():
    comments = [f.metadata.get("comment") for f in schemas.TRADES.fields]
    assert all(comments)


def test_typed_table_life(spark, path):
    name = f"db_{uuid.uuid4().hex}"
    tables.create_schema(spark, name, f"{path}/db")
    tables.create_schema(spark, name)
    tables.create_table(spark, f"{name}.trades", schemas.TRADES, f"{path}/trades")
    described = files.schema_rows(tables.scan_table(spark, f"{name}.trades")).collect()
    assert [r["name"] for r in described] == schemas.TRADES.names
    assert described[0]["comment"] == "Identifier of the trade."
    row = ("1", datetime(2024, 1, 1), "A", 1.0, 2, "BUY", "ACC-TRD-01")
    spark.createDataFrame([row], schemas.TRADES).write.insertInto(f"{name}.trades")
    tables.add_columns(spark, f"{name}.trades", [T.StructField("cat_compliance", schemas.CAT_COMPLIANCE)])
    assert tables.scan_table(spark, f"{name}.trades").first()["cat_compliance"] is None
    tables.drop_table(spark, f"{name}.trades")
    tables.drop_schema(spark, name)
    assert not spark.catalog.databaseExists(name)


def test_replace_table_and_view(spark, path):
    name = f"t_{uuid.uuid4().hex}"
    tables.replace_table(spark.range(3), name, path)
    tables.replace_table(spark.range(5).withColumn("x", F.lit(1)), name, path)
    assert tables.scan_table(spark, name).columns == ["id", "x"]
    assert tables.scan_table(spark, name).count() == 5
    tables.replace_view(spark.range(2), "v_two")
    assert tables.scan_table(spark, "v_two").count() == 2
    tables.drop_table(spark, name)


def test_append_batch(spark, path):
    schema = schemas.TRADES_WITH_COMPLIANCE
    stamp = datetime(2024, 1, 1)
    full = {"trade_id": "O'Neil; --", "trade_timestamp": stamp, "ticker": "A", "price": 1.0, "quantity": 2,
            "cat_compliance": {"reporter_id": "r", "reported_timestamp": stamp}}
    assert tables.append_batch(spark, [], schema, path) == 0
    assert tables.append_batch(spark, [full, {"trade_id": "2", "trade_side": "BUY"}], schema, path) == 2
    back = {r["trade_id"]: r for r in files.scan_parquet(spark, path).collect()}
    assert back["O'Neil; --"]["cat_compliance"]["reporter_id"] == "r"
    assert back["O'Neil; --"]["cat_compliance"]["session_id"] is None
    assert back["2"]["ticker"] is None and back["2"]["trade_side"] is None  # not a column of the first record
    with pytest.raises(ValueError):
        tables.rows_from_dicts(spark, [{"nope": 1}], schema)


def test_unions(spark):
    a = spark.createDataFrame([(1, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "y")], "other int, w string")
    assert tables.union_by_position(a, b).columns == ["k", "v"]
    c = spark.createDataFrame([(3, (1, 2))], "k int, s struct<p:int,q:int>")
    d = spark.createDataFrame([(4, (1,))], "k int, s struct<p:int>")
    rows = {r["k"]: r for r in tables.union_evolved(a, c, d).collect()}
    assert rows[1]["s"] is None and rows[4]["s"]["q"] is None and rows[3]["v"] is None


def _rules(spark, *rows):
    record = F.struct(F.col("who").alias("reporter_id"))
    return spark.createDataFrame(list(rows), "ticker string, who string").select("ticker", record.alias("cat"))


def test_table_versions(spark, path):
    first = spark.createDataFrame([("NVDA", 1), ("AAPL", 2), (None, 3)], "ticker string, n int")
    column = T.StructField("cat_compliance", schemas.CAT_COMPLIANCE)
    later = spark.createDataFrame([("TSLA", 9)], "ticker string, n int")
    rules = lakehouse.compliance_rules(spark)
    table, (before, filled, after) = lakehouse.table_life(spark, path, first, column, rules, later)

    assert table.read(before).columns == ["ticker", "n"]
    assert sorted(r["n"] for r in table.read(before).collect()) == [1, 2, 3]
    record = {r["n"]: r["cat_compliance"] for r in table.read(filled).collect()}
    assert record[1]["reporter_id"] == "CAT_DESK_HFT" and record[1]["session_id"]
    assert record[2]["reporter_id"] == record[3]["reporter_id"] == "CAT_DESK_LEGACY"
    assert record[2]["session_id"] is None
    assert table.current_snapshot_id() == after
    assert sorted(map(str, table.read().collect())) == sorted(map(str, table.read(after).collect()))
    assert table.read().filter("n = 9").first()["cat_compliance"] is None

    history = table.history().collect()
    assert [h["operation"] for h in history] == ["append", "merge", "append"]
    assert [h["row_count"] for h in history] == [3, 3, 4]
    assert [h["parent_id"] for h in history] == [None, before, filled]
    with pytest.raises(ValueError):
        table.read("no such id")


def test_added_column_needs_no_rewrite(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    assert table.read().count() == 0
    table.append(spark.range(3))
    files_before = sorted(glob.glob(f"{path}/data/*/*.parquet"))
    table.add_columns([T.StructField("extra", schemas.CAT_COMPLIANCE)])
    assert sorted(glob.glob(f"{path}/data/*/*.parquet")) == files_before
    assert table.read().filter("extra is null").count() == 3
    with pytest.raises(ValueError):
        table.append(spark.range(2).withColumn("unknown", F.lit(1)))


def test_replace_keeps_old_snapshots_and_may_read_itself(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    old = table.append(spark.range(4))
    table.replace(table.read().withColumn("twice", F.col("id") * 2))
    assert table.read().agg(F.sum("twice")).first()[0] == 12
    assert table.read(old).columns == ["id"] and table.read(old).count() == 4


def test_rows_of_a_failed_commit_are_not_seen(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    table.append(spark.range(2))
    spark.range(50).write.parquet(f"{path}/data/{uuid.uuid4().hex}")  # written, never logged
    table.append(spark.range(1))
    assert table.read().count() == 3


def test_generated_rule_value_is_the_same_for_all_rows(spark):
    target = spark.range(200).select(F.lit("NVDA").alias("ticker"), F.lit(None).cast("string").alias("session"))
    rules = spark.range(1).select(F.lit("NVDA").alias("ticker"), F.expr("uuid()").alias("session"))
    updated = conditional_update(target.repartition(5), rules, key="ticker", column="session", default=F.lit("none"))
    assert updated.select("session").distinct().count() == 1


def test_rules_must_be_unique_and_null_matches_nothing(spark):
    target = spark.createDataFrame([("a", None), (None, None)], "ticker string, cat struct<reporter_id:string>")
    default = F.struct(F.lit("rest").alias("reporter_id"))
    with pytest.raises(ValueError):
        conditional_update(target, _rules(spark, ("a", "x"), ("a", "y")), key="ticker", column="cat", default=default)
    rules = _rules(spark, ("a", "x"), (None, "n"), (None, "m"))
    updated = conditional_update(target, rules, key="ticker", column="cat", default=default)
    assert sorted((r["ticker"] or "", r["cat"]["reporter_id"]) for r in updated.collect()) == [("", "rest"), ("a", "x")]


def test_stream_takes_each_file_once(spark, path):
    rows = spark.range(100).withColumn("v", F.rand(seed=1))
    rows.repartition(7).write.parquet(f"{path}/in")
    schema = spark.read.parquet(f"{path}/in").schema

    def take():
        return ingest_files(spark, f"{path}/in", schema, f"{path}/out", f"{path}/check", files_per_batch=3)

    first = take()
    assert len([p for p in first.recentProgress if p["numInputRows"] > 0]) == 3
    take()
    assert files.scan_parquet(spark, f"{path}/out").exceptAll(rows).isEmpty()
    assert files.scan_parquet(spark, f"{path}/out").count() == 100
    spark.range(100, 130).withColumn("v", F.lit(0.5)).write.mode("append").parquet(f"{path}/in")
    take()
    assert files.scan_parquet(spark, f"{path}/out").count() == 130


def test_tenant_files(spark, path):
    for tenant in ("finance", "marketing"):
        spark.createDataFrame([(f"{tenant} data",)], "v string").write.text(f"{path}/{tenant}")
    grants = spark.createDataFrame([("ann", "finance"), ("bob", "marketing")], "principal string, tenant string")
    assert tenancy.read_tenant_text(spark, path, grants, "ann", "finance").first()["value"] == "finance data"
    with pytest.raises(PermissionError):
        tenancy.read_tenant_text(spark, path, grants, "ann", "marketing")


def test_tenants(spark):
    data = spark.createDataFrame([("finance", "f"), ("marketing", "m"), (None, "x")], "tenant string, line string")
    grants = spark.createDataFrame(
        [("finance_user", "finance"), ("finance_user", "finance"), ("marketing_user", "marketing")],
        "principal string, tenant string",
    )
    for user, own, other in (("finance", "f", "marketing"), ("marketing", "m", "finance")):
        principal = f"{user}_user"
        assert [r["line"] for r in tenancy.readable_rows(data, grants, principal).collect()] == [own]
        tenancy.require_grant(grants, principal, user)
        with pytest.raises(PermissionError):
            tenancy.require_grant(grants, principal, other)


def test_broadcast_only_within_the_limit(spark):
    big = spark.range(1000).withColumn("s", F.lit("x" * 100))
    assert session.measured_bytes(big) >= 100_000

    def plan(limit):
        joined = spark.range(10).join(session.broadcast_within(big, limit), "id")
        return joined._jdf.queryExecution().executedPlan().toString()

    assert "BroadcastHashJoin" in plan(1_000_000)
    assert "SortMergeJoin" in plan(10_000)


def test_shared_folder_comes_from_the_session(spark):
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        assert session.shared_folder(spark) == session.qualified(spark, configured)
    assert session.scratch_path(spark, "a") != session.scratch_path(spark, "a")
    staged = session.stage(spark.range(3))
    assert session.shared_folder(spark) in staged.inputFiles()[0]


@pytest.mark.parametrize("form", ["{}", "{}/", "file:{}", "file:{}/", "file://{}"])
def test_any_form_of_the_shared_folder_works(spark, tmp_path, monkeypatch, form):
    folder = form.format(tmp_path / "a b")
    monkeypatch.setattr(session, "shared_folder", lambda s: session.qualified(s, folder))
    assert session.shared_folder(spark).removeprefix("file://") == f"{tmp_path}/a b"
    assert session.stage(spark.range(3)).count() == 3
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id long, v array<double>")
    found = nearest(vectors, vectors.filter("id = 2").select("v"), 1, key="id", vector="v")
    assert [r["id"] for r in found.collect()] == [2]
    table = VersionedTable.create(spark, session.scratch_path(spark, "t"), vectors.schema)
    table.append(vectors)
    assert table.read().count() == 2


def test_jobs(spark, path, capsys):
    jobs.main(["generate-sales", f"{path}/raw", "--customers", "50", "--transactions", "600", "--tasks", "3"])
    jobs.main(["load-clustered", f"{path}/raw", f"{path}/clustered"])
    summaries = []
    for layout in ("raw", "clustered"):
        jobs.main(["sales-summary", f"{path}/{layout}", f"{path}/{layout}-out"])
        summary = files.scan_parquet(spark, f"{path}/{layout}-out/final_summary")
        assert summary.agg(F.sum("distinct_customers")).first()[0] <= 50
        summaries.append(sorted((r["region"], r["state"], round(r["total_sales"], 6)) for r in summary.collect()))
    assert summaries[0] == summaries[1] and summaries[0]
    spark.createDataFrame([("a line of finance data",)], "v string").write.text(f"{path}/text")
    jobs.main(["show-text", f"{path}/text"])
    assert "a line of finance data" in capsys.readouterr().out
    with pytest.raises(AnalysisException):
        jobs.main(["show-text", f"{path}/missing"])


def test_of_two_writers_one_raises_and_no_rows_are_lost(spark, path):
    VersionedTable.create(spark, path, spark.range(0).schema)
    one, two = VersionedTable(spark, path), VersionedTable(spark, path)
    parent = two.entries()[-1]
    one.append(spark.range(3))
    folder, rows = two._write(spark.range(5))
    with pytest.raises(CommitConflict):
        two._publish("append", parent, folder, False, rows, spark.range(0).schema)
    two.append(spark.range(5))
    assert one.read().count() == 8 and one.history().count() == 2


def test_create_on_an_existing_table_raises(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    table.append(spark.range(2))
    with pytest.raises(CommitConflict):
        VersionedTable.create(spark, path, spark.range(0).schema)
    assert table.read().count() == 2


def test_a_versioned_table_is_read_by_name(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    table.expose("tallyhouse_current")
    table.append(spark.range(4))
    assert spark.table("tallyhouse_current").count() == 4


def test_ingested_batches_are_commits_and_repeats_add_nothing(spark, path):
    spark.range(50).repartition(5).write.parquet(f"{path}/in")
    table = VersionedTable.create(spark, f"{path}/t", spark.range(0).schema)
    for _ in range(2):
        ingest_into(table, f"{path}/in", spark.range(0).schema, f"{path}/check", files_per_batch=2)
    assert table.read().count() == 50 and table.history().count() == 3
    table.append(spark.range(9), batch=f"{path}/check#1")
    assert table.read().count() == 50


def test_a_typed_table_refuses_a_used_location(spark, path):
    spark.range(4).write.parquet(f"{path}/old")
    with pytest.raises(ValueError):
        tables.create_table(spark, "tallyhouse_used", spark.range(0).schema, f"{path}/old")


def test_scratch_lies_in_a_folder_of_the_application_and_can_be_cleared(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(session, "shared_folder", lambda _: str(tmp_path))
    path = session.scratch_path(spark, "x")
    assert path.startswith(f"{tmp_path}/tallyhouse-{spark.sparkContext.applicationId}/x-")
    spark.range(2).write.parquet(path)
    session.clear_scratch(spark)
    assert not glob.glob(f"{tmp_path}/*")


def test_clustered_copy_gives_the_same_summary(spark, path):
    sales_plan.generate_sales_dataset(spark, f"{path}/in", 50, 2000, tasks=2)
    sales_plan.load_clustered(spark, f"{path}/in", f"{path}/out")
    shown = []
    for place in ("in", "out"):
        tables_read = [files.scan_parquet(spark, f"{path}/{place}/{t}") for t in (sales_plan.SALES, sales_plan.CUSTOMERS)]
        rows = sales_plan.sales_summary_sql(spark, *tables_read).collect()
        shown.append(sorted((r["region"], r["state"], round(r["total_sales"], 4), r["distinct_customers"]) for r in rows))
    assert shown[0] == shown[1] and shown[0]

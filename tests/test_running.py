"""Overlays, compaction and expiry of versioned tables, and summaries that follow their commits."""

import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyhouse import session
from tallyhouse.operators import outliers, running
from tallyhouse.operators.running import RunningSummary
from tallyhouse.sources.versions import CommitConflict, VersionedTable
from tallyhouse.streaming import arrivals


@pytest.fixture
def path(spark):
    return session.scratch_path(spark, "test")


def _folder_bytes(spark, path):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_backfills_write_rules_and_change_no_snapshot(spark, path):
    sizes = []
    for n in (100, 50_000):
        table = VersionedTable.create(spark, f"{path}/{n}", spark.range(1).selectExpr("id", "id AS k", "'' AS c").schema)
        before = table.append(spark.range(n).selectExpr("id", "id % 7 AS k", "'old' AS c"))
        size = _folder_bytes(spark, f"{path}/{n}/data")
        rules = spark.createDataFrame([(3, "three"), (None, "never"), (99, "no row")], "k long, c string")
        table.backfill(rules, key="k", column="c", default=F.lit("rest"))
        sizes.append(_folder_bytes(spark, f"{path}/{n}/data") - size)
        after = table.append(spark.createDataFrame([(-1, 3, "late")], "id long, k long, c string"))
        counts = dict(_rows(table.read(after).groupBy("c").count()))
        assert counts == {"three": len(range(3, n, 7)), "rest": n - len(range(3, n, 7)), "late": 1}
        assert table.read(before).filter("c <> 'old'").isEmpty()
    assert sizes[1] <= sizes[0] + 10


def test_overlays_follow_each_other(spark, path):
    table = VersionedTable.create(spark, path, T.StructType.fromDDL("id long, a string, b string, at timestamp_ntz"))
    table.append(spark.range(4).selectExpr("id", "string(id % 2) AS a", "'-' AS b"))
    table.backfill(spark.createDataFrame([("0", "zero")], "a string, b string"), key="a", column="b", default=F.lit(None))
    table.append(spark.createDataFrame([(9, "0", "own")], "id long, a string, b string"))
    # looks at what the first has set; then the key of the first is set anew
    table.backfill(spark.createDataFrame([("zero", "A"), ("own", "B")], "b string, a string"), key="b", column="a", default=F.lit("C"))
    table.backfill(spark.createDataFrame([("A", "last")], "a string, b string"), key="a", column="b", default=F.lit("x"))
    when = F.lit("2024-02-03 04:05:06").cast("timestamp_ntz")
    table.backfill(spark.createDataFrame([], "id long, at timestamp_ntz"), key="id", column="at", default=when)
    expected = [(0, "A", "last"), (1, "C", "x"), (2, "A", "last"), (3, "C", "x"), (9, "B", "x")]
    assert _rows(table.read().select("id", "a", "b")) == expected
    assert {str(r["at"]) for r in table.read().collect()} == {"2024-02-03 04:05:06"}
    table.compact()
    assert _rows(table.read().select("id", "a", "b")) == expected
    table.backfill(spark.createDataFrame([(1, "one")], "id long, b string"), key="id", column="b", default=F.upper("a"))
    assert _rows(table.read().select("id", "b")) == [(0, "A"), (1, "one"), (2, "A"), (3, "C"), (9, "B")]


def test_compaction_keeps_rows_and_snapshots_until_they_expire(spark, path):
    table = VersionedTable.create(spark, path, spark.range(0).schema)
    ids = [table.append(spark.range(k, k + 1).coalesce(1)) for k in range(20)]
    assert table.compact(files=1) == 20 and table.compact() == 0
    assert len(table.read().inputFiles()) == 1 and table.current_snapshot_id() == ids[-1]
    assert [table.read(i).count() for i in (ids[0], ids[9], ids[-1])] == [1, 10, 20]
    assert [h["operation"] for h in table.history().collect()] == ["append"] * 20
    last = table.append(spark.range(100, 103))
    assert table.expire(keep=2) == 20 and table.expire(keep=2) == 0
    assert table.read(ids[-1]).count() == 20 and table.read(last).count() == table.read().count() == 23
    with pytest.raises(ValueError, match="expired"):
        table.read(ids[3])
    again = VersionedTable(spark, path)
    assert again.read().count() == 23 and again.history().count() == 21


def test_compaction_beside_another_writer(spark, path, monkeypatch):
    def table_and_race(name, other):
        table = VersionedTable.create(spark, f"{path}/{name}", spark.range(0).schema)
        table.append(spark.range(2))
        table.append(spark.range(2, 5))
        write = table._write

        def write_late(df):
            found = write(df)
            writer = threading.Thread(target=other, args=(VersionedTable(spark, table.path),))
            writer.start()
            writer.join()
            return found

        monkeypatch.setattr(table, "_write", write_late)
        return table

    table = table_and_race("a", lambda t: t.append(spark.range(5, 7)))
    assert table.compact() == 2 and _rows(VersionedTable(spark, table.path).read()) == [(k,) for k in range(7)]
    table = table_and_race("b", lambda t: t.replace(spark.range(1)))
    with pytest.raises(CommitConflict):
        table.compact()
    assert _rows(table.read()) == [(0,)]


def _parts():
    return {"k": F.col("k")}, {"x": F.col("x"), "y": F.col("x") * F.col("w")}


def _direct(df):
    both = df.select("k", "x", (F.col("x") * F.col("w")).alias("y")).groupBy("k")
    each = [f(m).alias(f"{m}{f.__name__}") for m in ("x", "y") for f in (F.count, F.sum, F.avg, F.stddev_samp)]
    return both.agg(*each)


def _close(got, expected):
    got, expected = _rows(got), _rows(expected)
    assert len(got) == len(expected)
    for a, b in zip(got, expected):
        assert len(a) == len(b)
        assert all(x == (pytest.approx(y, rel=1e-9) if isinstance(y, float) else y) for x, y in zip(a, b))


def test_a_summary_reads_each_commit_once(spark, path, monkeypatch):
    monkeypatch.setattr(running, "FOLD_AFTER", 3)
    source = VersionedTable.create(spark, f"{path}/t", T.StructType.fromDDL("k string, x double, w int"))
    summary = RunningSummary.create(source, f"{path}/s", *_parts())
    assert summary.update(source) == 0
    rows = spark.range(600).selectExpr(
        "IF(id % 11 = 0, NULL, string(id % 5)) AS k", "IF(id % 13 = 0, NULL, 1e5 + sin(id)) AS x", "int(id % 3) AS w"
    )
    for k in range(6):
        part = rows.filter(F.pmod(F.xxhash64("x", "w"), F.lit(6)) == k)
        source.append(part)
        assert summary.update(source) == part.count() and summary.update(source) == 0
        _close(summary.read(), _direct(source.read()))
    assert summary._commits() <= 4
    again = RunningSummary(spark, f"{path}/s", *_parts())
    source.compact()
    source.append(spark.createDataFrame([("0", 5.0, 1), ("new", 1.0, 2)], "k string, x double, w int"))
    assert again.update(source) == 2
    source.backfill(spark.createDataFrame([("0", 7)], "k string, w int"), key="k", column="w", default=F.lit(1))
    assert again.update(source) == 602
    _close(again.read(), _direct(source.read()))


def test_arrivals_are_judged_once(spark, path):
    rows = spark.range(400).selectExpr(
        "string(id) AS trade_id", "timestamp_ntz'2024-01-02 10:00:00' + make_interval(0,0,0,id % 2) AS trade_timestamp",
        "'T' || id % 3 AS ticker", "double(hash(id) % 100) AS price",
    )
    rows.repartition(4, "trade_id").write.parquet(f"{path}/in")
    trades = VersionedTable.create(spark, f"{path}/t", rows.schema)
    found = VersionedTable.create(spark, f"{path}/o", T.StructType([*rows.schema.fields, T.StructField("price_z_score", T.DoubleType())]))
    summary = arrivals.price_baselines(trades, f"{path}/b")
    for folder in (f"{path}/in/part-0000[0-1]*", f"{path}/in/part-*", f"{path}/in/part-*"):
        arrivals.judge_arrivals(trades, summary, found, folder, rows.schema, f"{path}/c", limit=1.2, files_per_batch=1)
    assert trades.read().exceptAll(rows).isEmpty() and trades.read().count() == 400
    _close(arrivals.baselines_of(summary), outliers.daily_ticker_baselines(rows))
    judged = [r["trade_id"] for r in found.read().collect()]
    assert len(judged) == len(set(judged)) > 20
    # the last batch met the baselines of all rows
    last = trades.added_since(trades.history().collect()[-2]["snapshot_id"])
    final = outliers.outside(outliers.trade_zscores(last, outliers.daily_ticker_baselines(rows)), "price_z_score", 1.2)
    assert {r["trade_id"] for r in final.collect()} == set(judged) & {r["trade_id"] for r in last.collect()}


def test_sketches_of_commits_are_united(spark, path, monkeypatch):
    monkeypatch.setattr(running, "FOLD_AFTER", 2)
    rows = spark.range(60_000).selectExpr("IF(id % 3 = 0, NULL, string(id % 2)) AS k", "id * 7 % 40000 AS v", "string(NULL) AS no")
    source = VersionedTable.create(spark, f"{path}/t", rows.schema)
    keys, counted = {"k": F.col("k")}, {"k": F.col("k"), "v": F.col("v"), "no": F.col("no")}
    summary = RunningSummary.create(source, f"{path}/s", keys, {"v": F.col("v")}, counted)
    assert summary.read().count() == 0
    for k in range(4):
        source.append(rows.filter(F.col("v") % 5 >= k))  # most values come several times
        summary.update(source)
    exact = {r["k"]: r["n"] for r in source.read().groupBy("k").agg(F.countDistinct("v").alias("n")).collect()}
    got = {r["k"]: r for r in summary.read().collect()}
    assert got.keys() == exact.keys() == {None, "0", "1"}
    for k, r in got.items():
        assert abs(r["v_distinct"] - exact[k]) <= 0.02 * exact[k]
        assert r["k_distinct"] == (k is not None) and r["no_distinct"] == 0

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

import literal_rows as rows
from tallyhouse.functions.labels import HAZARD_AREAS
from tallyhouse.operators import periods
from tallyhouse.operators.benchmarks import cost_ratios, performance_index, with_group_mean
from tallyhouse.operators.paths import Edge, Node, match_path
from tallyhouse.operators.periods import GRAINS, match_periods
from tallyhouse.operators.scoring import composite_scores, losses_by_account, rating_scores, segment_weights
from tallyhouse.plans import surveys as plan


@pytest.fixture(scope="module")
def surveys(spark):
    return spark.createDataFrame(rows.SURVEYS, rows.SURVEY_SCHEMA)


@pytest.fixture(scope="module")
def policies(spark):
    return spark.createDataFrame(rows.POLICIES, rows.POLICY_SCHEMA)


@pytest.fixture(scope="module")
def claims(spark):
    return spark.createDataFrame(rows.CLAIMS, rows.CLAIM_SCHEMA)


def _slug(path):
    return path.removeprefix(rows.PREFIX).removesuffix(".pdf")


@pytest.mark.parametrize("grain", [None, "day", "month", "year"])
def test_assignment_keeps_surveys_inside_their_period(surveys, policies, grain):
    assigned = plan.assign_policies(surveys, policies, prefix=rows.PREFIX, grain=grain)
    assert assigned.columns == [
        *surveys.columns, "policy_id", "account_id", "earned_premium", "effective_date", "expiration_date"
    ]
    got = {_slug(r["survey_filename"]): (r["policy_id"], r["earned_premium"]) for r in assigned.collect()}
    assert got == {k: v[:2] for k, v in rows.ASSIGNED.items()}


def test_ratings_from_stored_model_output(spark, surveys):
    payload = F.to_json(F.struct(*[c for c in surveys.columns if c != "survey_filename"]))
    outputs = surveys.select("survey_filename", payload.alias("payload"))
    bad = spark.createDataFrame([("bad", "no json"), ("none", None)], "survey_filename string, payload string")
    extracted = plan.extract_ratings(outputs.union(bad))
    assert sorted(map(str, extracted.filter("is_parsed").select(*surveys.columns).collect())) == sorted(
        map(str, surveys.collect())
    )
    broken = extracted.filter("not is_parsed").collect()
    assert {r["survey_filename"] for r in broken} == {"bad", "none"}
    assert all(r["rating_lifting"] is None and r["survey_date"] is None for r in broken)


def test_left_assignment_keeps_all_surveys(surveys, policies):
    assigned = plan.assign_policies(surveys, policies, prefix=rows.PREFIX, how="left")
    assert assigned.count() == 10
    assert assigned.filter(F.col("policy_id").isNull()).count() == 5


def test_period_ends_and_open_ended_periods(spark):
    periods = spark.createDataFrame(
        [
            ("a", "old", date(2025, 1, 1), date(2026, 1, 1)),
            ("a", "new", date(2026, 1, 1), date(9999, 12, 31)),
            ("a", "void", date(2026, 3, 1), date(2026, 2, 1)),
            (None, "none", date(2000, 1, 1), date(2030, 1, 1)),
        ],
        "k string, p string, s date, e date",
    )
    events = spark.createDataFrame(
        [(1, "a", date(2026, 1, 1)), (2, "a", date(2025, 6, 1)), (3, "b", date(2026, 1, 1)), (4, None, date(2026, 1, 1)),
         (5, "a", None), (6, "a", date(2027, 7, 7))],
        "id long, k string, d date",
    )

    def pairs(**options):
        matched = match_periods(events, periods, on="k", date="d", start="s", end="e", **options)
        return sorted((r["id"], r["p"] or "") for r in matched.collect())

    both = [(1, "new"), (1, "old"), (2, "old"), (6, "new")]
    assert pairs() == both
    assert pairs(grain="year") == both
    assert pairs(closed="left") == [(1, "new"), (2, "old"), (6, "new")]
    assert pairs(how="left") == sorted([*both, (3, ""), (4, ""), (5, "")])
    empty = match_periods(events.limit(0), periods, on="k", date="d", start="s", end="e")
    assert empty.count() == 0
    with pytest.raises(ValueError):
        pairs(how="outer")


@pytest.mark.parametrize("strategy", ["broadcast", "merge"])
def test_hot_account_matches_brute_force(spark, monkeypatch, strategy):
    monkeypatch.setattr("tallyhouse.operators.periods.build_side", lambda df, size: df.hint(strategy))
    events = spark.range(600).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("k"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 7 % 900).cast("int")).alias("d"),
    )
    periods = spark.range(120).select(
        F.col("id").alias("p"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), F.col("id") % 17)).alias("k"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 11 % 800).cast("int")).alias("s"),
        F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") * 11 % 800 + F.col("id") % 90).cast("int")).alias("e"),
    )
    got = sorted((r["id"], r["p"]) for r in match_periods(events, periods, on="k", date="d", start="s", end="e").collect())
    ps = periods.collect()
    assert got == sorted(
        (e["id"], p["p"]) for e in events.collect() for p in ps if e["k"] == p["k"] and p["s"] <= e["d"] <= p["e"]
    )


def test_grain_follows_the_length_of_the_periods(spark):
    events = spark.createDataFrame([("a", date(2010, 1, 1)), ("a", date(2029, 12, 31))], "k string, d date")

    def bucket_of(end):
        periods = spark.createDataFrame([("a", date(2020, 5, 17), end)], "k string, s date, e date")
        matched = match_periods(events, periods, on="k", date="d", start="s", end="e", hot_pairs=1)
        text = matched._jdf.queryExecution().optimizedPlan().toString()
        return next((g for g in ("DAY", "MONTH", "YEAR") if f"INTERVAL '1' {g}" in text), None)

    assert bucket_of(date(2020, 5, 20)) == "DAY"
    assert bucket_of(date(2021, 5, 17)) == "MONTH"
    assert bucket_of(date(2028, 1, 1)) == "YEAR"


def test_weights(claims):
    weights = {r["hazard_area"]: r["area_weight"] for r in segment_weights(losses_by_account(claims)).collect()}
    total = sum(rows.LOSSES.values())
    assert weights == pytest.approx({k: v / total for k, v in rows.LOSSES.items()})
    assert sum(weights.values()) == pytest.approx(1.0)


def test_losses_drop_old_years_and_other_causes(spark):
    claims = spark.createDataFrame(
        [("1", "A", "CUT_02", 10, 2019), ("2", "A", "UNKNOWN", 20, 2020), ("3", "A", None, 30, 2021)],
        rows.CLAIM_SCHEMA,
    )
    losses = losses_by_account(claims)
    assert [tuple(r) for r in losses.collect()] == [("A", "Other", 50)]
    assert segment_weights(losses).count() == 0


def test_composite(surveys, policies, claims):
    assigned = plan.assign_policies(surveys, policies, prefix=rows.PREFIX)
    scored = plan.portfolio_scores(assigned, claims)
    got = {_slug(r["survey_filename"]): r["loss_weighted_composite_score"] for r in scored.collect()}
    assert got == {k: v[2] for k, v in rows.ASSIGNED.items()}
    top = [_slug(r["survey_filename"]) for r in plan.riskiest_surveys(scored, 2).collect()]
    assert top == ["summit-foundry", "precision-castings"]


def test_composite_without_losses_and_normalised(spark):
    one = spark.createDataFrame([("x", *["Poor"] * 7, None)], "id string, " + ", ".join(
        f"rating_{c} string" for c in rows.RATING_COLUMNS))
    scores = rating_scores(one, ["id"])
    assert scores.first()["score_lifting"] == 40.0
    assert scores.first()["score_elevated_surfaces"] is None
    none = spark.createDataFrame([], "hazard_area string, area_weight double")
    assert composite_scores(scores, none, ["id"]).first()[1] == pytest.approx((7 * 40 + 2.5) / 8, abs=0.005)
    heavy = spark.createDataFrame([("Lifting", 1.0)], "hazard_area string, area_weight double")
    mean = composite_scores(scores, heavy, ["id"], digits=None, normalise=True).first()[1]
    assert mean == pytest.approx((40 + 0.125 * (6 * 40 + 2.5)) / (1 + 7 * 0.125))


def test_composite_does_not_shuffle_surveys(surveys, claims):
    weights = segment_weights(losses_by_account(claims))
    scores = composite_scores(rating_scores(surveys, ["survey_filename"]), weights, ["survey_filename"])
    plan_text = scores._jdf.queryExecution().executedPlan().toString()
    outside = plan_text.split("Subquery")[0]
    assert "Exchange" not in outside and "Join" not in outside
    assert len(HAZARD_AREAS) == 8


def test_performance_index(spark):
    accounts = spark.createDataFrame(rows.ACCOUNTS, rows.ACCOUNT_SCHEMA)
    marked = plan.account_benchmarks(accounts)
    got = {r["account_id"]: round(r["performance_index"], 2) for r in marked.collect()}
    assert got == rows.INDEX
    assert {r["account_id"] for r in marked.filter("is_deviating").collect()} == {"ACC_009", "ACC_003", "ACC_008", "ACC_007"}
    assert [r["account_id"] for r in plan.costliest_accounts(marked, 3).collect()] == ["ACC_009", "ACC_003", "ACC_008"]


def test_index_edges(spark):
    accounts = spark.createDataFrame(
        [("a", "1", 2019, 1, 1), ("a", "2", 2020, 0, 5), ("b", "3", 2020, 10, 5), ("c", "4", 2021, 10, 0)],
        rows.ACCOUNT_SCHEMA,
    )
    index = {r["record_id"]: r for r in performance_index(cost_ratios(accounts)).collect()}
    assert set(index) == {"2", "3", "4"}
    assert index["2"]["individual_cost_ratio"] is None and index["2"]["performance_index"] is None
    assert index["3"]["performance_index"] == 100.0
    assert index["4"]["performance_index"] is None  # the whole market has no cost


def test_group_mean_equals_window(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, None), (None, 7.0), (None, 9.0)], "g int, v double")
    got = sorted(map(str, with_group_mean(df, "g", "v", "m").collect()))
    df.createOrReplaceTempView("group_mean_rows")
    window = spark_rows(spark, "SELECT g, v, avg(v) OVER (PARTITION BY g) AS m FROM group_mean_rows")
    assert got == window


def spark_rows(spark, sql):
    return sorted(map(str, spark.sql(sql).collect()))


def test_shared_equipment(spark):
    paths = plan.shared_equipment(
        spark.createDataFrame(rows.POLICYHOLDERS, "policyholder_id string, company_name string"),
        spark.createDataFrame(rows.INSPECTORS, "inspector_id string, inspector_name string"),
        spark.createDataFrame(rows.MACHINERY, "machine_id string, model_name string"),
        spark.createDataFrame(rows.INSPECTS, "id string, inspector_id string, policyholder_id string, survey_date date"),
        spark.createDataFrame(rows.OPERATES, "id string, policyholder_id string, machine_id string, active_units long"),
        "HydroPress-9000",
    )
    assert sorted(tuple(r) for r in paths.collect()) == [
        ("ACC_001", "Apex Metalworks", "Sarah Jenkins", "HydroPress-9000"),
        ("ACC_007", "Vulcan Heavy Industries", "Sarah Jenkins", "HydroPress-9000"),
    ]


@pytest.mark.parametrize("filtered", ["none", "first", "last"])
def test_paths_are_a_bag_and_the_filter_may_be_at_either_end(spark, filtered):
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(5)], "id int, name string")
    links = spark.createDataFrame([(0, 1), (0, 1), (1, 2), (1, 3), (4, 9)], "s int, t int")
    first = F.col("id") == 0 if filtered == "first" else None
    last = F.col("id") == 2 if filtered == "last" else None
    found = match_path(
        [Node("a", nodes, "id", ["name"], first), Node("b", nodes, "id"), Node("c", nodes, "id", ["name"], last)],
        [Edge(links, "s", "t"), Edge(links, "s", "t")],
    )
    ends = [("n0", "n2")] * 2 + ([] if filtered == "last" else [("n0", "n3")] * 2)
    assert sorted(tuple(r) for r in found.collect()) == ends
    with pytest.raises(ValueError):
        match_path([Node("a", nodes, "id")], [Edge(links, "s", "t")])


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_every_grain_equals_brute_force(spark, kind, closed, how):
    base = datetime(2024, 1, 1)
    times = [base + timedelta(days=d % 70, hours=7 * d % 24) for d in range(90)]
    events = [(i, None if i == 5 else "ab"[i % 2], t) for i, t in enumerate(times)]
    spans = [(n, "ab"[n % 2], base + timedelta(days=3 * n), base + timedelta(days=3 * n + n % 40)) for n in range(22)]
    cut = (lambda t: datetime(t.year, t.month, t.day)) if kind == "date" else (lambda t: t)
    inside = (lambda t, e: t <= e) if closed == "both" else (lambda t, e: t < e)
    pairs = {(i, n) for i, k, t in events for n, q, s, e in spans if k == q and s <= cut(t) and inside(cut(t), e)}
    if how == "left":
        pairs |= {(i, None) for i, _, _ in events if i not in {a for a, _ in pairs}}
    left = spark.createDataFrame(events, "id long, k string, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
    right = spark.createDataFrame(spans, "n long, k string, s timestamp_ntz, e timestamp_ntz")
    for ends in ("date", kind):
        periods = right.withColumn("s", F.col("s").cast(ends)).withColumn("e", F.col("e").cast(ends))
        for options in ({}, {"hot_pairs": 1}, {"hot_pairs": 500}, *({"grain": g} for g in GRAINS)):
            got = match_periods(left, periods, on="k", date="at", start="s", end="e", how=how, closed=closed, **options)
            assert sorted(map(str, ((r["id"], r["n"]) for r in got.collect()))) == sorted(map(str, pairs)), options


@pytest.mark.parametrize("kind", ["date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_stretches_equal_brute_force(spark, kind, how):
    base = datetime(2024, 1, 1)
    # half the events of "a" are at one time, "n" has no times, and some periods end before they start
    times = [base + timedelta(days=40 if d % 4 == 0 else d % 70, hours=7 * d % 24) for d in range(300)]
    events = [(i, None if i == 5 else "ab"[i % 2], t) for i, t in enumerate(times)] + [(900, "n", None), (901, "a", None)]
    spans = [(n, "ab"[n % 2], base + timedelta(days=2 * n), base + timedelta(days=2 * n + n % 40 - 2)) for n in range(30)]
    spans += [(90, "n", base, base), (91, "a", None, base), (92, "b", base, None)]
    left = spark.createDataFrame(events, "id long, k string, at timestamp_ntz").withColumn("at", F.col("at").cast(kind))
    contracts = spark.createDataFrame(spans, "n long, k string, s timestamp_ntz, e timestamp_ntz")
    for closed in ("both", "left"):
        until = F.col("at") <= F.col("e") if closed == "both" else F.col("at") < F.col("e")
        plain = left.join(contracts.withColumnRenamed("k", "q"), (F.col("k") == F.col("q")) & (F.col("at") >= F.col("s")) & until, how)
        for hot_pairs in (1, 3000):
            got = match_periods(
                left, contracts, on="k", date="at", start="s", end="e", how=how, closed=closed, hot_pairs=hot_pairs, spread="stretches"
            )
            assert sorted(map(str, got.select("id", "n").collect())) == sorted(map(str, plain.select("id", "n").collect()))


def test_a_period_is_repeated_once_a_cut(spark):
    events = spark.range(20_000).selectExpr("'hot' AS k", "timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,0,0,id * 7919 % 1000000) AS at")
    starts = spark.range(300).selectExpr("'hot' AS k", "timestamp_ntz'2023-06-01' + make_interval(0,0,0,id) AS s")
    yearly = starts.selectExpr("k", "s", "s + make_interval(1) AS e")
    cuts = events.groupBy("k").agg(F.percentile_approx("at", [n / 64 for n in range(1, 64)]).alias("_cuts"))
    # all events lie in twelve days: calendar months would put them into one bucket
    placed = events.join(cuts, "k").groupBy(periods._stretch(F.col("_cuts"), F.col("at"))).count()
    assert placed.count() == 64 and placed.agg(F.max("count")).first()[0] < 2 * 20_000 / 64
    crossed = F.size(F.filter("_cuts", lambda c: (c > F.col("s")) & (c <= F.col("e"))))
    most = yearly.join(cuts, "k").agg(F.sum(crossed + 1)).first()[0]
    assert periods.stretched_periods(yearly, cuts, on="k", start="s", end="e").count() == most
    with pytest.raises(ValueError):
        match_periods(events, yearly, on="k", date="at", start="s", end="e", spread="odd")

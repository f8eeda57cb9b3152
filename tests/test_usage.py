"""Values of the usage operators on small fixtures."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F
from usagelake.functions import text as X
from usagelake.operators import attribution, burn, cost, cycles, filters, histogram, outputs, plans, reports
from usagelake.operators.dedup import dedup
from usagelake.sources import ingest

USAGE = ("provider string, session_id string, ts timestamp_ntz, project string, model string, message_id string, request_id string, input_tokens bigint, "
         "output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, account_uuid string, seq bigint")


def at(minutes, day=1):
    return dt.datetime(2024, 1, day) + dt.timedelta(minutes=minutes)


def usage(spark, rows):
    """Rows (minutes, model) or dicts of columns."""
    base = {"provider": "claude", "session_id": "s", "ts": at(0), "project": "p", "model": "m", "message_id": "", "request_id": "r", "input_tokens": 2, "output_tokens": 5,
            "cache_creation_input_tokens": 0, "cache_read_input_tokens": 0, "account_uuid": None}
    made = []
    for i, r in enumerate(rows):
        r = {"ts": at(r[0]), "model": r[1]} if isinstance(r, tuple) else r
        made.append(tuple({**base, "message_id": f"m{i}", **r, "seq": i}.values()))
    return spark.createDataFrame(made, USAGE)


@pytest.fixture(scope="module")
def prices(spark):
    return spark.sql("SELECT 'm' AS model, CAST(0.000001 AS DECIMAL(16,12)) AS i, CAST(0.000002 AS DECIMAL(16,12)) AS o, CAST(NULL AS DECIMAL(16,12)) AS cr, CAST(NULL AS DECIMAL(16,12)) AS cw")


def test_dedup(spark):
    same = {"message_id": "x", "request_id": "y"}
    rows = [same, {**same, "model": "later"}, {**same, "account_uuid": "a"}, {**same, "account_uuid": "b"}, {**same, "account_uuid": ""}, {"message_id": "z"}]
    got = dedup(usage(spark, rows)).collect()
    assert len(got) == 4 and "later" not in {r.model for r in got}
    assert dedup(usage(spark, [])).count() == 0
    assert dedup(usage(spark, [{"message_id": "", "request_id": ""}] * 3)).count() == 1


def burns(spark, rows, prices, gap=5):
    return {r.model: r for r in burn.burn(cost.price(usage(spark, rows), prices), gap).collect()}


def test_active_seconds_are_capped(spark, prices):
    # Gaps of 7, 7.5 and, over midnight, 8 minutes; two records at one time add nothing.
    rows = [(1425, "m"), (1425, "m"), (1432, "m"), (1439.5, "m"), (1447.5, "m")]
    assert burns(spark, rows, prices, 8)["m"].active_secs == 60 * 22 + 30
    assert burns(spark, rows, prices, 7)["m"].active_secs == 60 * 21
    # A cap beyond every gap gives the whole span, whatever the order of the rows and the days without records.
    far = [(4321, "m"), (1, "m"), (2881, "m")]
    assert burns(spark, far, prices, 1_000_000)["m"].active_secs == 4320 * 60


def test_active_seconds_of_many_sessions(spark, prices):
    """Against a plain walk: several sessions and models, times before 1970, caps from nothing to more than a day."""
    rng = random.Random(17)
    rows = [{"session_id": rng.choice("ab"), "model": rng.choice("mn"), "ts": dt.datetime(1969, 12, 30) + dt.timedelta(seconds=rng.choice([rng.randrange(400_000), rng.randrange(4_000)]), microseconds=rng.randrange(10**6))}
            for _ in range(400)]
    for gap in (0, 1, 61, 3000):
        got = burns(spark, rows, prices, gap)
        for name in ("m", "n", "ALL"):
            total = 0
            for session in "ab":
                times = sorted(int((r["ts"] - dt.datetime(1969, 1, 1)).total_seconds()) for r in rows if r["session_id"] == session and name in (r["model"], "ALL"))
                total += sum(min(b - a, 60 * gap) for a, b in zip(times, times[1:]))
            assert got[name].active_secs == total, (name, gap)


def test_a_session_of_all_records_is_spread(spark):
    """Two and a half days of a record each second: every task sorts an hour's seconds, each once."""
    n = 60 * 3600
    one = spark.range(0, 3 * n).select(F.lit("s").alias("session_id"), F.timestamp_seconds(F.lit(1_700_000_000 - 1_700_000_000 % 3600) + F.col("id") % n).alias("ts"))
    slices = burn._slices(one, ["session_id"], 300, F.count(F.lit(1)).alias("n"))
    got = slices.agg(F.count(F.lit(1)).alias("slices"), F.max("n").alias("records"), F.sum("gap").alias("gap")).first()
    assert (got.slices, got.records, got.gap) == (60, 3 * 3600, n - 1)
    plan = slices._jdf.queryExecution().executedPlan().toString()
    assert "session_id" in plan and plan.count("Window [") == 1 and "_slice" in plan.split("Window [")[1].split("\n")[0]


def test_burn_cases(spark, prices):
    one = burns(spark, [(3, "m")], prices)["m"]
    assert one.active_secs == 0 and one.tokens_per_min is None and one.cost_per_active_hour is None
    mixed = burns(spark, [(0, "m"), (0.5, "b"), (4, "m"), (4.25, "m"), (4.75, "b")], prices)
    assert [mixed[k].active_secs for k in ("m", "b", "ALL")] == [255, 255, 285]
    days = burns(spark, [(10, "m"), (20, "m"), (2900, "m"), (4400, "m")], prices)["m"]
    assert (days.calendar_days, days.active_secs, days.tokens) == (3, 900, 28)
    free = burns(spark, [(0, "x"), (0.75, "x"), (1.5, "x")], prices)["x"]
    assert free.cost is None and free.tokens == 21 and free.active_secs == 90 and free.tokens_per_min == 14.0


def test_unpriced_models(spark, prices):
    rows = [(0, "m"), (1, "m-2"), (2, "M"), (3, ""), (4, "m-2")]
    assert [r.model for r in cost.unpriced_models(usage(spark, rows), prices).collect()] == ["", "M", "m-2"]
    assert cost.unpriced_models(usage(spark, [(0, "m")]), prices).count() == 0


def test_costs_of_very_many_tokens(spark, prices):
    row = cost.price(usage(spark, [{"input_tokens": 2_000_000_000_000, "output_tokens": 9_223_372_036_854_775_807}]), prices).first()
    assert float(row.cost) == pytest.approx(2e6 + 9_223_372_036_854_775_807 * 2e-6)


def test_cycle_costs_within_hours(spark, prices):
    # Records on, before and after the edges of two overlapping spans, one within an hour.
    rows = [{"ts": at(m), "message_id": f"k{m}"} for m in (0, 10, 59.9, 60, 61, 150, 179, 180, 181)]
    spans = spark.createDataFrame([("a", 0, at(10), at(180)), ("b", 0, at(60), at(61)), ("c", 0, at(500), at(900))], "org_uuid string, number int, start timestamp_ntz, end timestamp_ntz")
    priced = cost.price(usage(spark, rows), prices)
    got = {r.org_uuid: round(r.cost / 0.000012) for r in cycles.cycle_costs(priced, spans).collect()}
    assert got == {"a": 6, "b": 1, "c": 0}


def test_cost_rules_and_total(spark, prices):
    priced = cost.price(usage(spark, [(0, "m"), (1, "x")]), prices)
    row = priced.agg(*[cost.cost_sum(r).alias(r) for r in ("ignore", "poison", "zero")]).first()
    assert (row["ignore"], row["poison"], row["zero"]) == (0.000012, None, 0.000012)
    assert priced.filter("false").agg(cost.cost_sum("zero").alias("z"), cost.cost_sum("ignore").alias("i")).first() == (0.0, None)
    out = [(r.bucket, r.input_tokens) for r in reports.with_total(priced).collect()]
    assert out == [("2024-01-01", 4), ("TOTAL", 4)]
    assert reports.totals(priced.filter("false"), "all").count() == 0


def test_threshold_classes(spark):
    one = spark.range(1)
    cls = lambda c, w, k: one.select(X.threshold_class(F.lit(c), w, k).alias("c")).first().c
    assert [cls(2.49, 2.5, 40), cls(2.5, 2.5, 40), cls(39.9, 2.5, 40), cls(40.0, 2.5, 40), cls(1e6, None, None), cls(41.0, 2.5, None), cls(39.0, None, 40), cls(40.5, None, 40)] == [
        "normal", "warning", "warning", "critical", "normal", "warning", "normal", "critical"]


def test_status_without_usage(spark, prices):
    row = outputs.status_row(cost.price(usage(spark, []), prices), "{models} for {cost}").first()
    assert (row.text, row.tooltip, row["class"], row.currency) == ("$0.00", "No usage", "normal", "USD")


def test_status_and_table_of_unpriced_usage(spark, prices):
    free = cost.price(usage(spark, [{"model": "claude-none-1-20250101"}]), prices)
    row = outputs.status_row(free, "{cost} {models}", warn=0.0, label="Week").first()
    assert (row.text, row.tooltip, row["class"]) == ("$0.00 none-1", "Week: $0.00\n  none-1: N/A", "warning")
    rows = outputs.table_rows(free, "all", ["period", "cost", "models", "what"], details=True).collect()
    assert [tuple(r) for r in rows] == [("bar", "N/A", "none-1", ""), ("  claude-none-1-20250101", "N/A", "", ""), ("TOTAL", "N/A", "", "")]


def test_pace_at_the_edges_of_a_cycle(spark):
    rows = [("start", 3.0, "2024-05-01 00:00:00", "2024-05-08 00:00:00"), ("end", 40.0, "2024-04-24 00:00:00", "2024-05-01 00:00:00"), ("idle", 0.0, "2024-05-01 00:00:00", "2024-05-08 00:00:00"),
            ("half", 24.5, "2024-04-24 00:00:00", "2024-05-01 00:00:00"), ("full", 100.0, "2024-04-28 00:00:00", "2024-05-05 00:00:00"), ("fast", 60.0, "2024-04-29 00:00:00", "2024-05-06 00:00:00")]
    df = spark.createDataFrame(rows, "org_uuid string, pct double, start string, end string").selectExpr("org_uuid", "pct", "cast(start as timestamp_ntz) start", "cast(end as timestamp_ntz) end")
    got = {r.org_uuid: (r.projected, r.status) for r in cycles.pace(df, "2024-05-01 00:00:00").collect()}
    assert got == {"start": (200.0, "hits 100% in 0m"), "end": (40.0, "~40% at reset, 0m left"), "idle": (None, None), "half": (24.5, "~24% at reset, 0m left"),
                   "full": (200.0, "at capacity"), "fast": (200.0, "hits 100% in 1d 8h")}


def test_recommend(spark):
    # Each bound is touched from both sides: two full cycles, an average of 85, a peak that is 85 on the lower plan.
    cases = {"two full": ("pro", [95, 95, 1]), "one full": ("pro", [95, 94.9, 1]), "average": ("max5x", [85, 84, 86]), "below": ("max5x", [84.9, 85]), "top": ("max20x", [99, 99, 99]),
             "down": ("max5x", [17, 3]), "not down": ("max5x", [17.1, 3]), "down a lot": ("max20x", [21.25, 0]), "nothing known": ("max20x", [None])}
    df = spark.createDataFrame([(k, p, None if v is None else float(v)) for k, (p, vs) in cases.items() for v in vs], "org_uuid string, plan string, pct double")
    got = {r.org_uuid: (r.action, r.target) for r in plans.recommend(df).collect()}
    stay = ("stay", None)
    assert got == {"two full": ("upgrade", "max5x"), "one full": stay, "average": ("upgrade", "max20x"), "below": stay, "top": stay, "down": ("downgrade", "pro"), "not down": stay,
                   "down a lot": ("downgrade", "max5x"), "nothing known": stay}


def test_snapshots_keep_plan_changes(spark):
    cut = dt.datetime(2024, 1, 15, 10)
    rows = [("o", cut, 31.0, at(0), 1.0, "max5x"), ("o", cut + dt.timedelta(seconds=44), 17.0, at(5), 1.0, "max20x"), ("o", cut, 20.0, at(9), 1.0, "max20x")]
    df = spark.createDataFrame(rows, "org_uuid string, cycle_end timestamp_ntz, utilization double, captured_at timestamp_ntz, cost_at_calibration double, plan string")
    assert sorted((r.plan, r.utilization) for r in cycles.compact_snapshots(df).collect()) == [("max20x", 20.0), ("max5x", 31.0)]
    assert [r.utilization for r in cycles.latest_snapshots(df).collect()] == [20.0]
    now = cycles.current_cycle(df, "2024-01-15 10:00:44").first()
    assert now.end == dt.datetime(2024, 1, 22, 10, 0, 44)


def test_filters(spark):
    u = usage(spark, [{"project": "My%App", "ts": at(0, 3)}, {"project": "other", "ts": at(1439, 4)}, {"provider": "kimi", "ts": at(0, 5)}])
    assert filters.by_project(u, "y%a").count() == 1 and filters.by_project(u, "_").count() == 0
    assert filters.by_tool(u, "KIMI").count() == 1 and filters.by_tool(u, "none").count() == 0
    assert filters.in_range(u, "2024-01-03", "2024-01-04").count() == 2
    day = dt.date(2024, 3, 15)
    assert filters.resolve_range(None, None, day) is None and filters.resolve_range(None, day, day)[0] == dt.date(2020, 1, 1) and filters.resolve_range(day, None, day)[1] == day
    assert filters.named_range("month", day)[0] == dt.date(2024, 3, 1) and filters.named_range("1m", day)[0] == dt.date(2024, 2, 14)


def test_as_of_ties_and_both_joins(spark):
    log = spark.createDataFrame([(at(10), "a", "x", 1), (at(20), "b", "y", 2), (at(20), "c", "z", 3), (at(30, 2), "d", "w", 4)], "at_ts timestamp_ntz, org string, nm string, pos int")
    u = usage(spark, [(5, "m"), (10, "m"), (20, "m"), (25, "m"), (1440, "m"), (1440 * 3, "m")])
    want = [(0, None), (1, "a"), (2, "c"), (3, "c"), (4, "c"), (5, "d")]
    for broadcast in (None, True, False):
        assert sorted((r.seq, r.log_org) for r in attribution.account_name_at(u, log, broadcast).collect()) == want
    assert {r.log_org for r in attribution.account_name_at(u, log.limit(0)).collect()} == {None}


def test_as_of_against_a_plain_search(spark):
    """Logs with gaps of years, crowded hours and entries at one time; records from long before to long after."""
    rng = random.Random(23)
    base = dt.datetime(1965, 3, 1)
    moments = [base + dt.timedelta(days=rng.choice([0, 1, 2, 40, 9000]), seconds=rng.choice([rng.randrange(86_400), 3600 * rng.randrange(24), 7200 + rng.randrange(60)])) for _ in range(80)]
    entries = [(m, f"o{i}", f"n{i}", i) for i, m in enumerate(moments)]
    log = spark.createDataFrame(entries, "at_ts timestamp_ntz, org string, nm string, pos int")
    times = [rng.choice(moments) + dt.timedelta(microseconds=rng.choice([-1, 0, 1, 10**9, -(10**9)])) for _ in range(300)]
    times += [dt.datetime(1900, 1, 1), dt.datetime(2262, 1, 1), base + dt.timedelta(days=300)]
    got = {r.seq: (r.log_org, r.log_name) for r in attribution.account_name_at(usage(spark, [{"ts": t} for t in times]), log).collect()}
    for i, t in enumerate(times):
        best = max((e for e in entries if e[0] <= t), key=lambda e: (e[0], e[3]), default=(None,) * 4)
        assert got[i] == best[1:3], t


def test_the_as_of_join_runs_nothing_before_it_is_run(spark):
    log = spark.createDataFrame([(at(10), "a", "x", 1)], "at_ts timestamp_ntz, org string, nm string, pos int")
    u = usage(spark, [(5, "m")])
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("as-of", "")
    plan = attribution.account_name_at(u, log)._jdf.queryExecution().executedPlan().toString()
    spark.sparkContext.setJobGroup("", "")
    assert not list(tracker.getJobIdsForGroup("as-of")) and "Window" not in plan and "NestedLoop" not in plan


def test_owners_of_records(spark):
    accounts = spark.createDataFrame([("zeta", "o1", 0), ("alpha", "o1", 1), ("beta", "o2", 2)], "name string, org_uuid string, position int")
    log = spark.createDataFrame([(at(10), "o9", "beta", 1), (at(20), "o1", "gone", 2)], "at_ts timestamp_ntz, org string, nm string, pos int")
    u = usage(spark, [{"account_uuid": "o1"}, {"account_uuid": "other"}, {"ts": at(5)}, {"ts": at(15)}, {"ts": at(25)}])
    assert [r.org_uuid for r in attribution.with_owner(u, accounts, log).orderBy("seq").collect()] == ["o1", None, None, "o2", None]
    assert attribution.with_account_name(u, accounts).orderBy("seq").first().account_name == "zeta"


def test_own_costs_of_cycles(spark, prices):
    end = dt.datetime(2024, 1, 20, 10, 30)
    week = dt.timedelta(days=7)
    times = [end, end - dt.timedelta(microseconds=1), end - week, end - week - dt.timedelta(microseconds=1), end - 2 * week, end - 2 * week - dt.timedelta(microseconds=1)]
    u = usage(spark, [{"ts": t, "account_uuid": "a"} for t in times] + [{"ts": times[1], "account_uuid": "b"}]).withColumn("org_uuid", F.col("account_uuid"))
    resets = spark.createDataFrame([("a", end), ("b", end + dt.timedelta(hours=1)), ("c", end)], "org_uuid string, resets_at timestamp_ntz")
    got = {(r.org_uuid, r.number): round(r.cost / 0.000012) for r in cycles.own_cycle_costs(cost.price(u, prices), resets, 2).collect()}
    assert got == {("a", 0): 2, ("a", 1): 2, ("b", 0): 1, ("b", 1): 0, ("c", 0): 0, ("c", 1): 0}


def test_a_range_reads_its_days_only(spark, tmp_path):
    u = usage(spark, [{"ts": at(100, d), "provider": p} for d in range(1, 10) for p in ("pi", "amp")])
    ingest.write_usage(u, str(tmp_path / "table"))
    table = spark.read.parquet(str(tmp_path / "table"))
    some = filters.in_range(table, "2024-01-03", dt.date(2024, 1, 4))
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(usage_date" in plan and some.count() == 4
    scan = some._jdf.queryExecution().executedPlan().collectLeaves().head()
    scan.executeColumnar().count()
    assert scan.metrics().get("numFiles").get().value() == 4
    assert filters.in_range(table, None, "2024-01-01").count() == 2 and filters.in_range(table, "2024-01-09", None).count() == 2


def test_lists_of_reports(spark, prices):
    rows = [{"project": p, "provider": t, "model": m, "input_tokens": n} for p, t, m, n in (("b", "pi", "m", 1), ("a", "pi", "x", 1), ("a", "amp", "m", 1), (None, "amp", "y", 5))]
    got = reports.report(cost.price(usage(spark, rows), prices), "all").first()
    assert (got.models, got.projects, got.tools, got.input_tokens) == (["m", "x", "y"], ["a", "b"], ["amp", "pi"], 8) and got.cost == pytest.approx(2 * 11e-6)


def test_plans_that_credentials_claim(spark, prices):
    accounts = spark.createDataFrame([("one", "o1", "pro", None), ("two", "o2", "pro", None), ("three", "o3", "max", "x_5x")], "name string, org_uuid string, subscription_type string, rate_limit_tier string")
    live = spark.createDataFrame([("o1", "expired", "max", "a_20x"), ("o2", "fresh", None, None), ("o3", None, "max", "a_20x")], "org_uuid string, token string, claim_type string, claim_tier string")
    live = live.select("org_uuid", F.lit(1.0).alias("live_pct"), F.lit(None).cast("double").alias("five_hour_pct"), F.lit(None).cast("string").alias("plan"), F.lit(None).cast("timestamp_ntz").alias("resets_at"),
                       "token", "claim_type", "claim_tier")
    snaps = spark.createDataFrame([], "org_uuid string, cycle_end timestamp_ntz, utilization double, captured_at timestamp_ntz, cost_at_calibration double, plan string")
    log = spark.createDataFrame([], "at_ts timestamp_ntz, org string, nm string, pos int")
    rows = cycles.account_overview(cost.price(usage(spark, []), prices), accounts, log, snaps, "2024-01-15 00:00:00", live)
    assert {r.name: r.plan for r in rows.collect()} == {"one": "Claude Max (20x)", "two": "unknown", "three": "Claude Max (5x)"}


def test_histogram_edges(spark):
    now = dt.datetime(2024, 1, 30, 12, 15)
    assert [len(histogram.buckets(p, now)) for p in ("1d", "1w", "1m")] == [48, 28, 29]
    assert len(histogram.buckets("1m", now, include_partial=True)) == 30
    u = usage(spark, [{"ts": dt.datetime(2020, 1, 1)}, {"ts": dt.datetime(2024, 1, 30, 13)}])
    assert [r.tokens for r in histogram.histogram(u, "1m", now).collect()][:2] == [7, 0]
    assert sum(r.tokens for r in histogram.histogram(u, "1m", now, clamp_left=False).collect()) == 0


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(X.droid_model(F.lit("custom:Claude-Opus-4.5-[Anthropic]-0"))) == "claude-opus-4-5-0"
    for folder, want in {"-home-u-git-app-one": "app-one", "-home-u-work": "work", "-opt-x": "x", "": "unknown", "-home-u-code-a": "a"}.items():
        assert one(X.claude_project(F.lit(folder))) == want
    for hours, want in {0.5: "30m", 2.0: "2h", 2.5: "2h 30m", 24.0: "1d", 49.0: "2d 1h"}.items():
        assert one(X.format_duration_short(F.lit(hours))) == want
    assert [one(X.format_tokens(F.lit(n))) for n in (999, 1200, 3_400_000)] == ["999", "1.2K", "3.4M"]
    assert one(X.format_cost(F.lit(None).cast("double"), "$")) == "N/A" and X.symbol("XYZ") == "XYZ "
    assert one(X.projection_text(F.lit(120.0))) == ">100% (~120%)"
    assert outputs.choose_columns(["+projects", "-tools"])[-1] == "projects" and outputs.choose_columns(["cost", "period"]) == ["cost", "period"]
    with pytest.raises(ValueError):
        cost.rate_for(spark.createDataFrame([("USD", "$", 1.0)], "code string, symbol string, rate double"), "12")

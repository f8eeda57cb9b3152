"""Weekly subscription cycles: snapshots, costs, estimates and pace. Times are UTC without zone; ``now`` is an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelake.functions.text import format_duration_short, overage_text, percent, plan_label, tier_label
from usagelake.operators.attribution import account_name_at, hour, with_account_name
from usagelake.operators.cost import cost_sum
from usagelake.sources.accounts import LIMITS, scoped_limits

#: Percentages at which an estimate is checked against the service.
THRESHOLDS = (2.5, 5.0, 10.0, 30.0, 50.0, 70.0, 90.0, 95.0, 96.0, 97.0, 98.0, 99.0, 100.0)


def at(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def _week(n: int | Column = 1) -> Column:
    return F.make_dt_interval(F.lit(7) * n if isinstance(n, Column) else F.lit(7 * n))


def minute(c: str | Column) -> Column:
    return F.date_trunc("minute", c).cast("timestamp_ntz")


def cycles(resets: DataFrame, n: int = 4) -> DataFrame:
    """``resets(org_uuid, resets_at)`` to its n weekly cycles, the oldest first; ``number`` is 0 for the current one."""
    out = resets.select("org_uuid", "resets_at", F.explode(F.sequence(F.lit(n - 1), F.lit(0), F.lit(-1))).alias("number"))
    end = F.col("resets_at") - _week(F.col("number"))
    return out.select("org_uuid", "number", (end - _week()).alias("start"), end.alias("end"))


def current_cycle(snapshots: DataFrame, now: str) -> DataFrame:
    """Each organisation's cycle at ``now``: its latest known end, moved on by whole weeks until it is later."""
    last = snapshots.groupBy("org_uuid").agg(F.max("cycle_end").alias("last"))
    behind = F.unix_micros(at(now).cast("timestamp")) - F.unix_micros(F.col("last").cast("timestamp"))
    end = F.col("last") + _week(F.greatest(F.floor(behind / (7 * 86_400 * 1_000_000)) + 1, F.lit(0)).cast("int"))
    return last.select("org_uuid", (end - _week()).alias("start"), end.alias("end"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each cycle (ends are compared to the minute)."""
    fields = F.struct("utilization", "cost_at_calibration", "plan", "captured_at")
    out = snapshots.groupBy("org_uuid", minute("cycle_end").alias("cycle")).agg(F.max_by(fields, "captured_at").alias("s"))
    return out.select("org_uuid", "cycle", "s.*")


def snapshot_for(snapshots: DataFrame, cycles_: DataFrame) -> DataFrame:
    found = latest_snapshots(snapshots).select("org_uuid", F.col("cycle").alias("_c"), "utilization")
    return cycles_.withColumn("_c", minute("end")).join(found, ["org_uuid", "_c"], "left").drop("_c")


def compact_snapshots(observations: DataFrame, keep: int = 12) -> DataFrame:
    """The newest observation of each cycle and plan, and of these each organisation's newest ``keep``."""
    fields = F.struct("cycle_end", "utilization", "captured_at", "cost_at_calibration")
    one = observations.groupBy("org_uuid", minute("cycle_end").alias("cycle"), "plan").agg(F.max_by(fields, "captured_at").alias("s")).select("org_uuid", "plan", "s.*")
    newest = Window.partitionBy("org_uuid").orderBy(F.desc("cycle_end"), F.desc("captured_at"))
    return one.withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") <= keep).drop("_n")


def cost_in_range(priced: DataFrame, start: str, end: str) -> DataFrame:
    return priced.filter((F.col("ts") >= at(start)) & (F.col("ts") < at(end))).agg(cost_sum("zero").alias("cost"))


def cycle_costs(priced: DataFrame, cycles_: DataFrame) -> DataFrame:
    """Cost of the records within each cycle [start, end), whosever they are; records without a price count nothing.

    Records are added up by hour. A span then adds its whole hours, and of the hours at its edges, whose records alone are taken by
    their times, what lies within, by equi-joins on the hour: its work is in proportion to its hours, not to the records.
    """
    spans = cycles_.select("start", "end").distinct()
    priced = priced.select(hour("ts").alias("_hour"), "ts", "cost")
    hours = priced.groupBy("_hour").agg(F.sum("cost").alias("cost"))
    each = spans.withColumn("_hour", F.explode(F.sequence(hour("start"), hour("end"))))
    edge = (F.col("_hour") == hour("start")) | (F.col("_hour") == hour("end"))
    edges = spans.select(F.explode(F.array_distinct(F.array(hour("start"), hour("end")))).alias("_hour")).distinct()
    times = priced.join(edges, "_hour", "left_semi").groupBy("_hour", "ts").agg(F.sum("cost").alias("cost"))
    inside = each.filter(~edge).join(hours, "_hour").select("start", "end", "cost")
    partly = each.filter(edge).join(times, "_hour").filter((F.col("ts") >= F.col("start")) & (F.col("ts") < F.col("end"))).select("start", "end", "cost")
    sums = inside.unionByName(partly).groupBy("start", "end").agg(F.sum("cost").cast("double").alias("cost"))
    return cycles_.join(sums, ["start", "end"], "left").select("org_uuid", "number", "start", "end", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def own_cycle_costs(owned: DataFrame, resets: DataFrame, n: int = 4) -> DataFrame:
    """Cost of each organisation's own records (``owned`` has org_uuid) in its n weekly cycles before ``resets(org_uuid, resets_at)``.

    The cycle is arithmetic: the whole weeks from a record to its organisation's reset. Sums by organisation and cycle are partial in
    each task; the resets, a row an organisation, are joined by Spark's choice.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    week = 7 * 86_400 * 1_000_000
    ends = resets.select(F.col("org_uuid").alias("_org"), micros("resets_at").alias("_reset"))
    at = owned.filter("org_uuid is not null").join(ends, F.col("org_uuid") == F.col("_org")).select("org_uuid", "_reset", micros("ts").alias("t"), "cost")
    number = F.floor((F.col("_reset") - F.col("t") - 1) / week).cast("int")
    sums = at.withColumn("number", number).filter(F.col("number").between(0, n - 1)).groupBy("org_uuid", "number").agg(F.sum("cost").cast("double").alias("cost"))
    return cycles(resets, n).join(sums, ["org_uuid", "number"], "left").select("org_uuid", "number", "start", "end", F.coalesce("cost", F.lit(0.0)).alias("cost"))


def of_account(usage: DataFrame, accounts: DataFrame, switch_log: DataFrame, name: str) -> DataFrame:
    """The records of one account: those whose organisation has its name, and those without organisation while the switch log named it."""
    known = account_name_at(with_account_name(usage, accounts), switch_log)
    return known.filter(F.when(F.col("account_uuid").isNotNull(), F.col("account_name")).otherwise(F.col("log_name")) == name).select(*usage.columns)


def cycle_report(priced: DataFrame, snapshots: DataFrame, resets: DataFrame, n: int = 4, state: DataFrame | None = None) -> DataFrame:
    """Each cycle's period, utilization and its source, cost, cost for one percent, and overage text.

    Completed cycles have the utilization of their newest snapshot, cached. The current one (number 0) is live where
    ``state(org_uuid, live_pct, enabled, used_cents, limit_cents)`` says so, else estimated from its cost, else cached. Overage is the current
    cycle's. ``priced`` may be one account's records (``of_account``). With a column org_uuid (``with_owner``) each organisation has the cost
    of its own records, without one each cycle that of all.
    """
    mine = priced.filter("provider = 'claude'")
    costs = own_cycle_costs(mine, resets, n) if "org_uuid" in priced.columns else cycle_costs(mine, cycles(resets, n))
    last = latest_snapshots(snapshots).select("org_uuid", F.col("cycle").alias("_c"), "utilization", "cost_at_calibration")
    rows = costs.withColumn("_c", minute("end")).join(last, ["org_uuid", "_c"], "left").withColumn("cost_now", F.col("cost"))
    if state is None:
        rows = rows.select("*", F.lit(None).cast("double").alias("live_pct"), F.lit("—").alias("_over"))
    else:
        rows = rows.join(state.select("org_uuid", "live_pct", overage_text(F.col("enabled"), F.col("used_cents"), F.col("limit_cents")).alias("_over")), "org_uuid", "left")
    current = F.col("number") == 0
    out = resolve_usage(rows).withColumns({"utilization": F.when(current, F.col("pct")).otherwise(F.col("utilization")), "source": F.when(current, F.col("source")).otherwise("cached")})
    return out.select("org_uuid", "number", "start", "end", "utilization", "source", "cost", F.when(F.col("utilization") > 0, F.col("cost") / F.col("utilization")).alias("cost_per_pct"),
                      F.when(current, F.coalesce("_over", F.lit("—"))).otherwise("—").alias("overage")).orderBy("org_uuid", "start")


def cycle_sub_rows(payloads: DataFrame) -> DataFrame:
    """The rows below the current cycle, of the usage-limit payloads ``(org_uuid, value)``: the five-hour window, then each model's weekly limit above 0."""
    five = payloads.withColumn("j", F.from_json("value", LIMITS)).filter("j.five_hour is not null").select(
        "org_uuid", F.lit(0).alias("pos"), F.lit("5h window").alias("name"), F.col("j.five_hour.utilization").alias("pct"))
    models = scoped_limits(payloads).filter("pct > 0").select("org_uuid", (F.col("pos") + 1).alias("pos"), "name", "pct")
    return five.unionByName(models).select("org_uuid", "pos", F.concat(F.lit("  └─ "), "name").alias("label"), percent(F.col("pct")).alias("usage"))


def resolve_usage(orgs: DataFrame) -> DataFrame:
    """``orgs(live_pct, utilization, cost_at_calibration, cost_now)`` with ``pct`` and ``source``: live, else estimated from the cost, else cached."""
    can = (F.col("utilization") > 0) & (F.col("cost_at_calibration") > 0)
    estimate = F.coalesce("cost_now", F.lit(0.0)) / (F.col("cost_at_calibration") / F.col("utilization"))
    live = F.col("live_pct").isNotNull()
    return orgs.withColumns({
        "pct": F.when(live, F.col("live_pct")).when(can, estimate).otherwise(F.col("utilization")),
        "source": F.when(live, "live").when(can, "estimated").otherwise("cached")})


def needs_calibration(orgs: DataFrame, offline: bool = False, live: bool = False) -> DataFrame:
    """``orgs(utilization, cost_at_calibration, cost_now)`` with ``calibrate``: whether the service should be asked again."""
    ratio = F.col("cost_at_calibration") / F.col("utilization")
    estimate = F.when(ratio > 0, F.coalesce("cost_now", F.lit(0.0)) / ratio).otherwise(F.col("utilization"))
    crossed = F.exists(F.array(*map(F.lit, THRESHOLDS)), lambda t: (F.col("utilization") < t) & (estimate >= t))
    need = F.when(F.col("utilization").isNull() | (F.col("utilization") < 2.5) | F.col("cost_at_calibration").isNull(), True).otherwise(crossed)
    return orgs.withColumn("calibrate", F.lit(False) if offline else F.lit(True) if live else need)


def _hours(a: Column, b: Column) -> Column:
    """Whole minutes from a to b, in hours."""
    micros = F.unix_micros(b.cast("timestamp")) - F.unix_micros(a.cast("timestamp"))
    return (micros / 60_000_000).cast("bigint") / 60.0


def pace(orgs: DataFrame, now: str) -> DataFrame:
    """``orgs(pct, start, end)`` with ``projected`` percent at the cycle's end (at most 200) and a status text.

    At the very start of a cycle any use projects to the most.
    """
    elapsed, left = _hours(F.col("start"), at(now)), _hours(at(now), F.col("end"))
    rate = F.when(elapsed == 0, F.lit(float("inf"))).otherwise(F.try_divide("pct", elapsed))
    projected = F.when(F.col("pct") > 0, F.least(F.col("pct") + rate * left, F.lit(200.0)))
    status = F.when(F.col("pct") >= 100, "at capacity").when(projected >= 100, F.concat(F.lit("hits 100% in "), format_duration_short((100 - F.col("pct")) / rate)))
    status = status.when(projected.isNotNull(), F.concat(F.lit("~"), percent(projected), F.lit(" at reset, "), format_duration_short(left), F.lit(" left")))
    return orgs.withColumns({"projected": projected, "status": status})


def overage(payloads: DataFrame) -> DataFrame:
    """``payloads(org_uuid, enabled, used_cents, limit_cents)`` as text."""
    return payloads.select("org_uuid", overage_text(F.col("enabled"), F.col("used_cents"), F.col("limit_cents")).alias("overage"))


def account_overview(priced: DataFrame, accounts: DataFrame, switch_log: DataFrame, snapshots: DataFrame, now: str, live: DataFrame | None = None,
                     active: str | None = None) -> DataFrame:
    """One row for each account: its plan, weekly and five-hour use, reset, cost and note, and TOTAL (the cost alone) for more than one account.

    ``live(org_uuid, live_pct, five_hour_pct, plan, resets_at, token)`` is what the service said, ``token`` being fresh, expired or null
    (no stored credentials); only a fresh token's values count. ``active`` is the organisation in use. The reset is the live one, else
    the current cycle's of the snapshots; the cost is that of the account's own records in these seven days up to ``now``, null without a
    reset. The plan is the live one of the active account, else that of the newest snapshot, else what the stored credentials claim (``live`` with claim_type
    and claim_tier, where there is a token, fresh or not), else what the account was registered with.
    """
    if live is None:
        live = accounts.sparkSession.createDataFrame([], "org_uuid string, live_pct double, five_hour_pct double, plan string, resets_at timestamp_ntz, token string")
    fresh = lambda c: F.when(F.col("token") == "fresh", F.col(c)).alias(c)
    claims = [c for c in ("claim_type", "claim_tier") if c in live.columns]
    said = live.select("org_uuid", "token", *claims, *[fresh(c) for c in ("live_pct", "five_hour_pct", "plan", "resets_at")])
    rows = accounts.select("name", "org_uuid", "subscription_type", "rate_limit_tier").join(said, "org_uuid", "left").join(
        current_cycle(snapshots, now).select("org_uuid", F.col("end").alias("known_end")), "org_uuid", "left")
    rows = rows.withColumn("end", F.coalesce("resets_at", "known_end")).drop("resets_at", "known_end")
    own = account_name_at(priced.filter("provider = 'claude'"), switch_log).withColumn("org_uuid", F.coalesce("account_uuid", "log_org"))
    spans = rows.filter("end is not null").select("org_uuid", "end").distinct()
    inside = (F.col("ts") >= F.col("end") - _week()) & (F.col("ts") < F.least("end", at(now)))
    cost = own.join(spans, "org_uuid").filter(inside).groupBy("org_uuid", "end").agg(cost_sum("zero").alias("cost_now"))
    last = latest_snapshots(snapshots).select("org_uuid", "cycle", "utilization", "cost_at_calibration")
    newest = snapshots.groupBy("org_uuid").agg(F.max_by("plan", "captured_at").alias("snapshot_plan"))
    rows = rows.join(cost, ["org_uuid", "end"], "left").withColumn("cycle", minute("end")).join(last, ["org_uuid", "cycle"], "left").join(newest, "org_uuid", "left")
    is_active = F.coalesce(F.col("org_uuid") == F.lit(active), F.lit(False))
    claimed = F.when(F.col("token").isNotNull(), F.coalesce(tier_label(F.coalesce("claim_type", F.lit("unknown")), F.col("claim_tier")), F.lit("unknown"))) if claims else F.lit(None)
    label = F.coalesce(plan_label(F.when(is_active, F.col("plan"))), plan_label(F.col("snapshot_plan")), claimed, tier_label(F.col("subscription_type"), F.col("rate_limit_tier")), F.lit("unknown"))
    note = F.when(~is_active & F.col("token").isNull(), "no stored credentials").when(~is_active & (F.col("token") != "fresh"), "token expired")
    rows = resolve_usage(rows).select(
        "name", is_active.alias("active"), label.alias("plan"), F.when(F.col("end").isNotNull(), F.col("pct")).alias("pct"), "source", "five_hour_pct", F.col("end").alias("resets_at"),
        F.when(F.col("end").isNotNull(), F.coalesce("cost_now", F.lit(0.0))).alias("cost"), note.alias("note"))
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("cost").alias("cost")).filter("n > 1 and cost is not null")
    return rows.unionByName(total.select(F.lit("TOTAL").alias("name"), "cost"), allowMissingColumns=True)

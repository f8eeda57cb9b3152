"""Plans: what an account is on, and whether another one fits better."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelake.functions.text import format_cost, percent, symbol
from usagelake.operators.cycles import _hours, at, latest_snapshots, minute
from usagelake.schema import plans


def plan_from_profile(df: DataFrame) -> DataFrame:
    """``df(tier, org_type, has_max, has_pro)`` with ``plan``: by tier, then organisation, then account flags."""
    tier = F.coalesce("tier", F.lit(""))
    by_tier = F.when(tier.contains("20x"), "max20x").when(tier.contains("5x") | tier.contains("max"), "max5x").when(tier.contains("pro"), "pro")
    by_org = F.when(F.col("org_type") == "claude_max", "max5x").when(F.col("org_type") == "claude_pro", "pro")
    by_flag = F.when(F.col("has_max"), "max5x").when(F.col("has_pro"), "pro")
    return df.withColumn("plan", F.coalesce(by_tier, by_org, by_flag))


def plan_from_claims(df: DataFrame) -> DataFrame:
    """``df(subscription_type, rate_limit_tier)`` with ``plan``."""
    tier = F.coalesce("rate_limit_tier", F.lit(""))
    return df.withColumn("plan", F.when(F.col("subscription_type") == "pro", "pro").when(
        F.col("subscription_type") == "max", F.when(tier.contains("20x"), "max20x").otherwise("max5x")))


def project_pct(pct: Column, from_units: Column, to_units: Column) -> Column:
    """A utilization on a plan of another capacity."""
    return pct * from_units / to_units


def recommend(utilizations: DataFrame) -> DataFrame:
    """``judged`` without its number of full cycles."""
    return judged(utilizations).drop("full")


def judged(utilizations: DataFrame) -> DataFrame:
    """``utilizations(org_uuid, plan, pct)`` to one row for each: n, avg, peak, action and the plan to go to, and ``full``, the cycles of 95 and more.

    Up if there is a higher plan and two cycles reach 95 or the average 85; else down if the peak on the
    lower plan is at most 85; else stay. Rows with a null percentage only name the organisation.
    """
    spark = utilizations.sparkSession
    stats = utilizations.groupBy("org_uuid", "plan").agg(F.count("pct").alias("n"), F.avg("pct").alias("avg"), F.max("pct").alias("peak"), F.count_if(F.col("pct") >= 95).alias("full"))
    table = plans(spark)
    lower = table.select(F.col("plan").alias("lower"), F.col("units").alias("lower_units"), F.col("price").alias("lower_price"))
    higher = table.select(F.col("plan").alias("higher"), F.col("price").alias("higher_price"))
    known = stats.join(F.broadcast(table), "plan").join(F.broadcast(lower), "lower", "left").join(F.broadcast(higher), "higher", "left")
    up = (F.col("n") > 0) & F.col("higher").isNotNull() & ((F.col("full") >= 2) | (F.col("avg") >= 85))
    down = (F.col("n") > 0) & F.col("lower").isNotNull() & (project_pct(F.greatest("peak", F.lit(0.0)), F.col("units"), F.col("lower_units")) <= 85)
    action = F.when(up, "upgrade").when(down, "downgrade").otherwise("stay")
    return known.select("org_uuid", "plan", "n", F.coalesce("avg", F.lit(0.0)).alias("avg"), F.coalesce("peak", F.lit(0.0)).alias("peak"), action.alias("action"),
                        F.when(up, F.col("higher")).when(down, F.col("lower")).alias("target"),
                        F.when(up, F.col("higher_price") - F.col("price")).when(down, F.col("lower_price") - F.col("price")).alias("price_change"), "full")


def plan_report(snapshots: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """``_reported`` without what only its texts need."""
    return _reported(snapshots, current, now).drop("full", "barred", "opus_pct", "cycles")


def _reported(snapshots: DataFrame, current: DataFrame, now: str) -> DataFrame:
    """One row for each organisation of ``current(org_uuid, plan, start, end, live_pct, opus_pct)``: its recommendation.

    Judged by those of its last four completed cycles that were on its plan; without one, after 48 hours, by the
    projected current cycle. A way down to Pro is barred while the live Opus limit is at 25 or more. ``basis``
    says what was judged, ``mixed`` whether the four hold cycles of other or unknown plans.
    """
    done = latest_snapshots_by_plan(snapshots).join(current.select("org_uuid", F.col("plan").alias("own"), minute("end").alias("now_cycle")), "org_uuid").filter("cycle <> now_cycle")
    newest = Window.partitionBy("org_uuid").orderBy(F.desc("cycle"), F.desc("captured_at"))
    recent = done.withColumn("_n", F.row_number().over(newest)).filter("_n <= 4")
    native = recent.filter("plan = own").select("org_uuid", "plan", F.col("utilization").alias("pct"))
    mixed = recent.groupBy("org_uuid").agg(F.max(F.coalesce(F.col("plan") != F.col("own"), F.lit(True))).alias("mixed"))
    elapsed, left = _hours(F.col("start"), at(now)), _hours(at(now), F.col("end"))
    projected = F.when((elapsed >= 48) & (F.col("live_pct") > 0), F.least(F.col("live_pct") + F.col("live_pct") / elapsed * left, F.lit(200.0)))
    partial = current.join(native.select("org_uuid").distinct(), "org_uuid", "left_anti").select("org_uuid", "plan", projected.alias("pct"))
    out = judged(native.unionByName(partial)).join(current.select("org_uuid", "opus_pct"), "org_uuid").join(mixed, "org_uuid", "left")
    out = out.join(native.groupBy("org_uuid").agg(F.count(F.lit(1)).alias("cycles")), "org_uuid", "left")
    barred = (F.col("target") == "pro") & (F.col("action") == "downgrade") & (F.col("opus_pct") >= 25)
    barred = F.coalesce(barred, F.lit(False))
    return out.select("org_uuid", "plan", "n", "avg", "peak", F.when(barred, "stay").otherwise(F.col("action")).alias("action"), F.when(~barred, F.col("target")).alias("target"),
                      F.when(~barred, F.col("price_change")).alias("price_change"), F.when(F.col("cycles") > 0, "cycles").when(F.col("n") > 0, "partial").otherwise("recent switch").alias("basis"),
                      F.coalesce("mixed", F.lit(False)).alias("mixed"), "full", barred.alias("barred"), "opus_pct", F.coalesce("cycles", F.lit(0)).alias("cycles"))


#: The texts of a recommendation, line by line.
TEXTS = {
    "downgrade": ["▸ Recommend: downgrade to {to} — save ~{change}/month", "", "  {count}-cycle average was {avg} (peak {peak}). On {to}, this projects to",
                  "  ~{new_avg} avg (~{new_peak} peak) — comfortable headroom."],
    "upgrade": ["▸ Recommend: upgrade to {to} — +{change}/month", "", "{why}", "  {to} offers {times}× more headroom for the same workload."],
    "full": ["  You've hit ≥95% utilization in {full} of the last {cycles} cycles."],
    "near": ["  {count}-cycle average is {avg} — consistently near capacity."],
    "stay": ["▸ Recommend: stay on {own}", "", "{was}", "{lower}"],
    "was": ["  {count}-cycle average was {avg} (peak {peak})."],
    "projected": ["  Partial-cycle projection: ~{peak} on {own}."],
    "lower": ["  Downgrading to {below} would push peak to ~{below_peak} — too tight."],
    "lowest": ["  Utilization is in a comfortable range for this plan."],
    "barred": ["Pro downgrade skipped — Opus usage on current cycle (~{opus}) suggests Pro's tier limits would throttle hard."],
    "head": ["{own} — {price}/month", ""],
}


def plan_texts(snapshots: DataFrame, current: DataFrame, now: str, code: str = "USD", rate: float = 1.0) -> DataFrame:
    """``plan_report`` as it is told: org_uuid and ``text``, lines of plan and price, what bars a way down, and the recommendation with the average and the
    peak as they would be on the plan to go to. After a recent switch there is no recommendation."""
    table = plans(snapshots.sparkSession)
    other = lambda name, prefix: F.broadcast(table.select(F.col("plan").alias(name), *[F.col(c).alias(f"{prefix}_{c}") for c in ("label", "units", "price", "lower")]))
    rows = _reported(snapshots, current, now).join(other("plan", "own"), "plan").join(other("target", "to"), "target", "left")
    rows = rows.join(other("_below", "below"), F.col("own_lower") == F.col("_below"), "left")
    money = lambda c: format_cost(c * rate, symbol(code))
    on = lambda c, units: percent(project_pct(F.col(c), F.col("own_units"), F.col(units)))
    values = {
        "own": F.col("own_label"), "to": F.col("to_label"), "below": F.col("below_label"), "price": money(F.col("own_price")), "change": money(F.abs("price_change")),
        "count": F.when(F.col("cycles") > 0, F.col("cycles").cast("string")).otherwise("1 (partial cycle)"), "avg": percent(F.col("avg")), "peak": percent(F.col("peak")),
        "new_avg": on("avg", "to_units"), "new_peak": on("peak", "to_units"), "below_peak": on("peak", "below_units"), "full": F.col("full").cast("string"), "cycles": F.col("cycles").cast("string"),
        "times": F.bround(F.col("to_units") / F.col("own_units"), 0).cast("int").cast("string"), "opus": percent(F.col("opus_pct"))}

    def told(kind: str, **more: Column) -> Column:
        text = F.lit("\n".join(TEXTS[kind]))
        for name, value in (values | more).items():
            if "{" + name + "}" in "\n".join(TEXTS[kind]):
                text = F.replace(text, F.lit("{" + name + "}"), value)
        return text

    full = (F.col("cycles") > 0) & (F.col("full") >= 2)
    stay = told("stay", was=F.when(F.col("cycles") > 0, told("was")).otherwise(told("projected")), lower=F.when(F.col("own_lower").isNotNull(), told("lower")).otherwise(told("lowest")))
    advice = F.when(F.col("action") == "downgrade", told("downgrade")).when(F.col("action") == "upgrade", told("upgrade", why=F.when(full, told("full")).otherwise(told("near")))).otherwise(stay)
    parts = F.array(told("head"), F.when(F.col("barred"), told("barred")), F.when(F.col("basis") != "recent switch", advice))
    return rows.select("org_uuid", F.array_join(parts, "\n").alias("text"))


def latest_snapshots_by_plan(snapshots: DataFrame) -> DataFrame:
    """The newest snapshot of each cycle and plan."""
    fields = F.struct("utilization", "captured_at")
    out = snapshots.groupBy("org_uuid", minute("cycle_end").alias("cycle"), "plan").agg(F.max_by(fields, "captured_at").alias("s"))
    return out.select("org_uuid", "cycle", "plan", "s.utilization", "s.captured_at")


def plan_table(snapshots: DataFrame, spark_plans: DataFrame, current: DataFrame) -> DataFrame:
    """The last four completed cycles of each organisation of ``current(org_uuid, plan, end)`` as they would be on every plan.

    Cycles of another plan are first taken to the organisation's own and from there to the others; null for an unknown plan.
    """
    done = latest_snapshots_by_plan(snapshots).join(current.select("org_uuid", F.col("plan").alias("own"), minute("end").alias("now_cycle")), "org_uuid").filter("cycle <> now_cycle")
    newest = Window.partitionBy("org_uuid").orderBy(F.desc("cycle"), F.desc("captured_at"))
    recent = done.withColumn("_n", F.row_number().over(newest)).filter("_n <= 4")
    units = lambda name, to: F.broadcast(spark_plans.select(F.col("plan").alias(name), F.col("units").alias(to)))
    rows = recent.join(units("plan", "units"), "plan", "left").join(units("own", "own_units"), "own", "left")
    on_own = F.when(F.col("plan") == F.col("own"), F.col("utilization")).otherwise(project_pct(F.col("utilization"), F.col("units"), F.col("own_units")))
    to = {r["plan"]: r["units"] for r in spark_plans.select("plan", "units").collect()}  # three rows
    return rows.select("org_uuid", "cycle", "plan", *[F.when(F.col("own") == p, on_own).otherwise(project_pct(on_own, F.col("own_units"), F.lit(u))).alias(f"on_{p}") for p, u in to.items()])

"""Burn rates: tokens and cost by active time with capped idle gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelake.schema import TOKENS


def seconds(ts: Column) -> Column:
    """Whole seconds since 1970 of a timestamp, with or without zone (the session's zone is UTC)."""
    return F.unix_seconds(ts.cast("timestamp"))


def record_tokens() -> Column:
    return sum((F.col(c) for c in TOKENS[1:]), F.col(TOKENS[0]))


#: Seconds of a slice of time; a group's slice is one row, whatever the number of its records.
SLICE = 3_600


def _slices(usage: DataFrame, keys: list[str], cap: int, *more: Column) -> DataFrame:
    """One row for each group and slice that has records: seconds of activity within it and since the slice before, and ``more``.

    Gaps are of whole seconds, so all that a slice needs is the set of its seconds: it is made up in each task before the rows are dealt, and a
    session that holds all records of a table is many slices of at most ``SLICE`` numbers. Gaps between slices are taken from these rows.
    """
    s = seconds(F.col("ts"))
    out = usage.groupBy(*keys, F.floor(s / SLICE).alias("_slice")).agg(F.array_sort(F.collect_set(F.pmod(s, F.lit(SLICE)).cast("int"))).alias("_at"), *more)
    gaps = F.zip_with(F.slice("_at", F.lit(2), F.size("_at")), F.slice("_at", F.lit(1), F.size("_at") - 1), lambda b, a: F.least(b - a, F.lit(cap)))
    inside = F.aggregate(gaps, F.lit(0).cast("bigint"), lambda n, gap: n + gap)
    start = F.col("_slice") * SLICE
    out = out.withColumns({"first": start + F.element_at("_at", 1), "last": start + F.element_at("_at", -1), "gap": inside}).drop("_at")
    since = F.col("first") - F.lag("last").over(Window.partitionBy(*keys).orderBy("_slice"))
    return out.withColumn("gap", F.col("gap") + F.when(since.isNotNull(), F.least(since, F.lit(cap))).otherwise(0))


def active_secs(usage: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """Seconds of activity of each group: gaps from record to record, each at most the cap."""
    return _slices(usage, keys, cap).groupBy(*keys).agg(F.sum("gap").alias("active_secs"))


def local_days(usage: DataFrame, keys: list[str], tz: str = "UTC") -> DataFrame:
    """Distinct days of each group in a time zone."""
    day = F.to_date(F.from_utc_timestamp(F.col("ts").cast("timestamp"), tz))
    return usage.select(*keys, day.alias("d")).distinct().groupBy(*keys).agg(F.count("d").alias("calendar_days"))


def _rates(sums: DataFrame, key: str) -> DataFrame:
    def per(value: str, by: str, unit: float) -> Column:
        return F.when(F.col(by) > 0, F.col(value).cast("double") / (F.col(by) / unit))

    return sums.select(F.col(key).alias("model"), "tokens", "cost", "active_secs", "calendar_days", per("tokens", "active_secs", 60.0).alias("tokens_per_min"),
                       per("cost", "active_secs", 3600.0).alias("cost_per_active_hour"), per("cost", "calendar_days", 1.0).alias("cost_per_calendar_day"))


def _measured(priced: DataFrame, keys: list[str], cap: int, tz: str) -> DataFrame:
    """One row for each group, session and slice: tokens, cost, numbers of records and of priced ones, active seconds, and local days."""
    out = _slices(priced, [*keys, "session_id"], cap, F.sum(record_tokens()).alias("tokens"), F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.count("cost").alias("priced"))
    day = lambda c: F.to_date(F.from_utc_timestamp(F.timestamp_seconds(c), tz))
    # A slice is no longer than a day, so it lies in the days of its first and last second.
    return out.withColumn("days", F.array(day("first"), day("last")))


def _burned(slices: DataFrame, key: Column) -> DataFrame:
    out = slices.groupBy(key.alias("model")).agg(
        F.sum("tokens").alias("tokens"), F.when(F.sum("n") == F.sum("priced"), F.sum("cost")).cast("double").alias("cost"), F.sum("gap").alias("active_secs"),
        F.size(F.array_distinct(F.flatten(F.collect_set("days")))).cast("bigint").alias("calendar_days"))
    return _rates(out, "model")


def burn_models(priced: DataFrame, idle_gap_mins: int = 5, tz: str = "UTC") -> DataFrame:
    """One row for each model, the dearest first, unpriced ones last; a record without a price makes its model's cost null."""
    out = _burned(_measured(priced, ["model"], 60 * idle_gap_mins, tz), F.col("model"))
    return out.orderBy(F.col("cost").desc_nulls_last(), F.col("tokens").desc(), "model")


def burn_all(priced: DataFrame, idle_gap_mins: int = 5, tz: str = "UTC") -> DataFrame:
    """The row ALL: gaps within sessions whatever the model, so its active time isn't the models' sum."""
    return _burned(_measured(priced, [], 60 * idle_gap_mins, tz), F.lit("ALL"))


def burn(priced: DataFrame, idle_gap_mins: int = 5, tz: str = "UTC") -> DataFrame:
    return burn_models(priced, idle_gap_mins, tz).unionByName(burn_all(priced, idle_gap_mins, tz))

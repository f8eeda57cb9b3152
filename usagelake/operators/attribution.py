"""Which account a record belongs to: as-of join with the switch log, and account names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def hour(ts: str | Column) -> Column:
    """Whole hours since 1970."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 3_600)


def _index(switch_log: DataFrame) -> DataFrame:
    """The log as an index: for each day from the first switch to the day after the last one the switch before it, and its own by hour.

    Made of the log alone. Each hour of a day with switches has its own and the one before it, so what a record looks through are the switches of
    its hour. Of entries at one time the last in the log counts.
    """
    last = switch_log.groupBy("at_ts").agg(F.max_by(F.struct("org", "nm"), "pos").alias("e"))
    switch = F.struct(F.col("at_ts").alias("at"), F.col("e.org").alias("org"), F.col("e.nm").alias("nm"))
    days = last.groupBy(F.floor(hour("at_ts") / 24).alias("day")).agg(F.array_sort(F.collect_list(switch)).alias("own"))
    # One row: a number and an entry for each day with switches. The day's array stays where it is.
    ends = days.agg(F.array_sort(F.collect_list(F.struct("day", F.element_at("own", -1).alias("last")))).alias("ends"))
    pairs = ends.select(F.explode(F.arrays_zip("ends", F.slice("ends", F.lit(2), F.size("ends")).alias("next"))).alias("p"))
    until = F.coalesce("p.next.day", F.col("p.ends.day") + 1)
    covered = pairs.select(F.explode(F.sequence(F.col("p.ends.day") + 1, until)).alias("day"), F.col("p.ends.last").alias("before"))
    both = covered.join(days, "day", "full")

    def slots(own: Column, before: Column) -> Column:
        """For each hour the last switch before it and its own."""
        at = lambda x: F.pmod(hour(x["at"]), F.lit(24))
        earlier = lambda h: F.coalesce(F.try_element_at(F.filter(own, lambda x: at(x) < h), F.lit(-1)), before)
        return F.transform(F.sequence(F.lit(0), F.lit(23)), lambda h: F.concat(F.array(earlier(h)), F.filter(own, lambda x: at(x) == h)))

    return both.select(F.col("day").alias("_day"), F.col("before").alias("_before"), F.when(F.col("own").isNotNull(), slots(F.col("own"), F.col("before"))).alias("_slots"))


def account_name_at(usage: DataFrame, switch_log: DataFrame, broadcast: bool | None = None) -> DataFrame:
    """``usage`` with log_org and log_name of the newest switch at or before each record; null before the first.

    An equi-join with the log's index on the day; records after its last day meet that one. Nothing is run before the join is, and the join is
    Spark's choice by the log's size unless ``broadcast`` says so.
    """
    index = _index(switch_log)
    end = switch_log.agg(F.floor(F.max(hour("at_ts")) / 24) + 1).scalar()
    index = index if broadcast is None else F.broadcast(index) if broadcast else index.hint("merge")
    found = usage.withColumn("_day", F.least(F.floor(hour("ts") / 24), end)).join(index, "_day", "left")
    # On the last day, which is without switches, all later records are.
    slot = F.filter(F.get("_slots", F.pmod(hour("ts"), F.lit(24)).cast("int")), lambda x: x["at"] <= F.col("ts"))
    found = found.withColumn("_s", F.when(F.col("_slots").isNotNull(), F.try_element_at(slot, F.lit(-1))).otherwise(F.col("_before")))
    return found.select(*usage.columns, F.col("_s.org").alias("log_org"), F.col("_s.nm").alias("log_name"))


def _first_by(accounts: DataFrame, column: str) -> Column:
    return F.min_by(column, "position") if "position" in accounts.columns else F.min(column)


def with_account_name(usage: DataFrame, accounts: DataFrame) -> DataFrame:
    """``usage`` with account_name, the name of its account's organisation.

    Of several accounts of one organisation that of the smallest ``position`` counts, without such a column the first name.
    """
    names = accounts.groupBy(F.col("org_uuid").alias("_org")).agg(_first_by(accounts, "name").alias("account_name"))
    return usage.join(names, F.col("account_uuid") == F.col("_org"), "left").drop("_org")


def with_owner(usage: DataFrame, accounts: DataFrame, switch_log: DataFrame) -> DataFrame:
    """``usage`` with org_uuid, the organisation that each record counts for: its own if that is registered, without one that of the account
    which the switch log names at its time; else none."""
    named = account_name_at(with_account_name(usage, accounts), switch_log)
    orgs = accounts.groupBy(F.col("name").alias("_name")).agg(_first_by(accounts, "org_uuid").alias("_named_org"))
    owner = F.when(F.col("account_uuid").isNotNull(), F.when(F.col("account_name").isNotNull(), F.col("account_uuid"))).otherwise(F.col("_named_org"))
    return named.join(orgs, F.col("log_name") == F.col("_name"), "left").select(*usage.columns, owner.alias("org_uuid"))


def tag_account(usage: DataFrame, switch_log: DataFrame, fallback: str | None) -> DataFrame:
    """Claude records get the organisation of the switch log at their time, else the fallback; others none."""
    at = account_name_at(usage, switch_log)
    org = F.when(F.col("provider") == "claude", F.coalesce("log_org", F.lit(fallback)))
    return at.withColumn("account_uuid", org).drop("log_org", "log_name")


def bootstrap_switch_log(usage: DataFrame, org: str, now: str) -> DataFrame:
    """The first entry of an empty registry: account ``default`` since the earliest claude record, else since now."""
    first = usage.filter("provider = 'claude'").agg(F.min("ts").alias("t"))
    return first.select(F.coalesce("t", F.lit(now).cast("timestamp_ntz")).alias("at_ts"), F.lit(org).alias("org"), F.lit("default").alias("nm"), F.lit("bootstrap").alias("source"))

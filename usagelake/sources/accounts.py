"""Registry, snapshot store and usage-limit payloads (JSON in a column ``value``) to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SNAPSHOT = "struct<cycle_end:string, utilization:double, captured_at:string, cost_at_calibration:double, plan:string>"
_WINDOW = "struct<utilization:double, resets_at:string>"
LIMITS = (f"five_hour {_WINDOW}, seven_day {_WINDOW}, seven_day_opus {_WINDOW}, seven_day_sonnet {_WINDOW}, "
          "limits array<struct<kind:string, `group`:string, percent:double, scope:struct<model:struct<display_name:string>>>>, "
          "extra_usage struct<is_enabled:boolean, monthly_limit:double, used_credits:double>")


def read_registry(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accounts with their ``position`` in the registry, and the switch log with the place of each entry."""
    schema = ("version int, accounts array<struct<name:string, org_uuid:string, added_at:string, last_used_at:string, subscription_type:string, rate_limit_tier:string>>, "
              "switch_log array<struct<at:string, org_uuid:string, name:string, source:string>>")
    j = df.select(F.from_json("value", schema).alias("j"))
    accounts = j.select(F.posexplode("j.accounts").alias("position", "a")).select("a.*", "position")
    log = j.select(F.posexplode("j.switch_log").alias("pos", "s"))
    return accounts, log.select(F.try_to_timestamp("s.at").cast("timestamp_ntz").alias("at_ts"), F.col("s.org_uuid").alias("org"), F.col("s.name").alias("nm"), "s.source", "pos")


def read_snapshots(df: DataFrame, migration_org: str) -> DataFrame:
    """Snapshots of a store: version 2 by organisation, an older list under one given organisation; a broken or empty store has none."""
    j = df.select(F.from_json("value", f"version int, accounts map<string, struct<snapshots:array<{_SNAPSHOT}>>>, snapshots array<{_SNAPSHOT}>").alias("j"))
    by_org = F.flatten(F.transform(F.map_entries("j.accounts"), lambda e: F.transform(e["value"]["snapshots"], lambda s: F.struct(e["key"].alias("org_uuid"), s.alias("s")))))
    flat = F.transform("j.snapshots", lambda s: F.struct(F.lit(migration_org).alias("org_uuid"), s.alias("s")))
    rows = j.select(F.explode(F.when(F.col("j.version") >= 2, by_org).otherwise(flat)).alias("r"))
    at = lambda c: F.try_to_timestamp(f"r.s.{c}").cast("timestamp_ntz").alias(c)
    return rows.select("r.org_uuid", at("cycle_end"), "r.s.utilization", at("captured_at"), "r.s.cost_at_calibration", "r.s.plan")


def _scoped(j: str) -> Column:
    weekly = F.filter(f"{j}.limits", lambda x: (x["group"] == "weekly") & x["scope"]["model"]["display_name"].isNotNull())
    new = F.transform(weekly, lambda x: F.struct(x["scope"]["model"]["display_name"].alias("name"), x["percent"].alias("pct")))
    old = F.array_compact(F.array(*[F.when(F.col(f"{j}.{c}").isNotNull(), F.struct(F.lit(n).alias("name"), F.col(f"{j}.{c}.utilization").alias("pct"))) for n, c in (("Sonnet", "seven_day_sonnet"), ("Opus", "seven_day_opus"))]))
    return F.when(F.size(new) > 0, new).otherwise(old)


def scoped_limits(df: DataFrame) -> DataFrame:
    """Weekly limits by model in their order; where a payload has none, the older Sonnet and Opus windows."""
    j = df.withColumn("j", F.from_json("value", LIMITS))
    return j.select("org_uuid", F.posexplode(_scoped("j")).alias("pos", "l")).select("org_uuid", "pos", "l.name", "l.pct")


def model_limit_pct(df: DataFrame, name: str) -> DataFrame:
    """The first limit of a model for each organisation, letter case ignored."""
    rows = scoped_limits(df).filter(F.lower("name") == name.lower())
    return rows.groupBy("org_uuid").agg(F.min_by("pct", "pos").alias("pct"))

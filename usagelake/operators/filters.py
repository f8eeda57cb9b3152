"""Row filters: date range, project, tool and account."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.operators.attribution import account_name_at, with_account_name
from usagelake.schema import PROVIDERS


def in_range(usage: DataFrame, first: str | dt.date | None, last: str | dt.date | None) -> DataFrame:
    """Records whose UTC date lies between both dates, each included; None is open.

    Plain comparisons of the timestamp, so they reach the scan, and of the date by which the usage table is partitioned, where it is there.
    """
    dated = "usage_date" in usage.columns
    if first is not None:
        usage = usage.filter(F.col("ts") >= F.lit(str(first)).cast("timestamp_ntz"))
        usage = usage.filter(F.col("usage_date") >= F.lit(str(first)).cast("date")) if dated else usage
    if last is not None:
        after = dt.date.fromisoformat(str(last)) + dt.timedelta(days=1)
        usage = usage.filter(F.col("ts") < F.lit(str(after)).cast("timestamp_ntz"))
        usage = usage.filter(F.col("usage_date") <= F.lit(str(last)).cast("date")) if dated else usage
    return usage


def resolve_range(first: dt.date | None, last: dt.date | None, today: dt.date) -> tuple[dt.date, dt.date] | None:
    """Both ends of a range of which one may be missing; None for all dates."""
    if first is None and last is None:
        return None
    return first or dt.date(2020, 1, 1), last or today


def named_range(kind: str, today: dt.date) -> tuple[dt.date, dt.date]:
    """The ranges of the status line, the plots, the subscription report and the live view."""
    back = {"today": 0, "week": 6, "1d": 1, "1w": 7, "1m": 30, "subscription": 35, "watch": 0}
    return (today.replace(day=1) if kind == "month" else today - dt.timedelta(days=back[kind])), today


def by_project(usage: DataFrame, needle: str) -> DataFrame:
    """Records whose project contains the text, letter case ignored; no character is a wildcard."""
    return usage.filter(F.lower("project").contains(needle.lower()))


def by_tool(usage: DataFrame, name: str) -> DataFrame:
    """Records of one tool, letter case ignored; of an unknown name none."""
    return usage.filter(F.col("provider") == name.lower()) if name.lower() in PROVIDERS else usage.filter(F.lit(False))


def by_account(usage: DataFrame, accounts: DataFrame, switch_log: DataFrame, name: str, strict_uuid: bool = False) -> DataFrame:
    """Claude records of an account: by the record's own account if it is registered, else by the switch log at its time.

    With ``strict_uuid`` a record with an account that isn't registered matches nothing.
    """
    columns = usage.columns
    named = account_name_at(with_account_name(usage.filter("provider = 'claude'"), accounts), switch_log)
    if strict_uuid:
        match = F.when(F.col("account_uuid").isNotNull(), F.col("account_name") == name).otherwise(F.col("log_name") == name)
    else:
        match = F.coalesce("account_name", "log_name") == name
    return named.filter(match).select(*columns)


def by_org(usage: DataFrame, switch_log: DataFrame, org: str) -> DataFrame:
    """Claude records of an organisation: the record's own, else the switch log's at its time."""
    columns = usage.columns
    at = account_name_at(usage.filter("provider = 'claude'"), switch_log)
    return at.filter(F.coalesce("account_uuid", "log_org") == org).select(*columns)

"""Token histograms over the last day, week or month."""

from __future__ import annotations

import datetime as dt
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.operators.burn import record_tokens, seconds

#: Width, number of buckets, how far back an aligned and a relative plot start.
PERIODS = {
    "1d": (dt.timedelta(minutes=30), 48, dt.timedelta(days=1), dt.timedelta(hours=24)),
    "1w": (dt.timedelta(hours=6), 28, dt.timedelta(days=7), dt.timedelta(days=7)),
    "1m": (dt.timedelta(days=1), 30, dt.timedelta(days=29), dt.timedelta(days=30)),
}


def _label(period: str, at: dt.datetime, first: bool) -> str:
    if period == "1d":
        return f"{at:%H}" if at.minute == 0 else ""
    if period == "1w":
        return f"{at:%a}" if at.hour == 0 else ""
    return f"{at:%b} {at.day}" if at.day == 1 or first else str(at.day)


def buckets(period: str, now: dt.datetime, tz: str = "UTC", relative: bool = False, include_partial: bool = False) -> list[tuple[int, int, str]]:
    """Number, start (seconds since 1970) and label of each bucket that ends by ``now`` (a UTC time)."""
    width, count, aligned, back = PERIODS[period]
    zone = ZoneInfo(tz)
    local = now.replace(tzinfo=dt.UTC).astimezone(zone)
    start = local - (back if relative else aligned)
    if not relative:
        start = start.replace(minute=0, second=0, microsecond=0) if period == "1d" else start.replace(hour=0, minute=0, second=0, microsecond=0)
    begin = start.timestamp()
    ends = [begin + width.total_seconds() * (i + 1) for i in range(count)]
    kept = [i for i, e in enumerate(ends) if e <= now.replace(tzinfo=dt.UTC).timestamp() or include_partial and e - width.total_seconds() <= now.replace(tzinfo=dt.UTC).timestamp()]
    return [(i, int(begin + width.total_seconds() * i), _label(period, dt.datetime.fromtimestamp(begin + width.total_seconds() * i, zone), i == 0)) for i in kept]


def histogram(usage: DataFrame, period: str, now: dt.datetime, tz: str = "UTC", relative: bool = False, clamp_left: bool = True, include_partial: bool = False) -> DataFrame:
    """One row for each bucket: bucket, start, label, tokens; empty buckets have 0.

    Records before the first bucket count in it (``clamp_left``), those after the last bucket nowhere. The
    rows are counted by arithmetic in one grouping of at most 48 groups and then meet the list of buckets.
    """
    spark, width = usage.sparkSession, PERIODS[period][0].total_seconds()
    spine = spark.createDataFrame(buckets(period, now, tz, relative, include_partial), "bucket int, start bigint, label string")
    listed = buckets(period, now, tz, relative, include_partial)
    if not listed:
        return spine.select("bucket", F.timestamp_seconds("start").cast("timestamp_ntz").alias("start"), "label", F.lit(0).cast("bigint").alias("tokens"))
    begin = listed[0][1]
    number = F.floor((seconds(F.col("ts")) - begin) / width).cast("int")
    number = F.greatest(number, F.lit(0)) if clamp_left else number
    counted = usage.select(number.alias("bucket"), record_tokens().alias("t")).filter(F.col("bucket").between(0, len(listed) - 1)).groupBy("bucket").agg(F.sum("t").alias("t"))
    return spine.join(F.broadcast(counted), "bucket", "left").select(
        "bucket", F.timestamp_seconds("start").cast("timestamp_ntz").alias("start"), "label", F.coalesce("t", F.lit(0)).alias("tokens")).orderBy("bucket")

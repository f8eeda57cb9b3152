"""Duplicates: one record for each provider, message, request and account."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ("provider", "message_id", "request_id")


def dedup(usage: DataFrame, order: tuple[str, ...] = ("ts", "source_file", "seq")) -> DataFrame:
    """The first record of each key by ``order`` (columns that are missing are passed over); null and empty account are one.

    ``min_by`` combines before the shuffle, so a key that many records share (empty ids) is no hot task.
    """
    columns = usage.columns
    account = F.coalesce("account_uuid", F.lit("")).alias("_account")
    first = usage.groupBy(*KEY, account).agg(F.min_by(F.struct(*columns), F.struct(*[c for c in order if c in columns])).alias("first"))
    return first.select(*[F.col(f"first.{c}").alias(c) for c in columns])

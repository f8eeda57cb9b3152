"""Strict readings of JSON fields: a value of another type counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """``df`` with the column ``name``, worked out once for each row.

    Filters on a plain column move below it and work it out again for each mention, a parsed line some dozen times. They don't move below an ``explode``.
    """
    return df.withColumn(name, F.explode(F.array(c)))


def u64(c: Column) -> Column:
    """A non-negative whole number, else null (from_json gives null for other types)."""
    return F.when(c >= 0, c)


def tokens(c: Column) -> Column:
    return F.coalesce(u64(c), F.lit(0))


def text(c: Column, value: Column, path: str) -> Column:
    """A field read as a string, null if the JSON value at ``path`` was of another type.

    from_json turns numbers, booleans and objects into strings; only what could be one of these is looked up again.
    """
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(value), path, "variant"))
    return F.when(~c.rlike(r'^(-?[0-9]|true$|false$|\{|\[)'), c).when(kind == "STRING", c)


def rfc3339(c: Column) -> Column:
    """Time of a text that names its zone, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[Tt ].*([Zz]|[+-][0-9]{2}:?[0-9]{2})$"), F.try_to_timestamp(c))


#: Milliseconds since 1970 of the years 1 to 9999.
FIRST_MILLI, LAST_MILLI = -62_135_596_800_000, 253_402_300_799_999


def millis(c: Column) -> Column:
    """Time of milliseconds since 1970, null outside of the years 1 to 9999."""
    return F.timestamp_millis(F.when(c.between(FIRST_MILLI, LAST_MILLI), c))


def string(v: Column) -> Column:
    """A variant's text; null if it is of another type."""
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def integer(v: Column) -> Column:
    """A variant's whole number; null if it is of another type."""
    return F.when(F.schema_of_variant(v) == "BIGINT", F.try_variant_get(v, "$", "bigint"))


def mistyped(*fields: Column) -> Column:
    """Whether one of the variants is neither missing nor a text."""
    out = F.lit(False)
    for v in fields:
        out = out | F.coalesce(~F.schema_of_variant(v).isin("STRING", "VOID"), F.lit(False))
    return out

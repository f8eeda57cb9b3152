"""Prices and currencies. Costs are decimals to the last step, so that sums do not depend on their order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def price(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """``usage`` with ``cost`` (decimal, USD): tokens by kind times the model's price, null for a model without one.

    ``pricing(model, i, o, cr, cw)`` holds USD per token; a missing cache price adds nothing. A price list has some
    thousand models; Spark picks the join by its size.
    """
    part = lambda c, p: (F.col(c).cast("decimal(19,0)") * p).cast("decimal(34,12)")  # noqa: E731  # whatever a bigint holds
    nothing = F.lit(0).cast("decimal(16,12)")
    priced = usage.join(pricing.withColumnRenamed("model", "_model"), F.col("model") == F.col("_model"), "left")
    cost = (part("input_tokens", F.col("i")) + part("output_tokens", F.col("o")) + part("cache_read_input_tokens", F.coalesce("cr", nothing))
            + part("cache_creation_input_tokens", F.coalesce("cw", nothing)))
    return priced.withColumn("cost", cost).drop("_model", "i", "o", "cr", "cw")


def unpriced_models(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Models in use without a price, in order."""
    return usage.select("model").distinct().join(pricing.select("model"), "model", "left_anti").orderBy("model")


def cost_sum(rule: str, cost: str | Column = "cost") -> Column:
    """Sum of costs: ``ignore`` nulls, ``poison`` (one null makes the sum null) or ``zero`` (null counts nothing, no rows give 0)."""
    c = F.col(cost) if isinstance(cost, str) else cost
    total = F.sum(c)
    return {"ignore": total, "poison": F.when(F.count(F.lit(1)) == F.count(c), total), "zero": F.coalesce(total, F.lit(0))}[rule].cast("double")


def rate_for(rates: DataFrame, code: str) -> DataFrame:
    """One row (code, symbol, rate) for a currency; the dollar's for a code that isn't listed."""
    code = code.upper()
    if not (len(code) == 3 and code.isascii() and code.isalpha()):
        raise ValueError(f"{code!r} is no currency code")
    found = rates.filter(F.col("code").isin(code, "USD"))
    return found.orderBy((F.col("code") == code).desc()).limit(1).select("code", "symbol", "rate")


def convert(priced: DataFrame, rates: DataFrame, code: str, cost: str = "cost") -> DataFrame:
    """``priced`` with its cost in another currency, and that currency's code."""
    row = rate_for(rates, code).first()  # one row of a dimension
    return priced.withColumn(cost, F.col(cost).cast("double") * row["rate"]).withColumn("currency", F.lit(row["code"]))

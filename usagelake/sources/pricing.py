"""Price lists to (model, i, o, cr, cw), USD per token. The lists are single documents of some thousand models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelake.functions.text import price_key


def _usd(c: Column) -> Column:
    return c.cast("decimal(16,12)")


def _first(df: DataFrame, *order: str | Column) -> DataFrame:
    """One row for each model: the first by ``order``."""
    place = F.row_number().over(Window.partitionBy("model").orderBy(*order))
    return df.withColumn("_n", place).filter("_n = 1").select("model", "i", "o", "cr", "cw")


def pricing_litellm(df: DataFrame) -> DataFrame:
    """Object of model to prices; entries without both prices are none. Also stored without vendor prefix and version suffix, own keys first."""
    schema = "map<string, struct<input_cost_per_token:double, output_cost_per_token:double, cache_read_input_token_cost:double, cache_creation_input_token_cost:double>>"
    rows = df.select(F.explode(F.from_json("value", schema)).alias("key", "p")).filter("p.input_cost_per_token is not null and p.output_cost_per_token is not null")
    bare, plain = price_key(F.col("key"))
    names = F.array(*[F.struct(F.lit(n).alias("rank"), c.alias("model")) for n, c in enumerate((F.col("key"), bare, plain))])
    rows = rows.select("key", F.explode(names).alias("m"), "p").select(
        "key", "m.rank", "m.model", _usd(F.col("p.input_cost_per_token")).alias("i"), _usd(F.col("p.output_cost_per_token")).alias("o"),
        _usd(F.col("p.cache_read_input_token_cost")).alias("cr"), _usd(F.col("p.cache_creation_input_token_cost")).alias("cw"))
    return _first(rows.withColumn("other", F.least("rank", F.lit(1))), "other", "key")


def pricing_openrouter(df: DataFrame) -> DataFrame:
    """Prices as texts; stored under the full id and under its last part, full ids first."""
    schema = "data array<struct<id:string, pricing:struct<prompt:string, completion:string, input_cache_read:string, input_cache_write:string>>>"
    rows = df.select(F.posexplode(F.from_json("value", schema)["data"]).alias("n", "d"))
    price = lambda c: F.col(f"d.pricing.{c}").try_cast("decimal(16,12)")
    names = F.array(F.struct(F.lit(0).alias("rank"), F.col("d.id").alias("model")), F.struct(F.lit(1).alias("rank"), F.substring_index("d.id", "/", -1).alias("model")))
    rows = rows.select("n", F.explode(names).alias("m"), price("prompt").alias("i"), price("completion").alias("o"), price("input_cache_read").alias("cr"), price("input_cache_write").alias("cw"))
    return _first(rows.filter("i is not null and o is not null").select("n", "m.*", "i", "o", "cr", "cw"), "rank", "n")


def pricing_llmprices(df: DataFrame) -> DataFrame:
    """Prices a million tokens; the last of equal ids counts; there is no price for cache writes."""
    rows = df.select(F.posexplode(F.from_json("value", "prices array<struct<id:string, input:double, output:double, input_cached:double>>")["prices"]).alias("n", "d"))
    million = lambda c: _usd(F.col(f"d.{c}").cast("decimal(16,6)") / 1_000_000)
    rows = rows.select("n", F.col("d.id").alias("model"), million("input").alias("i"), million("output").alias("o"), million("input_cached").alias("cr"), F.lit(None).cast("decimal(16,12)").alias("cw"))
    return _first(rows.filter("i is not null and o is not null"), F.col("n").desc())


SOURCES = {"litellm": pricing_litellm, "openrouter": pricing_openrouter, "llmprices": pricing_llmprices}


def pricing(df: DataFrame, kind: str = "litellm") -> DataFrame:
    return SOURCES[kind](df)

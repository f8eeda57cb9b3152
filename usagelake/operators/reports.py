"""Grouped reports over priced usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.text import short_model
from usagelake.operators.cost import cost_sum
from usagelake.schema import TOKENS

KEYS = {
    "daily": lambda: F.date_format("ts", "yyyy-MM-dd"),
    "monthly": lambda: F.date_format("ts", "yyyy-MM"),
    "session": lambda: F.concat_ws(" | ", "project", "session_id"),
    "model": lambda: F.col("model"),
    "all": lambda: F.lit("bar"),
}


def bucket(by: str) -> Column:
    return KEYS[by]()


def sums() -> list[Column]:
    return [F.sum(c).alias(c) for c in TOKENS]


def named_sums(priced: DataFrame, *keys: Column, names: tuple[str, ...]) -> DataFrame:
    """Sums by the keys and one of ``names`` at a time: rows ``keys, kind, name, n``, token sums and cost, ``kind`` being the column that ``name`` is of."""
    keyed = priced.select(*keys, *names, *TOKENS, "cost")
    own = [c for c in keyed.columns if c not in (*names, *TOKENS, "cost")]
    fine = keyed.groupBy(*own, *names).agg(F.count(F.lit(1)).alias("n"), *sums(), F.sum("cost").alias("cost"))
    sets = fine.groupingSets([[*own, c] for c in names], *own, *names).agg(
        F.sum("n").alias("n"), *sums(), F.sum("cost").alias("cost"), *[F.grouping(c).alias(f"_no_{c}") for c in names])
    kind = F.coalesce(*[F.when(F.col(f"_no_{c}") == 0, c) for c in names])
    return sets.select(*own, kind.alias("kind"), F.coalesce(*names).alias("name"), "n", *TOKENS, "cost")


def of_kind(kind: str, c: str | Column) -> Column:
    return F.when(F.col("kind") == kind, F.col(c) if isinstance(c, str) else c)


def by_cost() -> Column:
    """The models, the dearest first, those without a price last, of ``named_sums`` rows."""
    order = F.struct((-F.coalesce(F.col("cost"), F.lit(0))).alias("o"), F.col("name").alias("model"), F.col("cost").cast("double").alias("cost"))
    return F.array_sort(F.collect_list(of_kind("model", order)))


def report(priced: DataFrame, by: str = "daily") -> DataFrame:
    """One row for each bucket: token sums, cost (unpriced records ignored), and lists of models, projects and tools.

    ``models`` are short names by cost, dearest first; ``projects`` and ``tools`` are sorted. A bucket's row is made of one row for each of its models,
    projects and tools, never of their combinations.
    """
    rows = named_sums(priced, bucket(by).alias("bucket"), names=("model", "project", "provider"))
    out = rows.groupBy("bucket").agg(
        *[F.sum(of_kind("model", c)).alias(c) for c in TOKENS], F.sum(of_kind("model", "cost")).cast("double").alias("cost"), by_cost().alias("parts"),
        F.array_sort(F.collect_list(of_kind("project", "name"))).alias("projects"), F.array_sort(F.collect_list(of_kind("provider", "name"))).alias("tools"))
    models = F.transform("parts", lambda m: short_model(m["model"]))
    return out.select("bucket", *TOKENS, "cost", models.alias("models"), "projects", "tools").orderBy("bucket")


def totals(priced: DataFrame, by: str) -> DataFrame:
    """The report's numbers alone: one grouping with partial sums."""
    return priced.groupBy(bucket(by).alias("bucket")).agg(*sums(), cost_sum("ignore").alias("cost")).orderBy("bucket")


def breakdown(priced: DataFrame, by: str = "daily") -> DataFrame:
    """One row for each bucket and model, the dearest first within a bucket."""
    out = priced.groupBy(bucket(by).alias("bucket"), "model").agg(*sums(), cost_sum("ignore").alias("cost"))
    return out.orderBy("bucket", F.coalesce("cost", F.lit(0.0)).desc(), "model")


def with_total(priced: DataFrame, by: str = "daily") -> DataFrame:
    """The report's numbers and a row TOTAL over all buckets."""
    keyed = priced.withColumn("bucket", bucket(by))
    out = keyed.rollup("bucket").agg(*sums(), cost_sum("ignore").alias("cost"), F.grouping("bucket").alias("_total"))
    named = out.withColumn("bucket", F.when(F.col("_total") == 1, "TOTAL").otherwise(F.col("bucket")))
    return named.orderBy("_total", "bucket").drop("_total")


def count_records(usage: DataFrame) -> DataFrame:
    return usage.agg(F.count(F.lit(1)).alias("records"))

"""Reports as rows to show or to write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.functions.text import format_cost, format_duration, format_tokens, short_model, symbol, threshold_class
from usagelake.operators.cost import cost_sum
from usagelake.operators.reports import breakdown, bucket, by_cost, named_sums, of_kind, report, sums
from usagelake.schema import TOKENS

#: Columns of a table: name to show and the report's column.
COLUMNS = {"period": "bucket", "input": "input_tokens", "output": "output_tokens", "cache_write": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens",
           "cost": "cost", "models": "models", "projects": "projects", "tools": "tools"}
DEFAULT = [c for c in COLUMNS if c != "projects"]


def choose_columns(spec: list[str] | None) -> list[str]:
    """``+name`` adds to the default, ``-name`` takes away, plain names replace it."""
    if not spec:
        return DEFAULT
    if all(x[0] in "+-" for x in spec):
        chosen = [c for c in DEFAULT if f"-{c}" not in spec]
        return chosen + [x[1:] for x in spec if x[0] == "+" and x[1:] not in chosen]
    return [x for x in spec if x[0] not in "+-"]


def table_rows(priced: DataFrame, by: str = "daily", columns: list[str] | None = None, details: bool = False, code: str = "USD", rate: float = 1.0) -> DataFrame:
    """A report as texts: one row for each bucket, with ``details`` its models below it, the dearest first, and the row TOTAL.

    Lists stand in the buckets' rows only; an unknown column is empty under its own name.
    """
    lists = [F.array_join(c, ", ").alias(c) for c in ("models", "projects", "tools")]
    empty = [F.lit("").alias(c) for c in ("models", "projects", "tools")]
    place = lambda last, bucket_, detail, cost: [F.lit(last).alias("_last"), bucket_.alias("_bucket"), F.lit(detail).alias("_detail"), cost.alias("_cost")]
    none = F.lit(0.0)
    rows = report(priced, by).select("bucket", *TOKENS, "cost", *lists, *place(0, F.col("bucket"), 0, none))
    if details:
        below = breakdown(priced, by).select(F.concat(F.lit("  "), "model").alias("bucket"), *TOKENS, "cost", *empty, *place(0, F.col("bucket"), 1, -F.coalesce("cost", none)))
        rows = rows.unionByName(below)
    total = priced.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in TOKENS], cost_sum("ignore").alias("cost"))
    rows = rows.unionByName(total.select(F.lit("TOTAL").alias("bucket"), *TOKENS, "cost", *empty, *place(1, F.lit(""), 0, none)))

    def cell(name: str):
        source = COLUMNS.get(name)
        if source in TOKENS:
            return format_tokens(F.col(source)).alias(name)
        if name == "cost":
            return format_cost(F.col("cost") * rate, symbol(code)).alias(name)
        return (F.col(source) if source else F.lit("")).alias(name)

    return rows.orderBy("_last", "_bucket", "_detail", "_cost", "bucket").select(*[cell(c) for c in columns or DEFAULT])


def burn_rows(burn: DataFrame, code: str = "USD", rate: float = 1.0) -> DataFrame:
    """A burn report as texts; a rate that isn't known is a dash."""
    shown = lambda c, text: F.when(F.col(c).isNull(), "–").otherwise(text)
    money = lambda c: format_cost(F.col(c) * rate, symbol(code))
    return burn.select(
        short_model(F.col("model")).alias("model"), format_tokens(F.col("tokens")).alias("tokens"), money("cost").alias("cost"), format_duration(F.col("active_secs")).alias("active"),
        shown("tokens_per_min", format_tokens(F.round("tokens_per_min").cast("bigint"))).alias("tok/min"),
        shown("cost_per_active_hour", money("cost_per_active_hour")).alias("$/act-hr"), shown("cost_per_calendar_day", money("cost_per_calendar_day")).alias("$/cal-day"))


def json_burn(burn: DataFrame, code: str = "USD", rate: float = 1.0) -> DataFrame:
    """A burn report as it is written to JSON: full model names, converted costs and rates, nulls where they aren't known."""
    money = lambda c: (F.col(c) * rate).alias(c)
    return burn.select("model", "tokens", money("cost"), F.col("active_secs").alias("active_seconds"), "tokens_per_min", money("cost_per_active_hour"),
                       money("cost_per_calendar_day"), F.lit(code).alias("currency"))


def status_row(priced: DataFrame, template: str = "{cost}", warn: float | None = None, critical: float | None = None, label: str = "Today",
               code: str = "USD", rate: float = 1.0) -> DataFrame:
    """One row (text, tooltip, class, currency) over all records: the filled template, the cost and each model's below it, a class by thresholds.

    Usage without any price costs zero. Without records the text is a zero cost, whatever the template, and the tooltip "No usage".
    """
    rows = named_sums(priced, names=("model", "project"))
    row = rows.agg(F.coalesce(F.sum(of_kind("model", "n")), F.lit(0)).alias("n"), by_cost().alias("ms"), F.array_sort(F.collect_list(of_kind("project", "name"))).alias("ps"),
                   cost_sum("zero", of_kind("model", "cost")).alias("cost"), *[F.sum(of_kind("model", c)).alias(c) for c in TOKENS])
    cost, shown = F.col("cost") * rate, lambda c: format_cost(c, symbol(code))
    values = {"cost": shown(cost), "input": format_tokens(F.coalesce("input_tokens", F.lit(0))), "output": format_tokens(F.coalesce("output_tokens", F.lit(0))),
              "models": F.array_join(F.transform("ms", lambda m: short_model(m["model"])), ", "), "projects": F.array_join("ps", ", ")}
    text = F.lit(template)
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    below = F.transform("ms", lambda m: F.concat(F.lit("  "), short_model(m["model"]), F.lit(": "), shown(m["cost"] * rate)))
    tip = F.array_join(F.concat(F.array(F.concat(F.lit(f"{label}: "), shown(cost))), below), "\n")
    used = F.col("n") > 0
    return row.select(F.when(used, text).otherwise(shown(F.lit(0.0))).alias("text"), F.when(used, tip).otherwise("No usage").alias("tooltip"),
                      F.when(used, threshold_class(cost, warn, critical)).otherwise("normal").alias("class"), F.lit(code).alias("currency"))


def json_report(priced: DataFrame, by: str = "daily", rate: float = 1.0, code: str = "USD") -> DataFrame:
    """One nested row for each bucket, as it is written to JSON: sums, converted cost, short model names, projects, and details by model."""
    rows = breakdown(priced, by).withColumn("d", F.struct((-F.coalesce(F.col("cost"), F.lit(0.0))).alias("o"), "model", *TOKENS, (F.col("cost") * rate).alias("cost")))
    out = rows.groupBy("bucket").agg(*sums(), F.array_sort(F.collect_list("d")).alias("details"))
    exact = priced.groupBy(bucket(by).alias("bucket")).agg(cost_sum("ignore").alias("cost"), F.array_sort(F.collect_set("project")).alias("projects"))
    return out.join(exact, "bucket").select("bucket", F.lit(code).alias("currency"), *TOKENS, (F.col("cost") * rate).alias("cost"), F.transform("details", lambda d: short_model(d["model"])).alias("models"), "projects",
                                            F.transform("details", lambda d: d.dropFields("o")).alias("details")).orderBy("bucket")


def write_json(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)

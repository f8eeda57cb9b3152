"""Usage data derived from the given tables, as text that Spark and DuckDB both read; the seed of queries and oracles.

``{K}`` is the JSON field of an event, ``{TS:x}`` a timestamp without zone from seconds since 1970. All
derived rows grow with their table; the dimensions (prices, accounts, switches, rates) are small by nature.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

RAW = """
SELECT CASE CAST(base_id % 9 AS INT) WHEN 0 THEN 'codex' WHEN 1 THEN 'gemini' WHEN 2 THEN 'pi' WHEN 3 THEN 'amp' WHEN 4 THEN 'opencode' ELSE 'claude' END AS provider,
  concat('s', CAST(user_id % 4 AS VARCHAR(20))) AS session_id, ts AS ts, concat('proj-', CAST(user_id % 7 AS VARCHAR(20))) AS project,
  CASE event_type WHEN 'click' THEN 'claude-opus-4-5-20251101' WHEN 'view' THEN 'claude-sonnet-4-5-20250929' WHEN 'purchase' THEN 'claude-haiku-4-5-20251001'
    WHEN 'error' THEN 'mystery-model' ELSE 'gpt-5-codex' END AS model,
  concat('m', CAST(base_id AS VARCHAR(20))) AS message_id, concat('r', CAST(base_id % 1000 AS VARCHAR(20))) AS request_id,
  CAST(floor(value * 100.0) AS BIGINT) AS input_tokens, (event_id * 7919) % 4096 AS output_tokens, k * 10 AS cache_creation_input_tokens, k * 100 AS cache_read_input_tokens,
  CASE WHEN base_id % 9 >= 5 AND base_id % 3 = 0 THEN concat('org-', CAST(base_id % 4 AS VARCHAR(20))) END AS account_uuid, event_id AS seq
FROM (SELECT event_id, ts, user_id, event_type, value, event_id - (CASE WHEN event_id % 20 = 19 THEN 1 ELSE 0 END) AS base_id, CAST({K} AS BIGINT) AS k FROM __events__) b
"""

#: Snapshots of 40 organisations over six weeks, from orders; captured_at is unique.
SNAPSHOTS = """
SELECT concat('org-', CAST(o_custkey % 40 AS VARCHAR(20))) AS org_uuid,
  {TS:1706522400 - 604800 * (o_orderkey % 6) + o_orderkey % 50} AS cycle_end, CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS DOUBLE) AS utilization,
  {TS:1704067200 + o_orderkey} AS captured_at, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(o_orderkey % 97 AS DOUBLE) / 8 END AS cost_at_calibration,
  CASE CAST(o_orderkey % 7 AS INT) WHEN 0 THEN 'pro' WHEN 1 THEN NULL WHEN 2 THEN 'max5x' ELSE 'max20x' END AS plan
FROM __orders__
"""

#: The state of an organisation, from customers.
ORGS = """
SELECT concat('org-', CAST(c_custkey AS VARCHAR(20))) AS org_uuid, CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN 'pro' WHEN 1 THEN 'max5x' ELSE 'max20x' END AS plan,
  CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_custkey % 105 AS DOUBLE) END AS live_pct, CAST(c_custkey % 101 AS DOUBLE) AS utilization,
  CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE CAST(c_custkey % 13 AS DOUBLE) / 4 END AS cost_at_calibration, CAST(c_custkey % 37 AS DOUBLE) / 2 AS cost_now,
  CASE WHEN c_custkey % 2 = 0 THEN CAST(c_custkey % 60 AS DOUBLE) END AS opus_pct,
  {TS:1706522400 - 3600 * (c_custkey % 150)} AS start, {TS:1706522400 - 3600 * (c_custkey % 150) + 604800} AS "end",
  CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'max' WHEN 1 THEN 'pro' WHEN 2 THEN 'max' WHEN 3 THEN 'free' ELSE NULL END AS subscription_type,
  CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN 'default_claude_max_20x' WHEN 1 THEN 'default_claude_max_5x' WHEN 2 THEN '' ELSE NULL END AS rate_limit_tier,
  CASE CAST(c_custkey % 3 AS INT) WHEN 0 THEN NULL WHEN 1 THEN FALSE ELSE TRUE END AS enabled, c_custkey * 7 AS used_cents, c_custkey * 10 + 5 AS limit_cents
FROM __customer__
"""

PRICING = ("(VALUES ('claude-opus-4-5-20251101', 0.000005, 0.000025, 0.0000005, 0.00000625), ('claude-sonnet-4-5-20250929', 0.000003, 0.000015, 0.0000003, 0.00000375), "
           "('claude-haiku-4-5-20251001', 0.000001, 0.000005, 0.0000001, 0.00000125), ('gpt-5-codex', 0.00000125, 0.00001, 0.000000125, NULL)) AS v(model, a, b, c, d)")
PRICING = "SELECT model, " + ", ".join(f"CAST({x} AS DECIMAL(16,12)) AS {y}" for x, y in zip("abcd", ("i", "o", "cr", "cw"), strict=True)) + f" FROM {PRICING}"
SWITCHES = "SELECT * FROM (VALUES " + ", ".join(f"({{STAMP:{t}}}, '{o}', '{n}', {p})" for t, o, n, p in (
    ("2024-01-05 00:00:00", "org-0", "work", 1), ("2024-01-12 12:00:00", "org-1", "personal", 2), ("2024-01-20 00:00:00", "org-0", "work", 3),
    ("2024-01-20 00:00:00", "org-1", "personal", 4))) + ") AS v(at_ts, org, nm, pos)"
ACCOUNTS = "SELECT * FROM (VALUES ('work', 'org-0', 'max', 'default_claude_max_20x'), ('personal', 'org-1', 'pro', NULL)) AS v(name, org_uuid, subscription_type, rate_limit_tier)"
RATES = "SELECT * FROM (VALUES ('USD', '$', 1.0), ('EUR', 'E', 0.92), ('JPY', 'Y', 150.5)) AS v(code, symbol, rate)"
NOW = "2024-01-30 12:00:00"


def _macro(sql: str, name: str, made) -> str:
    return re.sub(r"\{" + name + r":([^{}]*)\}", lambda m: made(m[1]), sql)


def spark_text(sql: str) -> str:
    sql = _macro(sql.replace("{K}", "get_json_object(props, '$.k')"), "TS", lambda x: f"CAST(timestamp_seconds({x}) AS TIMESTAMP_NTZ)")
    return _macro(sql, "STAMP", lambda x: f"TIMESTAMP_NTZ '{x}'").replace('"end"', "`end`")


def duck_text(sql: str) -> str:
    sql = _macro(sql.replace("{K}", "json_extract_string(props, '$.k')"), "TS", lambda x: f"make_timestamp(CAST(({x}) * 1000000 AS BIGINT))")
    return re.sub(r"__(\w+?)__", r"\1", _macro(sql, "STAMP", lambda x: f"TIMESTAMP '{x}'"))


def _view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in re.findall(r"__(\w+?)__", sql)}
    return spark.sql(re.sub(r"__(\w+?)__", r"{\1}", spark_text(sql)), **tables)


def usage_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, RAW)


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, SNAPSHOTS)


def orgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, ORGS)


def pricing(spark: SparkSession) -> DataFrame:
    return spark.sql(PRICING)


def switch_log(spark: SparkSession) -> DataFrame:
    return spark.sql(spark_text(SWITCHES))


def accounts(spark: SparkSession) -> DataFrame:
    return spark.sql(ACCOUNTS)


def rates(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT code, symbol, CAST(rate AS DOUBLE) AS rate FROM (" + RATES + ")")

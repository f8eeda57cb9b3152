"""Registered queries of the usage operators and, for each, the same rows in SQL."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.functions import text as X
from usagelake.operators import attribution, burn, cost, cycles, filters, histogram, outputs, plans, reports
from usagelake.operators.dedup import dedup
from usagelake.plans import fixtures as fx
from usagelake.schema import TOKENS
from usagelake.sources import accounts as sa
from usagelake.sources import ingest, providers, storage
from usagelake.sources import pricing as sp
from usagelake.sources.jsonx import once
from usagelake.sources.table import KeyIndex, UsageTable
from usagelake.streaming import growing, live

NOW = fx.NOW
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

_TOK = ", ".join(TOKENS)
_SUMS = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in TOKENS)
_ALL = " + ".join(TOKENS)
_WITH = f"""WITH raw AS ({fx.duck_text(fx.RAW)}),
usage AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY provider, message_id, request_id, coalesce(account_uuid, '') ORDER BY ts, seq) AS rn FROM raw) t WHERE rn = 1),
pricing AS ({fx.duck_text(fx.PRICING)}),
priced AS (SELECT u.*, CAST(u.input_tokens AS DECIMAL(12,0)) * p.i + CAST(u.output_tokens AS DECIMAL(12,0)) * p.o
  + CAST(u.cache_read_input_tokens AS DECIMAL(12,0)) * coalesce(p.cr, CAST(0 AS DECIMAL(16,12)))
  + CAST(u.cache_creation_input_tokens AS DECIMAL(12,0)) * coalesce(p.cw, CAST(0 AS DECIMAL(16,12))) AS cost FROM usage u LEFT JOIN pricing p ON u.model = p.model),
switches AS ({fx.duck_text(fx.SWITCHES)}),
log AS (SELECT at_ts, org, nm FROM (SELECT *, row_number() OVER (PARTITION BY at_ts ORDER BY pos DESC) AS rn FROM switches) WHERE rn = 1),
accounts AS ({fx.ACCOUNTS}),
named AS (SELECT u.*, l.org AS log_org, l.nm AS log_name, a.name AS account_name FROM usage u ASOF LEFT JOIN log l ON u.ts >= l.at_ts LEFT JOIN accounts a ON u.account_uuid = a.org_uuid),
snaps AS ({fx.duck_text(fx.SNAPSHOTS)}), orgs AS ({fx.duck_text(fx.ORGS)}),
units(plan, u, price, higher, lower) AS (VALUES ('pro', 1.0, 20.0, 'max5x', NULL), ('max5x', 5.0, 100.0, 'max20x', 'pro'), ('max20x', 20.0, 200.0, NULL, 'max5x'))
"""


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = _WITH + sql
        return f

    return add


def _usage(s: SparkSession, d: str) -> DataFrame:
    return dedup(fx.usage_raw(s, d))


def _priced(s: SparkSession, d: str) -> DataFrame:
    return cost.price(_usage(s, d), fx.pricing(s))


def _seqs(df: DataFrame) -> DataFrame:
    return df.select("seq", "provider", "project", "ts")


@query(f"SELECT provider, session_id, ts, project, model, message_id, request_id, {_TOK}, account_uuid, seq FROM usage")
def usage_dedup(s, d):
    return _usage(s, d)


@query("SELECT seq, model, CAST(cost AS DOUBLE) AS cost FROM priced")
def priced_records(s, d):
    return _priced(s, d).select("seq", "model", F.col("cost").cast("double").alias("cost"))


@query("SELECT DISTINCT model FROM usage WHERE model NOT IN (SELECT model FROM pricing)")
def unpriced_models(s, d):
    return cost.unpriced_models(_usage(s, d), fx.pricing(s))


_KEYS = {"daily": "strftime(ts, '%Y-%m-%d')", "monthly": "strftime(ts, '%Y-%m')", "session": "concat(project, ' | ', session_id)", "model": "model", "all": "'bar'"}


def _report_sql(by: str) -> str:
    return f""", k AS (SELECT *, {_KEYS[by]} AS bucket FROM priced),
m AS (SELECT bucket, model, coalesce(sum(cost), 0) AS c FROM k GROUP BY 1, 2),
ml AS (SELECT bucket, string_agg(regexp_replace(regexp_replace(model, '^claude-', ''), '^(.+)-[0-9]{{8}}$', '\\1'), ',' ORDER BY c DESC, model) AS models FROM m GROUP BY 1)
SELECT k.bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost, any_value(models) AS models, string_agg(DISTINCT project, ',' ORDER BY project) AS projects,
  string_agg(DISTINCT provider, ',' ORDER BY provider) AS tools FROM k JOIN ml ON k.bucket = ml.bucket GROUP BY k.bucket"""


def _report(by: str):
    def run(s, d):
        out = reports.report(_priced(s, d), by)
        return out.select("bucket", *TOKENS, "cost", *[F.array_join(c, ",").alias(c) for c in ("models", "projects", "tools")])

    run.__name__ = f"report_{by}"
    return run


for _by in _KEYS:
    query(_report_sql(_by))(_report(_by))


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS bucket, model, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1, 2")
def report_breakdown(s, d):
    return reports.breakdown(_priced(s, d), "daily")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1")
def report_totals(s, d):
    return reports.totals(_priced(s, d), "daily")


@query(f"SELECT coalesce(b, 'TOTAL') AS bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM (SELECT *, strftime(ts, '%Y-%m-%d') AS b FROM priced) GROUP BY GROUPING SETS ((b), ())")
def report_total(s, d):
    return reports.with_total(_priced(s, d), "daily")


@query("SELECT provider, CAST(sum(cost) AS DOUBLE) AS ignore_cost, CASE WHEN count(*) = count(cost) THEN CAST(sum(cost) AS DOUBLE) END AS poison_cost, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS zero_cost FROM priced GROUP BY 1")
def cost_rules(s, d):
    return _priced(s, d).groupBy("provider").agg(*[cost.cost_sum(r).alias(f"{r}_cost") for r in ("ignore", "poison", "zero")])


@query("SELECT count(*) AS records FROM usage")
def count_records(s, d):
    return reports.count_records(_usage(s, d))


@query("SELECT seq, provider, project, ts FROM usage WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-03' AND DATE '2024-01-17'")
def filter_range(s, d):
    return _seqs(filters.in_range(_usage(s, d), "2024-01-03", "2024-01-17"))


@query("SELECT seq, provider, project, ts FROM usage WHERE contains(lower(project), 'oj-3')")
def filter_project(s, d):
    return _seqs(filters.by_project(_usage(s, d), "OJ-3"))


@query("SELECT seq, provider, project, ts FROM usage WHERE provider = 'gemini'")
def filter_tool(s, d):
    return _seqs(filters.by_tool(_usage(s, d), "Gemini"))


@query("SELECT seq, provider, project, ts FROM usage WHERE FALSE")
def filter_tool_unknown(s, d):
    return _seqs(filters.by_tool(_usage(s, d), "nothing"))


@query("SELECT seq, provider, project, ts FROM named WHERE provider = 'claude' AND coalesce(account_name, log_name) = 'work'")
def filter_account(s, d):
    return _seqs(filters.by_account(_usage(s, d), fx.accounts(s), fx.switch_log(s), "work"))


@query("SELECT seq, provider, project, ts FROM named WHERE provider = 'claude' AND CASE WHEN account_uuid IS NOT NULL THEN account_name ELSE log_name END = 'work'")
def filter_account_strict(s, d):
    return _seqs(filters.by_account(_usage(s, d), fx.accounts(s), fx.switch_log(s), "work", strict_uuid=True))


@query("SELECT seq, provider, project, ts FROM named WHERE provider = 'claude' AND coalesce(account_uuid, log_org) = 'org-1'")
def filter_org(s, d):
    return _seqs(filters.by_org(_usage(s, d), fx.switch_log(s), "org-1"))


@query("SELECT seq, log_org, log_name FROM named")
def asof_account(s, d):
    return attribution.account_name_at(_usage(s, d), fx.switch_log(s)).select("seq", "log_org", "log_name")


@query("SELECT seq, log_org, log_name FROM named")
def asof_account_merged(s, d):
    return attribution.account_name_at(_usage(s, d), fx.switch_log(s), broadcast=False).select("seq", "log_org", "log_name")


@query("SELECT seq, CASE WHEN provider = 'claude' THEN coalesce(log_org, 'org-9') END AS account_uuid FROM named")
def tag_account(s, d):
    return attribution.tag_account(_usage(s, d), fx.switch_log(s), "org-9").select("seq", "account_uuid")


@query("SELECT min(ts) AS at_ts, 'org-0' AS org, 'default' AS nm, 'bootstrap' AS source FROM usage WHERE provider = 'claude'")
def bootstrap_switch(s, d):
    return attribution.bootstrap_switch_log(_usage(s, d), "org-0", NOW)


_SEC = "CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)"


def _burn_sql(key: str, group: str) -> str:
    return f""", g AS (SELECT *, CASE WHEN lag({_SEC}) OVER w IS NOT NULL THEN least({_SEC} - lag({_SEC}) OVER w, 300) END AS gap, {key} AS k FROM priced WINDOW w AS (PARTITION BY {group} ORDER BY {_SEC})),
b AS (SELECT k AS model, CAST(sum({_ALL}) AS BIGINT) AS tokens, CASE WHEN count(*) = count(cost) THEN CAST(sum(cost) AS DOUBLE) END AS cost,
  CAST(coalesce(sum(gap), 0) AS BIGINT) AS active_secs, count(DISTINCT CAST(ts AS DATE)) AS calendar_days FROM g GROUP BY k)
SELECT *, CASE WHEN active_secs > 0 THEN CAST(tokens AS DOUBLE) / (active_secs / 60.0) END AS tokens_per_min, CASE WHEN active_secs > 0 THEN cost / (active_secs / 3600.0) END AS cost_per_active_hour,
  cost / calendar_days AS cost_per_calendar_day FROM b"""


@query(_burn_sql("model", "model, session_id"))
def burn_models(s, d):
    return burn.burn_models(_priced(s, d))


@query(_burn_sql("'ALL'", "session_id"))
def burn_all(s, d):
    return burn.burn_all(_priced(s, d))


@query(f""", g AS (SELECT project, session_id, CASE WHEN lag({_SEC}) OVER w IS NOT NULL THEN least({_SEC} - lag({_SEC}) OVER w, 600) END AS gap FROM usage WINDOW w AS (PARTITION BY project, session_id ORDER BY {_SEC}))
SELECT project, session_id, CAST(coalesce(sum(gap), 0) AS BIGINT) AS active_secs FROM g GROUP BY 1, 2""")
def active_secs(s, d):
    return burn.active_secs(_usage(s, d), ["project", "session_id"], 600)


@query("SELECT model, count(DISTINCT CAST(ts + INTERVAL 9 HOUR AS DATE)) AS calendar_days FROM usage GROUP BY 1")
def local_days(s, d):
    return burn.local_days(_usage(s, d), ["model"], "Asia/Tokyo")


def _histogram(name: str, period: str, relative: bool, start: str, width: str, kept: int, label: str):
    sql = f""", e AS (SELECT CAST(i AS INT) AS bucket, TIMESTAMP '{start}' + i * INTERVAL {width} AS start FROM range({kept}) t(i)),
v AS (SELECT greatest(CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{start}')) / (epoch_us(TIMESTAMP '{start}' + INTERVAL {width}) - epoch_us(TIMESTAMP '{start}'))) AS INT), 0) AS bucket, {_ALL} AS t FROM usage)
SELECT e.bucket, start, {label} AS label, CAST(coalesce(sum(t), 0) AS BIGINT) AS tokens FROM e LEFT JOIN v ON e.bucket = v.bucket GROUP BY ALL"""

    def run(s, d):
        return histogram.histogram(_usage(s, d), period, dt.datetime.fromisoformat(NOW), relative=relative)

    run.__name__ = name
    query(sql)(run)


_histogram("histogram_1d", "1d", False, "2024-01-29 12:00:00", "30 MINUTE", 48, "CASE WHEN minute(start) = 0 THEN strftime(start, '%H') ELSE '' END")
_histogram("histogram_1w", "1w", False, "2024-01-23 00:00:00", "6 HOUR", 28, "CASE WHEN hour(start) = 0 THEN strftime(start, '%a') ELSE '' END")
_histogram("histogram_1m", "1m", False, "2024-01-01 00:00:00", "1 DAY", 29, "CASE WHEN day(start) = 1 OR e.bucket = 0 THEN strftime(start, '%b %-d') ELSE strftime(start, '%-d') END")
_histogram("histogram_relative", "1w", True, "2024-01-23 12:00:00", "6 HOUR", 28, "CASE WHEN hour(start) = 0 THEN strftime(start, '%a') ELSE '' END")


@query("SELECT seq, CAST(cost AS DOUBLE) * 0.92::DOUBLE AS cost, 'EUR' AS currency FROM priced")
def currency_convert(s, d):
    return cost.convert(_priced(s, d), fx.rates(s), "eur").select("seq", "cost", "currency")


@query("SELECT seq, CAST(cost AS DOUBLE) AS cost, 'USD' AS currency FROM priced")
def currency_fallback(s, d):
    return cost.convert(_priced(s, d), fx.rates(s), "xxx").select("seq", "cost", "currency")


@query("SELECT DISTINCT model, regexp_replace(regexp_replace(model, '^claude-', ''), '^(.+)-[0-9]{8}$', '\\1') AS short FROM usage")
def short_model(s, d):
    return _usage(s, d).select("model").distinct().select("model", X.short_model(F.col("model")).alias("short"))


@query("SELECT seq, concat('claude-', seq % 10, '-5-x') AS model FROM usage")
def droid_model(s, d):
    name = F.concat(F.lit("custom:Claude-"), (F.col("seq") % 10).cast("string"), F.lit(".5.-[Vendor]X-"))
    return _usage(s, d).select("seq", X.droid_model(name).alias("model"))


@query("SELECT seq, CASE CAST(seq % 4 AS INT) WHEN 0 THEN concat('app-', project) WHEN 1 THEN concat('x-', project) WHEN 2 THEN concat('y-', project) ELSE concat('z', seq) END AS project FROM usage")
def claude_project(s, d):
    p, n = F.col("project"), F.col("seq") % 4
    folder = F.when(n == 0, F.concat(F.lit("-home-u-git-app-"), p)).when(n == 1, F.concat(F.lit("-home-u-code-x-"), p)).when(n == 2, F.concat(F.lit("-home-u-y-"), p)).otherwise(F.concat(F.lit("-opt-z"), F.col("seq").cast("string")))
    return _usage(s, d).select("seq", X.claude_project(folder).alias("project"))


@query("""SELECT seq, CASE WHEN s >= 3600 THEN printf('%dh%02dm', s // 3600, s % 3600 // 60) ELSE printf('%dm', s // 60) END AS duration, substr(model, 1, 8) AS org
FROM (SELECT seq, output_tokens * 3 AS s, model FROM usage)""")
def format_durations(s, d):
    return _usage(s, d).select("seq", X.format_duration(F.col("output_tokens") * 3).alias("duration"), X.short_org(F.col("model")).alias("org"))


def _tok(n: str) -> str:
    """A number of tokens as text, halves up, in whole numbers."""
    return (f"CASE WHEN {n} >= 1000000 THEN printf('%d.%dM', ({n} + 50000) // 1000000, ({n} + 50000) // 100000 % 10) "
            f"WHEN {n} >= 1000 THEN printf('%d.%dK', ({n} + 50) // 1000, ({n} + 50) // 100 % 10) ELSE CAST({n} AS VARCHAR) END")


def _money(c: str, sign: str = "$") -> str:
    return f"CASE WHEN {c} IS NULL THEN 'N/A' ELSE concat('{sign}', printf('%.2f', {c})) END"


@query(f"SELECT seq, {_tok('n')} AS tokens FROM (SELECT seq, CAST({_ALL} AS BIGINT) * 37 AS n FROM usage)")
def format_tokens(s, d):
    return _usage(s, d).select("seq", X.format_tokens(burn.record_tokens() * 37).alias("tokens"))


# ---- ingestion: usage rows are rendered to each tool's lines and read back ----


def _lines(u: DataFrame, path, value) -> DataFrame:
    lines = u.select(path.alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), F.col("seq").alias("line_id"), F.col("ts").cast("timestamp").alias("mtime"), F.lit(1000).cast("bigint").alias("size"), value.alias("_text"))
    return once(lines, "value", F.col("_text")).drop("_text")


def _iso(c: str = "ts"):
    return F.concat(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


_OUT = ("seq", "session_id", "ts", "project", "model", *TOKENS)


def _read(df: DataFrame) -> DataFrame:
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz")).select(*_OUT)


def _ingest_sql(session="session_id", ts="ts", project="project", model="model", tokens=_TOK, where="TRUE") -> str:
    return f"SELECT seq, {session} AS session_id, {ts} AS ts, {project} AS project, {model} AS model, {tokens} FROM raw WHERE {where}"


_NOT_EMPTY = "input_tokens + output_tokens > 0"
#: Times as the composite ids have them: without a point where there are no parts of a second.
_STAMP = "regexp_replace(regexp_replace(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), '0+$', ''), '[.]$', '')"
_STAMP_S = "strftime(ts, '%Y-%m-%d %H:%M:%S')"


@query(_ingest_sql(where="model <> 'gpt-5-codex'"))
def ingest_claude(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct(*TOKENS)
    own = F.to_json(F.struct(F.lit("assistant").alias("type"), _iso().alias("timestamp"), F.col("request_id").alias("requestId"), F.concat(F.lit("/home/u/"), "project").alias("cwd"),
                             F.struct(F.col("message_id").alias("id"), F.when(F.col("model") == "gpt-5-codex", "<synthetic>").otherwise(F.col("model")).alias("model"), use.alias("usage")).alias("message")))
    agent = F.to_json(F.struct(F.lit("progress").alias("type"), F.concat(F.lit("/home/u/"), "project").alias("cwd"), F.struct(F.lit("agent_progress").alias("type"), F.struct(
        _iso().alias("timestamp"), F.col("request_id").alias("requestId"), F.struct(F.col("message_id").alias("id"), F.when(F.col("model") == "gpt-5-codex", "<synthetic>").otherwise(F.col("model")).alias("model"), use.alias("usage")).alias("message")).alias("message")).alias("data")))
    path = F.concat(F.lit("/l/projects/-home-u-git-x/"), "session_id", F.lit(".jsonl"))
    return _read(providers.extract_claude(_lines(u, path, F.when(F.col("seq") % 3 == 0, agent).otherwise(own))))


@query(_ingest_sql(tokens="input_tokens, output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, cache_read_input_tokens", session="concat(project, '/', session_id)",
                   model="concat('m-', session_id)", where="input_tokens + output_tokens + cache_read_input_tokens > 0"))
def ingest_codex(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct("input_tokens", "output_tokens", F.col("cache_read_input_tokens").alias("cached_input_tokens"))
    value = F.to_json(F.struct(_iso().alias("timestamp"), F.lit("event_msg").alias("type"), F.struct(F.lit("token_count").alias("type"), F.struct(use.alias("last_token_usage")).alias("info")).alias("payload")))
    path = F.concat(F.lit("/l/sessions/"), "project", F.lit("/"), "session_id", F.lit(".jsonl"))
    events = _lines(u, path, value)
    first = u.groupBy("project", "session_id").agg(F.min("ts").alias("ts")).withColumn("seq", F.lit(-1).cast("bigint"))
    turns = _lines(first, path, F.concat(F.lit('{"type":"turn_context","payload":{"model":"m-'), "session_id", F.lit('"}}')))
    return _read(providers.extract_codex(events.unionByName(turns)))


@query(f""", o AS (SELECT *, sum(input_tokens) OVER w AS a, sum(output_tokens) OVER w AS b FROM raw WINDOW w AS (PARTITION BY project, session_id ORDER BY seq))
SELECT seq, concat(project, '/', session_id) AS session_id, ts, project, 'unknown' AS model, input_tokens, output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, CAST(0 AS BIGINT) AS cache_read_input_tokens
FROM o WHERE {_NOT_EMPTY}""")
def ingest_codex_totals(s, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("project", "session_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    u = fx.usage_raw(s, d).withColumns({"a": F.sum("input_tokens").over(w), "b": F.sum("output_tokens").over(w)})
    total = F.struct(F.col("a").alias("input_tokens"), F.col("b").alias("output_tokens"))
    value = F.to_json(F.struct(_iso().alias("timestamp"), F.struct(F.lit("token_count").alias("type"), F.struct(total.alias("total_token_usage")).alias("info")).alias("payload")))
    path = F.concat(F.lit("/l/sessions/"), "project", F.lit("/"), "session_id", F.lit(".jsonl"))
    return _read(providers.extract_codex(_lines(u, path, value)))


@query(_ingest_sql())
def ingest_pi(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct(*[F.col(c).alias(n) for c, n in zip(TOKENS, ("input", "output", "cacheWrite", "cacheRead"), strict=True)])
    value = F.to_json(F.struct(_iso().alias("timestamp"), F.struct(F.lit("assistant").alias("role"), "model", use.alias("usage")).alias("message")))
    return _read(providers.extract_pi(_lines(u, F.concat(F.lit("/l/sessions/"), "project", F.lit("/2024_"), "session_id", F.lit(".jsonl")), value)))


@query("SELECT message_id, session_id, ts, model, CAST(input_tokens AS BIGINT) AS input_tokens, output_tokens, cache_creation_input_tokens, cache_read_input_tokens FROM raw")
def ingest_amp(s, d):
    u = fx.usage_raw(s, d).withColumn("doc", F.concat_ws("-", "session_id", F.date_format("ts", "yyyyMMddHHmm")))
    event = F.struct(F.col("message_id").alias("id"), _iso().alias("timestamp"), "model", F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output")).alias("tokens"), F.col("seq").alias("toMessageId"))
    message = F.struct(F.lit("assistant").alias("role"), F.col("seq").alias("messageId"), F.struct(F.col("cache_creation_input_tokens").alias("cacheCreationInputTokens"), F.col("cache_read_input_tokens").alias("cacheReadInputTokens")).alias("usage"))
    docs = u.groupBy("doc", "session_id").agg(F.collect_list(event).alias("e"), F.collect_list(message).alias("m"), F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    value = F.to_json(F.struct(F.col("session_id").alias("id"), F.col("m").alias("messages"), F.struct(F.col("e").alias("events")).alias("usageLedger")))
    out = providers.extract_amp(_lines(docs, F.col("doc"), value))
    return out.select("message_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "model", *TOKENS)


def _opencode_value(role: bool = False):
    cache = F.struct(F.col("cache_read_input_tokens").alias("read"), F.col("cache_creation_input_tokens").alias("write"))
    return F.to_json(F.struct(F.col("seq").cast("string").alias("id"), F.col("session_id").alias("sessionID"), F.lit("x").alias("providerID"), F.col("model").alias("modelID"), F.lit("assistant").alias("role"),
                              F.struct(F.unix_millis(F.col("ts").cast("timestamp")).alias("created")).alias("time"), F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), cache.alias("cache")).alias("tokens")))


_MILLIS = "make_timestamp(CAST(floor(epoch_us(ts) / 1000) AS BIGINT) * 1000)"


@query(_ingest_sql(ts=_MILLIS, project="CASE session_id WHEN 's3' THEN 'opencode' ELSE concat('app-', session_id) END", where=_NOT_EMPTY))
def ingest_opencode(s, d):
    u = fx.usage_raw(s, d)
    messages = _lines(u, F.concat(F.lit("/storage/message/"), F.col("seq").cast("string"), F.lit(".json")), _opencode_value())
    sessions = u.filter("session_id <> 's3'").groupBy("session_id").agg(F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    value = F.to_json(F.struct(F.col("session_id").alias("id"), F.concat(F.lit("/home/u/app-"), "session_id").alias("directory")))
    return _read(providers.extract_opencode(messages, _lines(sessions, F.concat(F.lit("/storage/session/"), "session_id"), value)))


@query(_ingest_sql(ts=_MILLIS, project="CASE session_id WHEN 's3' THEN 'opencode' ELSE concat('app-', session_id) END", where=_NOT_EMPTY + " AND seq % 3 <> 1"))
def ingest_opencode_files(s, d):
    u = fx.usage_raw(s, d)
    # A third of the messages lies elsewhere; a part named message further up doesn't count below one named session.
    place = F.when(F.col("seq") % 3 == 0, "/storage/session/message/").when(F.col("seq") % 3 == 1, "/storage/part/").otherwise("/storage/message/")
    messages = _lines(u, F.concat(place, "session_id", F.lit("/"), F.col("seq").cast("string"), F.lit(".json")), _opencode_value())
    sessions = u.filter("session_id <> 's3'").groupBy("session_id").agg(F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    value = F.to_json(F.struct(F.col("session_id").alias("id"), F.concat(F.lit("/home/u/app-"), "session_id").alias("directory")))
    files = messages.unionByName(_lines(sessions, F.concat(F.lit("/message/session/p/"), "session_id", F.lit(".json")), value))
    return _read(providers.extract_opencode_files(files))


@query(f"SELECT CAST(seq AS VARCHAR) AS message_id, session_id, {_MILLIS} AS ts, model, {_TOK} FROM raw WHERE {_NOT_EMPTY} AND seq % 3 <> 0")
def ingest_opencode_table(s, d):
    u = fx.usage_raw(s, d)
    table = providers.extract_opencode_table(u.filter("seq % 3 <> 0").select(F.col("seq").cast("string").alias("id"), "session_id", _opencode_value().alias("data")))
    return table.select("message_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "model", *TOKENS)


@query("SELECT seq, provider, project, ts FROM usage WHERE message_id NOT IN (SELECT message_id FROM usage WHERE seq % 3 = 0)")
def drop_known(s, d):
    u = _usage(s, d)
    return _seqs(ingest.drop_known(u, u.filter("seq % 3 = 0")))


@query(f"SELECT concat('gemini:', session_id, ':', seq) AS message_id, session_id, ts, 'h' AS project, model, input_tokens, output_tokens, CAST(0 AS BIGINT) AS cache_creation_input_tokens, cache_read_input_tokens FROM raw WHERE {_NOT_EMPTY}")
def ingest_gemini(s, d):
    u = fx.usage_raw(s, d).withColumn("doc", F.concat_ws("-", "session_id", F.date_format("ts", "yyyyMMddHHmm")))
    message = F.struct(F.col("seq").cast("string").alias("id"), F.lit("gemini").alias("type"), "model", _iso().alias("timestamp"), F.struct(F.col("input_tokens").alias("input"), F.col("output_tokens").alias("output"), F.col("cache_read_input_tokens").alias("cached")).alias("tokens"))
    docs = u.groupBy("doc", "session_id").agg(F.collect_list(message).alias("m"), F.min("ts").alias("ts"), F.min("seq").alias("seq"))
    out = providers.extract_gemini(_lines(docs, F.col("doc"), F.to_json(F.struct(F.col("session_id").alias("sessionId"), F.lit("h").alias("projectHash"), F.col("m").alias("messages")))))
    return out.select("message_id", "session_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "project", "model", *TOKENS)


@query(_ingest_sql(session="concat('d', seq)", project="'droid'", model="concat('x-', replace(model, 'claude', 'c'))", where=_NOT_EMPTY))
def ingest_droid(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct(*[F.col(c).alias(n) for c, n in zip(TOKENS, ("inputTokens", "outputTokens", "cacheCreationTokens", "cacheReadTokens"), strict=True)])
    name = F.concat(F.lit("custom:X."), F.replace("model", F.lit("claude"), F.lit("C")), F.lit("-[v]"))
    value = F.to_json(F.struct(name.alias("model"), F.when(F.col("seq") % 2 == 0, _iso()).alias("providerLockTimestamp"), use.alias("tokenUsage")))
    return _read(providers.extract_droid(_lines(u, F.concat(F.lit("/s/d"), F.col("seq").cast("string"), F.lit(".settings.json")), value)))


@query(_ingest_sql(ts=_MILLIS, model="concat('m-', session_id)", where=_NOT_EMPTY))
def ingest_openclaw(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct(*[F.col(c).alias(n) for c, n in zip(TOKENS, ("input", "output", "cacheWrite", "cacheRead"), strict=True)])
    value = F.to_json(F.struct(F.lit("message").alias("type"), F.struct(F.lit("assistant").alias("role"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp"), use.alias("usage")).alias("message")))
    path = F.concat(F.lit("/l/agents/"), "project", F.lit("/"), "session_id", F.lit(".jsonl"))
    first = u.groupBy("project", "session_id").agg(F.min("ts").alias("ts")).withColumn("seq", F.lit(-1).cast("bigint"))
    changes = _lines(first, path, F.concat(F.lit('{"type":"model_change","model":"m-'), "session_id", F.lit('"}')))
    return _read(providers.extract_openclaw(_lines(u, path, value).unionByName(changes)))


@query(_ingest_sql(ts="make_timestamp(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) * 1000000)", model="CASE WHEN seq % 2 = 0 THEN model ELSE 'k-default' END", where=_NOT_EMPTY))
def ingest_kimi(s, d):
    u = fx.usage_raw(s, d)
    use = F.struct(*[F.col(c).alias(n) for c, n in zip(TOKENS, ("input_other", "output", "input_cache_creation", "input_cache_read"), strict=True)])
    value = F.to_json(F.struct(F.when(F.col("seq") % 2 == 0, F.col("model")).alias("model"), F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"),
                               F.struct(F.lit("StatusUpdate").alias("type"), F.struct(F.col("message_id").alias("message_id"), use.alias("token_usage")).alias("payload")).alias("message")))
    return _read(providers.extract_kimi(_lines(u, F.concat(F.lit("/s/"), "project", F.lit("/"), "session_id", F.lit("/wire.jsonl")), value), "k-default"))


@query("SELECT provider, count(*) AS n FROM usage WHERE provider IN ('pi', 'claude') GROUP BY 1")
def unify(s, d):
    u = _usage(s, d)
    return ingest.unify(filters.by_tool(u, "pi"), filters.by_tool(u, "claude")).groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(text, 'the')")
def guarded_lines(s, d):
    c = s.read.parquet(f"{d}/conversations.parquet")
    return ingest.guarded(c.select("conv_id", "turn", F.lit(10).alias("size"), F.col("text").alias("value")), "the").select("conv_id", "turn")


@query(f"SELECT message_id, seq AS output_tokens, ts, model, input_tokens FROM raw WHERE provider <> 'amp' AND model <> 'gpt-5-codex'")
def ingest_files(s, d):
    """Log files in folders of their own: found, read by their lines and extracted; files of another kind are left alone."""
    base = f"{storage.shared_folder(s)}/logs-{uuid.uuid4().hex}"
    u = fx.usage_raw(s, d)
    use = F.struct("input_tokens", F.col("seq").alias("output_tokens"))
    model = F.when(F.col("model") == "gpt-5-codex", "<synthetic>").otherwise(F.col("model"))
    value = F.to_json(F.struct(F.lit("assistant").alias("type"), _iso().alias("timestamp"), F.struct(F.col("message_id").alias("id"), model.alias("model"), use.alias("usage")).alias("message")))
    lines = u.select("provider", "project", value.alias("value"))
    lines.filter("provider <> 'amp'").write.partitionBy("provider", "project").text(f"{base}/logs")
    lines.filter("provider = 'amp'").select("value").write.option("compression", "gzip").text(f"{base}/logs/other")
    found = providers.extract_claude(ingest.read_lines(s, [f"{base}/logs"], "*.txt"))
    return found.select("message_id", "output_tokens", F.col("ts").cast("timestamp_ntz").alias("ts"), "model", "input_tokens")


_LISTING = ", listing AS (SELECT provider, concat(provider, '/', session_id, '/', strftime(ts, '%Y%m%d')) AS path, max(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT)) AS mtime, count(*) AS size FROM usage GROUP BY 1, 2)"
_MANIFEST = _LISTING + """, manifest AS (SELECT provider, path, CASE WHEN size % 3 = 0 THEN mtime - 1 ELSE mtime END AS mtime, size FROM listing WHERE mtime % 5 <> 0),
changed AS (SELECT l.* FROM listing l LEFT JOIN manifest m USING (provider, path, mtime, size) WHERE m.path IS NULL)"""
_MANIFEST = _MANIFEST.replace("SELECT l.* FROM listing l LEFT JOIN manifest m USING (provider, path, mtime, size) WHERE m.path IS NULL",
                              "SELECT * FROM listing l WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.provider = l.provider AND m.path = l.path AND m.mtime = l.mtime AND m.size = l.size)")


def _files(s, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = _usage(s, d).withColumn("source_file", F.concat_ws("/", "provider", "session_id", F.date_format("ts", "yyyyMMdd")))
    listing = u.groupBy("provider", F.col("source_file").alias("path")).agg(F.max(burn.seconds(F.col("ts"))).alias("mtime"), F.count(F.lit(1)).alias("size"))
    manifest = listing.filter("mtime % 5 <> 0").withColumn("mtime", F.when(F.col("size") % 3 == 0, F.col("mtime") - 1).otherwise(F.col("mtime")))
    return u, listing, manifest


@query(_MANIFEST + " SELECT provider, path, mtime, size FROM changed")
def manifest_plan(s, d):
    _, listing, manifest = _files(s, d)
    return ingest.plan_ingest(listing, manifest).select("provider", "path", "mtime", "size")


@query(_MANIFEST + " SELECT u.seq, CASE WHEN c.path IS NULL THEN 'old' ELSE 'new' END AS version FROM usage u LEFT JOIN changed c ON c.path = concat(u.provider, '/', u.session_id, '/', strftime(u.ts, '%Y%m%d'))")
def manifest_merge(s, d):
    u, listing, manifest = _files(s, d)
    changed = ingest.plan_ingest(listing, manifest)
    new = u.join(changed.select("provider", F.col("path").alias("source_file")), ["provider", "source_file"], "left_semi")
    names = ["seq", "provider", "source_file", "version"]
    return ingest.merge_ingest(u.withColumn("version", F.lit("old")).select(*names), new.withColumn("version", F.lit("new")).select(*names), changed).select("seq", "version")


@query(_LISTING + " SELECT u.seq FROM usage u JOIN listing l ON l.path = concat(u.provider, '/', u.session_id, '/', strftime(u.ts, '%Y%m%d')) WHERE l.size % 2 = 0")
def manifest_prune(s, d):
    u, listing, _ = _files(s, d)
    return ingest.prune(u, listing.filter("size % 2 = 0")).select("seq")


# ---- price lists and payloads, rendered from parts and customers ----


def _parts(s, d) -> DataFrame:
    return s.read.parquet(f"{d}/part.parquet").select("p_partkey", (F.col("p_size") * F.lit(1e-6)).alias("a"), (F.col("p_size") * F.lit(2e-6)).alias("b"), "p_size", F.floor(F.col("p_partkey") / 50).alias("g"))


@query("""SELECT concat(prefix, 'm', p_partkey, suffix) AS model, CAST(CAST(p_size AS DECIMAL(8,0)) / 1000000 AS DOUBLE) AS i, CAST(CAST(p_size AS DECIMAL(8,0)) / 500000 AS DOUBLE) AS o
FROM part, (VALUES ('us.anthropic.', '-v1:0'), ('', '-v1:0'), ('', '')) v(prefix, suffix)""")
def pricing_litellm(s, d):
    entry = F.struct(F.concat(F.lit("us.anthropic.m"), F.col("p_partkey").cast("string"), F.lit("-v1:0")).alias("key"), F.struct(F.col("a").alias("input_cost_per_token"), F.col("b").alias("output_cost_per_token")).alias("value"))
    docs = _parts(s, d).groupBy("g").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    return sp.pricing(docs, "litellm").select("model", F.col("i").cast("double").alias("i"), F.col("o").cast("double").alias("o"))


@query("SELECT concat(prefix, 'm', p_partkey) AS model, CAST(CAST(p_size AS DECIMAL(8,0)) / 1000000 AS DOUBLE) AS i FROM part, (VALUES ('a/'), ('')) v(prefix)")
def pricing_openrouter(s, d):
    price = F.concat(F.lit("0."), F.lpad(F.col("p_size").cast("string"), 6, "0"))
    entry = F.struct(F.concat(F.lit("a/m"), F.col("p_partkey").cast("string")).alias("id"), F.struct(price.alias("prompt"), price.alias("completion")).alias("pricing"))
    docs = _parts(s, d).groupBy("g").agg(F.to_json(F.struct(F.collect_list(entry).alias("data"))).alias("value"))
    return sp.pricing(docs, "openrouter").select("model", F.col("i").cast("double").alias("i"))


@query("SELECT concat('m', p_partkey) AS model, CAST(CAST(p_size AS DECIMAL(8,0)) / 1000000 AS DOUBLE) AS i, CAST(CAST(p_size AS DECIMAL(8,0)) / 8000000 AS DOUBLE) AS cr FROM part")
def pricing_llmprices(s, d):
    n = F.col("p_size").cast("double")
    entry = F.struct(F.concat(F.lit("m"), F.col("p_partkey").cast("string")).alias("id"), n.alias("input"), n.alias("output"), (n / 8).alias("input_cached"))
    docs = _parts(s, d).groupBy("g").agg(F.to_json(F.struct(F.collect_list(entry).alias("prices"))).alias("value"))
    return sp.pricing(docs, "llmprices").select("model", F.col("i").cast("double").alias("i"), F.col("cr").cast("double").alias("cr"))


def _payloads(s, d) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet").select(F.concat(F.lit("org-"), F.col("c_custkey").cast("string")).alias("org_uuid"), "c_custkey")
    window = lambda x: F.struct(x.cast("double").alias("utilization"))
    limit = lambda group, name, pct: F.struct(F.lit(group).alias("group"), pct.cast("double").alias("percent"), F.struct(F.struct(F.lit(name).alias("display_name")).alias("model")).alias("scope"))
    k = F.col("c_custkey") % 100
    new = F.when(F.col("c_custkey") % 2 == 0, F.array(limit("session", "Opus", k), limit("weekly", "Fable", k), limit("weekly", "Opus", 100 - k)))
    return c.select("org_uuid", F.to_json(F.struct(F.when(F.col("c_custkey") % 5 == 0, window(k)).alias("five_hour"), window(k).alias("seven_day_opus"), F.when(F.col("c_custkey") % 3 > 0, window(k + 1)).alias("seven_day_sonnet"), new.alias("limits"))).alias("value"))


@query("""SELECT concat('org-', c_custkey) AS org_uuid, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n) - 1 AS INT) AS pos, name, pct FROM (
  SELECT c_custkey, 1 AS n, 'Fable' AS name, CAST(c_custkey % 100 AS DOUBLE) AS pct FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'Opus', CAST(100 - c_custkey % 100 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 1, 'Sonnet', CAST(c_custkey % 100 + 1 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 2, 'Opus', CAST(c_custkey % 100 AS DOUBLE) FROM customer WHERE c_custkey % 2 = 1)""")
def scoped_limits(s, d):
    return sa.scoped_limits(_payloads(s, d))


_SCOPED = """SELECT c_custkey, CAST(row_number() OVER (PARTITION BY c_custkey ORDER BY n) - 1 AS INT) AS pos, name, pct FROM (
  SELECT c_custkey, 1 AS n, 'Fable' AS name, c_custkey % 100 AS pct FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 2, 'Opus', 100 - c_custkey % 100 FROM customer WHERE c_custkey % 2 = 0
  UNION ALL SELECT c_custkey, 1, 'Sonnet', c_custkey % 100 + 1 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 > 0 UNION ALL SELECT c_custkey, 2, 'Opus', c_custkey % 100 FROM customer WHERE c_custkey % 2 = 1)"""


@query(f"""SELECT concat('org-', c_custkey) AS org_uuid, CAST(pos + 1 AS INT) AS pos, concat('  └─ ', name) AS label, concat(pct, '%') AS usage FROM ({_SCOPED}) WHERE pct > 0
UNION ALL SELECT concat('org-', c_custkey), 0, '  └─ 5h window', concat(c_custkey % 100, '%') FROM customer WHERE c_custkey % 5 = 0""")
def cycle_sub_rows(s, d):
    return cycles.cycle_sub_rows(_payloads(s, d))


@query("SELECT concat('org-', c_custkey) AS org_uuid, CAST(CASE WHEN c_custkey % 2 = 0 THEN 100 - c_custkey % 100 ELSE c_custkey % 100 END AS DOUBLE) AS pct FROM customer")
def model_limit(s, d):
    return sa.model_limit_pct(_payloads(s, d), "opus")


@query("SELECT org_uuid, cycle_end, utilization, captured_at, cost_at_calibration, plan FROM snaps WHERE org_uuid <> 'org-0' UNION ALL SELECT 'org-0', cycle_end, utilization, captured_at, cost_at_calibration, plan FROM snaps WHERE org_uuid = 'org-0'")
def snapshots_v1_v2(s, d):
    n = fx.snapshots(s, d)
    one = F.struct(_iso("cycle_end").alias("cycle_end"), "utilization", _iso("captured_at").alias("captured_at"), "cost_at_calibration", "plan")
    by_org = n.groupBy("org_uuid", F.date_trunc("minute", "captured_at")).agg(F.collect_list(one).alias("snapshots"))  # a store of each
    new = by_org.filter("org_uuid <> 'org-0'").select(F.to_json(F.struct(F.lit(2).alias("version"), F.create_map("org_uuid", F.struct("snapshots")).alias("accounts"))).alias("value"))
    old = by_org.filter("org_uuid = 'org-0'").select(F.to_json(F.struct("snapshots")).alias("value"))
    return sa.read_snapshots(new.unionByName(old), "org-0")


@query(""", c AS (SELECT *, row_number() OVER (PARTITION BY org_uuid, date_trunc('minute', cycle_end), plan ORDER BY captured_at DESC) AS r FROM snaps),
k AS (SELECT *, row_number() OVER (PARTITION BY org_uuid ORDER BY cycle_end DESC, captured_at DESC) AS n FROM c WHERE r = 1)
SELECT org_uuid, plan, cycle_end, utilization, captured_at, cost_at_calibration FROM k WHERE n <= 12""")
def snapshot_compact(s, d):
    return cycles.compact_snapshots(fx.snapshots(s, d)).select("org_uuid", "plan", "cycle_end", "utilization", "captured_at", "cost_at_calibration")


_CURRENT = f""", l AS (SELECT org_uuid, max(cycle_end) AS e FROM snaps GROUP BY 1),
cur AS (SELECT org_uuid, e + CAST(greatest(floor((epoch_us(TIMESTAMP '{NOW}') - epoch_us(e)) / 604800000000) + 1, 0) AS INT) * INTERVAL 7 DAY AS e FROM l),
latest AS (SELECT org_uuid, date_trunc('minute', cycle_end) AS cycle, arg_max(utilization, captured_at) AS utilization, arg_max({{'c': cost_at_calibration}}, captured_at).c AS cost_at_calibration FROM snaps GROUP BY 1, 2)"""


@query(_CURRENT + ' SELECT org_uuid, e - INTERVAL 7 DAY AS start, e AS "end" FROM cur')
def current_cycle(s, d):
    return cycles.current_cycle(fx.snapshots(s, d), NOW)


@query(_CURRENT + ' SELECT org_uuid, n AS number, e - (n + 1) * INTERVAL 7 DAY AS start, e - n * INTERVAL 7 DAY AS "end" FROM cur, (SELECT CAST(unnest(range(4)) AS INT) AS n)')
def weekly_cycles(s, d):
    return cycles.cycles(cycles.current_cycle(fx.snapshots(s, d), NOW).select("org_uuid", F.col("end").alias("resets_at")))


def _cycle_sql(records: str, own: bool = False) -> str:
    """Cycles with live, estimated or cached utilization of the current one; ``records`` (cost, ts, and org if they count for their own only) are those that count."""
    costs = """SELECT c.org_uuid, c.start, c.stop, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost FROM cy c LEFT JOIN rec ON rec.org = c.org_uuid AND ts >= c.start AND ts < c.stop GROUP BY ALL""" if own else (
        "SELECT d.*, cost FROM (SELECT DISTINCT org_uuid, start, stop FROM cy) d JOIN (SELECT start, stop, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost "
        "FROM (SELECT DISTINCT start, stop FROM cy) LEFT JOIN rec ON ts >= start AND ts < stop GROUP BY 1, 2) USING (start, stop)")
    return _CURRENT + f""", cy AS (SELECT org_uuid, n AS number, e - (n + 1) * INTERVAL 7 DAY AS start, e - n * INTERVAL 7 DAY AS stop FROM cur, (SELECT CAST(unnest(range(4)) AS INT) AS n)),
rec AS ({records}),
co AS ({costs}),
r AS (SELECT cy.org_uuid, number, cy.start, cy.stop, cost, latest.utilization AS u, latest.cost_at_calibration AS k, o.live_pct, o.enabled, o.used_cents, o.limit_cents, number = 0 AS cur
  FROM cy JOIN co USING (org_uuid, start, stop) LEFT JOIN latest ON latest.org_uuid = cy.org_uuid AND latest.cycle = date_trunc('minute', cy.stop) LEFT JOIN orgs o ON o.org_uuid = cy.org_uuid),
f AS (SELECT *, CASE WHEN NOT cur THEN u WHEN live_pct IS NOT NULL THEN live_pct WHEN u > 0 AND k > 0 THEN cost / (k / u) ELSE u END AS utilization,
  CASE WHEN NOT cur THEN 'cached' WHEN live_pct IS NOT NULL THEN 'live' WHEN u > 0 AND k > 0 THEN 'estimated' ELSE 'cached' END AS source FROM r)
SELECT org_uuid, number, start, stop AS "end", utilization, source, cost, CASE WHEN utilization > 0 THEN cost / utilization END AS cost_per_pct,
  CASE WHEN NOT cur OR enabled IS NULL THEN '—' WHEN NOT enabled THEN 'disabled' ELSE printf('$%d.%02d / $%d.%02d', used_cents // 100, used_cents % 100, limit_cents // 100, limit_cents % 100) END AS overage FROM f"""


def _cycle_report(s, d, priced: DataFrame) -> DataFrame:
    n = fx.snapshots(s, d)
    return cycles.cycle_report(priced, n, cycles.current_cycle(n, NOW).select("org_uuid", F.col("end").alias("resets_at")), state=fx.orgs(s, d))


@query(_cycle_sql("SELECT cost, ts FROM priced WHERE provider = 'claude'"))
def cycle_report(s, d):
    return _cycle_report(s, d, _priced(s, d))


@query(_cycle_sql("""SELECT p.cost, p.ts FROM priced p JOIN named n ON p.seq = n.seq WHERE p.provider = 'claude'
  AND CASE WHEN n.account_uuid IS NOT NULL THEN n.account_name ELSE n.log_name END = 'work'"""))
def cycle_report_account(s, d):
    return _cycle_report(s, d, cycles.of_account(_priced(s, d), fx.accounts(s), fx.switch_log(s), "work"))


@query(_cycle_sql("""SELECT p.cost, p.ts, CASE WHEN n.account_uuid IS NULL THEN a.org_uuid WHEN n.account_name IS NOT NULL THEN n.account_uuid END AS org
  FROM priced p JOIN named n ON p.seq = n.seq LEFT JOIN accounts a ON a.name = n.log_name WHERE p.provider = 'claude'""", own=True))
def cycle_report_owners(s, d):
    """All organisations at once, each with the cost of its own records."""
    return _cycle_report(s, d, attribution.with_owner(_priced(s, d), fx.accounts(s), fx.switch_log(s)))


@query("SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) AS cost FROM priced WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-17 00:00:00'")
def cost_in_range(s, d):
    return cycles.cost_in_range(_priced(s, d), "2024-01-10 00:00:00", "2024-01-17 00:00:00")


_RESOLVE = "CASE WHEN live_pct IS NOT NULL THEN live_pct WHEN utilization > 0 AND cost_at_calibration > 0 THEN cost_now / (cost_at_calibration / utilization) ELSE utilization END"


@query(f"SELECT org_uuid, {_RESOLVE} AS pct, CASE WHEN live_pct IS NOT NULL THEN 'live' WHEN utilization > 0 AND cost_at_calibration > 0 THEN 'estimated' ELSE 'cached' END AS source FROM orgs")
def resolve_usage(s, d):
    return cycles.resolve_usage(fx.orgs(s, d)).select("org_uuid", "pct", "source")


@query(""", e AS (SELECT *, CASE WHEN utilization > 0 AND cost_at_calibration / utilization > 0 THEN cost_now / (cost_at_calibration / utilization) ELSE utilization END AS est FROM orgs)
SELECT org_uuid, CASE WHEN utilization < 2.5 OR cost_at_calibration IS NULL THEN TRUE ELSE len(list_filter([2.5, 5, 10, 30, 50, 70, 90, 95, 96, 97, 98, 99, 100]::DOUBLE[], lambda t: utilization < t AND est >= t)) > 0 END AS calibrate FROM e""")
def needs_calibration(s, d):
    return cycles.needs_calibration(fx.orgs(s, d)).select("org_uuid", "calibrate")


_HOURS = f""", h AS (SELECT *, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(start)) // 60000000 / 60.0::DOUBLE AS eh, (epoch_us("end") - epoch_us(TIMESTAMP '{NOW}')) // 60000000 / 60.0::DOUBLE AS lh FROM orgs)"""


@query(_HOURS + " SELECT org_uuid, CASE WHEN live_pct > 0 THEN least(live_pct + live_pct / eh * lh, 200.0::DOUBLE) END AS projected FROM h")
def pace(s, d):
    return cycles.pace(fx.orgs(s, d).withColumn("pct", F.col("live_pct")), NOW).select("org_uuid", "projected")


_SHORT = """CASE WHEN abs(t) < 60 THEN printf('%dm', t) WHEN abs(t) < 1440 AND t % 60 = 0 THEN printf('%dh', t // 60) WHEN abs(t) < 1440 THEN printf('%dh %dm', t // 60, t % 60)
  WHEN t % 1440 // 60 = 0 THEN printf('%dd', t // 1440) ELSE printf('%dd %dh', t // 1440, t % 1440 // 60) END"""


@query(_HOURS + f""", p AS (SELECT org_uuid, live_pct AS pct, live_pct / eh AS rate, lh, CASE WHEN live_pct > 0 THEN least(live_pct + live_pct / eh * lh, 200.0::DOUBLE) END AS projected FROM h),
m AS (SELECT *, CAST(round(CASE WHEN projected >= 100 AND rate <> 0 THEN (100 - pct) / rate ELSE lh END * 60) AS BIGINT) AS t FROM p)
SELECT org_uuid, CASE WHEN pct >= 100 THEN 'at capacity' WHEN projected >= 100 THEN concat('hits 100% in ', {_SHORT})
  WHEN projected IS NOT NULL THEN concat(printf('~%.0f%% at reset, ', projected), {_SHORT}, ' left') END AS status FROM m""")
def pace_status(s, d):
    return cycles.pace(fx.orgs(s, d).withColumn("pct", F.col("live_pct")), NOW).select("org_uuid", "status")


@query("""SELECT org_uuid, CASE WHEN contains(coalesce(rate_limit_tier, ''), '20x') THEN 'max20x' WHEN contains(coalesce(rate_limit_tier, ''), '5x') OR contains(coalesce(rate_limit_tier, ''), 'max') THEN 'max5x'
  WHEN subscription_type = 'max' THEN 'max5x' WHEN subscription_type = 'pro' THEN 'pro' WHEN enabled THEN 'max5x' WHEN NOT enabled THEN 'pro' END AS plan FROM orgs""")
def plan_from_profile(s, d):
    df = fx.orgs(s, d).select("org_uuid", F.col("rate_limit_tier").alias("tier"), F.concat(F.lit("claude_"), "subscription_type").alias("org_type"), F.col("enabled").alias("has_max"), (~F.col("enabled")).alias("has_pro"))
    return plans.plan_from_profile(df).select("org_uuid", "plan")


@query("SELECT org_uuid, CASE WHEN subscription_type = 'pro' THEN 'pro' WHEN subscription_type = 'max' THEN CASE WHEN contains(coalesce(rate_limit_tier, ''), '20x') THEN 'max20x' ELSE 'max5x' END END AS plan FROM orgs")
def plan_from_claims(s, d):
    return plans.plan_from_claims(fx.orgs(s, d).drop("plan")).select("org_uuid", "plan")


_JUDGE = """, st AS (SELECT v.org_uuid, v.plan, u, price, higher, lower, count(pct) AS n, avg(pct) AS av, max(pct) AS mx, count(*) FILTER (pct >= 95) AS f FROM v JOIN units USING (plan) GROUP BY ALL),
ju AS (SELECT st.*, CASE WHEN n > 0 AND higher IS NOT NULL AND (f >= 2 OR av >= 85) THEN 'upgrade' WHEN n > 0 AND st.lower IS NOT NULL AND greatest(mx, 0) * st.u / l.u <= 85 THEN 'downgrade' ELSE 'stay' END AS action,
  h.price AS hp, l.price AS lp FROM st LEFT JOIN (SELECT plan AS p, u, price FROM units) l ON st.lower = l.p LEFT JOIN (SELECT plan AS p, price FROM units) h ON st.higher = h.p)"""


@query(", v AS (SELECT org_uuid, plan, utilization AS pct FROM snaps WHERE plan IS NOT NULL)" + _JUDGE + """
SELECT org_uuid, plan, n, coalesce(av, 0) AS avg, coalesce(mx, 0) AS peak, action, CASE action WHEN 'upgrade' THEN higher WHEN 'downgrade' THEN lower END AS target,
  CAST(CASE action WHEN 'upgrade' THEN hp - price WHEN 'downgrade' THEN lp - price END AS DOUBLE) AS price_change FROM ju""")
def recommend(s, d):
    return plans.recommend(fx.snapshots(s, d).filter("plan is not null").select("org_uuid", "plan", F.col("utilization").alias("pct")))


def _current(s, d) -> DataFrame:
    state = fx.orgs(s, d).select("org_uuid", "plan", "live_pct", "opus_pct")
    return cycles.current_cycle(fx.snapshots(s, d), NOW).join(state, "org_uuid")


_PLAN_REPORT = _CURRENT + f""", cu AS (SELECT cur.org_uuid, plan AS own, e, live_pct, opus_pct, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(e - INTERVAL 7 DAY)) // 60000000 / 60.0::DOUBLE AS eh, (epoch_us(e) - epoch_us(TIMESTAMP '{NOW}')) // 60000000 / 60.0::DOUBLE AS lh FROM cur JOIN orgs USING (org_uuid)),
ls AS (SELECT org_uuid, date_trunc('minute', cycle_end) AS cycle, plan, arg_max(utilization, captured_at) AS util, max(captured_at) AS cap FROM snaps GROUP BY 1, 2, 3),
re AS (SELECT * FROM (SELECT ls.*, own, row_number() OVER (PARTITION BY ls.org_uuid ORDER BY cycle DESC, cap DESC) AS n FROM ls JOIN cu ON ls.org_uuid = cu.org_uuid WHERE cycle <> date_trunc('minute', e)) WHERE n <= 4),
na AS (SELECT org_uuid, plan, util AS pct FROM re WHERE plan = own), mi AS (SELECT org_uuid, max(coalesce(plan <> own, TRUE)) AS mixed FROM re GROUP BY 1),
v AS (SELECT * FROM na UNION ALL SELECT org_uuid, own, CASE WHEN eh >= 48 AND live_pct > 0 THEN least(live_pct + live_pct / eh * lh, 200) END FROM cu WHERE org_uuid NOT IN (SELECT org_uuid FROM na))""" + _JUDGE + """,
fi AS (SELECT ju.*, opus_pct, coalesce(action = 'downgrade' AND lower = 'pro' AND opus_pct >= 25, FALSE) AS barred FROM ju JOIN cu ON ju.org_uuid = cu.org_uuid)"""


@query(_PLAN_REPORT + """
SELECT fi.org_uuid, plan, n, coalesce(av, 0) AS avg, coalesce(mx, 0) AS peak, CASE WHEN barred THEN 'stay' ELSE action END AS action, CASE WHEN barred THEN NULL WHEN action = 'upgrade' THEN higher WHEN action = 'downgrade' THEN lower END AS target,
  CAST(CASE WHEN barred THEN NULL WHEN action = 'upgrade' THEN hp - price WHEN action = 'downgrade' THEN lp - price END AS DOUBLE) AS price_change,
  CASE WHEN fi.org_uuid IN (SELECT org_uuid FROM na) THEN 'cycles' WHEN n > 0 THEN 'partial' ELSE 'recent switch' END AS basis, coalesce(mixed, FALSE) AS mixed FROM fi LEFT JOIN mi ON fi.org_uuid = mi.org_uuid""")
def plan_report(s, d):
    return plans.plan_report(fx.snapshots(s, d), _current(s, d), NOW)


@query(_PLAN_REPORT + """, x AS (SELECT fi.*, CASE WHEN barred THEN 'stay' ELSE action END AS act, (SELECT count(*) FROM na WHERE na.org_uuid = fi.org_uuid) AS cy, coalesce(av, 0) AS a, coalesce(mx, 0) AS m FROM fi),
y AS (SELECT x.*, o.label AS own, t.label AS tl, t.u AS tu, t.price AS tp, b.label AS bl, b.u AS bu, CASE WHEN cy > 0 THEN CAST(cy AS VARCHAR) ELSE '1 (partial cycle)' END AS cnt
  FROM x JOIN named_plans o ON o.plan = x.plan LEFT JOIN named_plans t ON t.plan = CASE act WHEN 'upgrade' THEN higher WHEN 'downgrade' THEN x.lower END LEFT JOIN named_plans b ON b.plan = x.lower)
SELECT org_uuid, concat(own, printf(' — $%.2f/month', CAST(price AS DOUBLE)), chr(10),
  CASE WHEN barred THEN concat(chr(10), printf('Pro downgrade skipped — Opus usage on current cycle (~%.0f%%) suggests Pro''s tier limits would throttle hard.', opus_pct)) ELSE '' END,
  CASE WHEN cy = 0 AND n = 0 THEN '' WHEN act = 'downgrade' THEN concat(chr(10), '▸ Recommend: downgrade to ', tl, printf(' — save ~$%.2f/month', CAST(price - tp AS DOUBLE)), chr(10), chr(10), '  ', cnt,
      printf('-cycle average was %.0f%% (peak %.0f%%). On ', a, m), tl, ', this projects to', chr(10), printf('  ~%.0f%% avg (~%.0f%% peak) — comfortable headroom.', a * u / tu, m * u / tu))
    WHEN act = 'upgrade' THEN concat(chr(10), '▸ Recommend: upgrade to ', tl, printf(' — +$%.2f/month', CAST(tp - price AS DOUBLE)), chr(10), chr(10),
      CASE WHEN cy > 0 AND f >= 2 THEN printf('  You''ve hit ≥95%% utilization in %d of the last %d cycles.', f, cy) ELSE concat('  ', cnt, printf('-cycle average is %.0f%% — consistently near capacity.', a)) END,
      chr(10), '  ', tl, printf(' offers %.0f× more headroom for the same workload.', CAST(tu / u AS DOUBLE)))
    ELSE concat(chr(10), '▸ Recommend: stay on ', own, chr(10), chr(10), CASE WHEN cy > 0 THEN concat('  ', cnt, printf('-cycle average was %.0f%% (peak %.0f%%).', a, m)) ELSE concat(printf('  Partial-cycle projection: ~%.0f%% on ', m), own, '.') END,
      chr(10), CASE WHEN bl IS NULL THEN '  Utilization is in a comfortable range for this plan.' ELSE concat('  Downgrading to ', bl, printf(' would push peak to ~%.0f%% — too tight.', m * u / bu)) END) END) AS text FROM y""".replace(
    ", x AS (", ", named_plans(plan, label, u, price) AS (VALUES ('pro', 'Claude Pro', 1.0::DOUBLE, 20.0::DOUBLE), ('max5x', 'Claude Max (5x)', 5.0, 100.0), ('max20x', 'Claude Max (20x)', 20.0, 200.0)), x AS ("))
def plan_texts(s, d):
    return plans.plan_texts(fx.snapshots(s, d), _current(s, d), NOW)


@query(_CURRENT + """, cu AS (SELECT cur.org_uuid, plan AS own, e FROM cur JOIN orgs USING (org_uuid)),
ls AS (SELECT org_uuid, date_trunc('minute', cycle_end) AS cycle, plan, arg_max(utilization, captured_at) AS util, max(captured_at) AS cap FROM snaps GROUP BY 1, 2, 3),
re AS (SELECT * FROM (SELECT ls.*, own, row_number() OVER (PARTITION BY ls.org_uuid ORDER BY cycle DESC, cap DESC) AS n FROM ls JOIN cu ON ls.org_uuid = cu.org_uuid WHERE cycle <> date_trunc('minute', e)) WHERE n <= 4),
oc AS (SELECT re.*, o.u AS ou, CASE WHEN re.plan = own THEN util ELSE util * p.u / o.u END AS x FROM re LEFT JOIN units p ON p.plan = re.plan LEFT JOIN units o ON o.plan = own)
SELECT org_uuid, cycle, plan, CAST(CASE WHEN own = 'pro' THEN x ELSE x * ou / 1.0 END AS DOUBLE) AS on_pro, CAST(CASE WHEN own = 'max5x' THEN x ELSE x * ou / 5.0 END AS DOUBLE) AS on_max5x,
  CAST(CASE WHEN own = 'max20x' THEN x ELSE x * ou / 20.0 END AS DOUBLE) AS on_max20x FROM oc""")
def plan_table(s, d):
    from usagelake.schema import plans as table

    return plans.plan_table(fx.snapshots(s, d), table(s), _current(s, d))


_TIER = """concat(CASE {0} WHEN 'max' THEN 'Claude Max' WHEN 'pro' THEN 'Claude Pro' ELSE {0} END,
  CASE WHEN contains({1}, '20x') THEN ' (20x)' WHEN contains({1}, '5x') THEN ' (5x)' ELSE '' END)"""
_LABEL = "CASE {} WHEN 'pro' THEN 'Claude Pro' WHEN 'max5x' THEN 'Claude Max (5x)' WHEN 'max20x' THEN 'Claude Max (20x)' END"


@query(_CURRENT + f""", own AS (SELECT p.cost, p.ts, coalesce(n.account_uuid, n.log_org) AS org FROM priced p JOIN named n ON p.seq = n.seq WHERE p.provider = 'claude'),
li AS (SELECT org_uuid, CASE WHEN enabled THEN 'fresh' WHEN NOT enabled THEN 'expired' END AS token, live_pct, opus_pct, plan, subscription_type AS ct, rate_limit_tier AS cr FROM orgs),
np AS (SELECT org_uuid, arg_max({{'p': plan}}, captured_at).p AS p FROM snaps GROUP BY 1),
b AS (SELECT a.*, li.token, CASE WHEN token = 'fresh' THEN live_pct END AS lp, CASE WHEN token = 'fresh' THEN opus_pct END AS five, CASE WHEN token = 'fresh' THEN li.plan END AS pl, ct, cr, cur.e, np.p, a.org_uuid = 'org-1' AS active
  FROM accounts a LEFT JOIN li ON a.org_uuid = li.org_uuid LEFT JOIN cur ON a.org_uuid = cur.org_uuid LEFT JOIN np ON a.org_uuid = np.org_uuid),
co AS (SELECT org AS org_uuid, CAST(coalesce(sum(cost), 0) AS DOUBLE) AS c FROM own JOIN cur ON own.org = cur.org_uuid WHERE ts >= e - INTERVAL 7 DAY AND ts < least(e, TIMESTAMP '{NOW}') GROUP BY 1),
ro AS (SELECT name, active, coalesce(CASE WHEN active THEN {_LABEL.format('b.pl')} END, {_LABEL.format('b.p')}, CASE WHEN token IS NOT NULL THEN {_TIER.format('coalesce(ct, $$unknown$$)', 'cr')} END, concat(CASE subscription_type WHEN 'max' THEN 'Claude Max' WHEN 'pro' THEN 'Claude Pro' ELSE subscription_type END,
    CASE WHEN contains(rate_limit_tier, '20x') THEN ' (20x)' WHEN contains(rate_limit_tier, '5x') THEN ' (5x)' ELSE '' END), 'unknown') AS plan,
  CASE WHEN lp IS NOT NULL THEN lp WHEN utilization > 0 AND cost_at_calibration > 0 THEN coalesce(c, 0) / (cost_at_calibration / utilization) ELSE utilization END AS pct,
  CASE WHEN lp IS NOT NULL THEN 'live' WHEN utilization > 0 AND cost_at_calibration > 0 THEN 'estimated' ELSE 'cached' END AS source, five AS five_hour_pct, e AS resets_at, coalesce(c, 0) AS cost,
  CASE WHEN active THEN NULL WHEN token IS NULL THEN 'no stored credentials' WHEN token <> 'fresh' THEN 'token expired' END AS note
  FROM b LEFT JOIN co ON b.org_uuid = co.org_uuid LEFT JOIN latest l ON l.org_uuid = b.org_uuid AND l.cycle = date_trunc('minute', e))
SELECT * FROM ro UNION ALL SELECT 'TOTAL', NULL, NULL, NULL, NULL, NULL, NULL, sum(cost), NULL FROM ro HAVING count(*) > 1""")
def account_overview(s, d):
    token = F.when(F.col("enabled"), "fresh").when(~F.col("enabled"), "expired")
    live = fx.orgs(s, d).select("org_uuid", "live_pct", F.col("opus_pct").alias("five_hour_pct"), "plan", F.lit(None).cast("timestamp_ntz").alias("resets_at"), token.alias("token"),
                                F.col("subscription_type").alias("claim_type"), F.col("rate_limit_tier").alias("claim_tier"))
    return cycles.account_overview(_priced(s, d), fx.accounts(s), fx.switch_log(s), fx.snapshots(s, d), NOW, live, active="org-1")


@query("SELECT org_uuid, CASE WHEN enabled IS NULL THEN '—' WHEN NOT enabled THEN 'disabled' ELSE printf('$%d.%02d / $%d.%02d', used_cents // 100, used_cents % 100, limit_cents // 100, limit_cents % 100) END AS overage FROM orgs")
def overage(s, d):
    return cycles.overage(fx.orgs(s, d))


@query("SELECT subscription_type, rate_limit_tier, concat(CASE subscription_type WHEN 'max' THEN 'Claude Max' WHEN 'pro' THEN 'Claude Pro' ELSE subscription_type END, CASE WHEN contains(rate_limit_tier, '20x') THEN ' (20x)' WHEN contains(rate_limit_tier, '5x') THEN ' (5x)' ELSE '' END) AS label FROM orgs WHERE subscription_type IS NOT NULL AND rate_limit_tier IS NOT NULL GROUP BY ALL")
def tier_labels(s, d):
    rows = fx.orgs(s, d).select("subscription_type", "rate_limit_tier").dropna().distinct()
    return rows.withColumn("label", X.tier_label(F.col("subscription_type"), F.col("rate_limit_tier")))


# ---- outputs ----


_PLAIN = "regexp_replace(regexp_replace(model, '^claude-', ''), '^(.+)-[0-9]{8}$', '\\1')"


@query(f""", m AS (SELECT {_PLAIN} AS short, model, CAST(sum(cost) AS DOUBLE) AS c, coalesce(sum(cost), 0) AS o, sum(input_tokens) AS a, sum(output_tokens) AS b FROM priced GROUP BY 1, 2),
t AS (SELECT CAST(coalesce(sum(cost), 0) AS DOUBLE) AS c, CAST(sum(input_tokens) AS BIGINT) AS a, CAST(sum(output_tokens) AS BIGINT) AS b FROM priced),
l AS (SELECT string_agg(short, ', ' ORDER BY o DESC, model) AS models, string_agg(concat(chr(10), '  ', short, ': ', {_money('c')}), '' ORDER BY o DESC, model) AS lines FROM m)
SELECT concat({_money('c')}, ' ', {_tok('a')}, '/', {_tok('b')}, ' ', models) AS text, concat('This month: ', {_money('c')}, lines) AS tooltip,
  CASE WHEN c >= 1e9 THEN 'critical' WHEN c >= 1.0 THEN 'warning' ELSE 'normal' END AS class, 'USD' AS currency FROM t, l""")
def status_row(s, d):
    return outputs.status_row(_priced(s, d), "{cost} {input}/{output} {models}", warn=1.0, critical=1e9, label="This month")


def _table_sql(details: bool) -> str:
    cells = f"{_tok('input_tokens')} AS input, {_tok('output_tokens')} AS output, {_tok('cache_creation_input_tokens')} AS cache_write, {_tok('cache_read_input_tokens')} AS cache_read, {_money('cost', '€')} AS cost"
    sums = f"{_SUMS}, CAST(sum(cost) AS DOUBLE) * 0.5::DOUBLE AS cost"
    below = f" UNION ALL SELECT concat('  ', model), {sums}, '', '' FROM k GROUP BY bucket, model" if details else ""
    return f""", k AS (SELECT *, strftime(ts, '%Y-%m-%d') AS bucket FROM priced),
m AS (SELECT bucket, model, coalesce(sum(cost), 0) AS c FROM k GROUP BY 1, 2),
ml AS (SELECT bucket, string_agg({_PLAIN}, ', ' ORDER BY c DESC, model) AS models FROM m GROUP BY 1),
r AS (SELECT k.bucket AS period, {sums}, any_value(models) AS models, string_agg(DISTINCT project, ', ' ORDER BY project) AS projects FROM k JOIN ml ON k.bucket = ml.bucket GROUP BY k.bucket
  UNION ALL SELECT 'TOTAL', {sums}, '', '' FROM k{below})
SELECT period, {cells}, models, projects, '' AS nope FROM r"""


@query(_table_sql(False))
def table_rows(s, d):
    return outputs.table_rows(_priced(s, d), "daily", outputs.choose_columns(["+projects", "-tools", "+nope"]), code="EUR", rate=0.5)


@query(_table_sql(True))
def table_rows_breakdown(s, d):
    return outputs.table_rows(_priced(s, d), "daily", outputs.choose_columns(["+projects", "-tools", "+nope"]), details=True, code="EUR", rate=0.5)


def _both_burns() -> str:
    """The rows of models and of all together, as a table ``br``."""
    models, everything = _burn_sql("model", "model, session_id"), _burn_sql("'ALL'", "session_id")
    return f""", br AS (SELECT * FROM (WITH {models[2:]}) UNION ALL SELECT * FROM (WITH {everything[2:]}))"""


@query(_both_burns() + f""" SELECT {_PLAIN} AS model, {_tok('tokens')} AS tokens, {_money('cost')} AS cost,
  CASE WHEN active_secs >= 3600 THEN printf('%dh%02dm', active_secs // 3600, active_secs % 3600 // 60) ELSE printf('%dm', active_secs // 60) END AS active,
  CASE WHEN tokens_per_min IS NULL THEN '–' ELSE {_tok('CAST(round(tokens_per_min) AS BIGINT)')} END AS "tok/min",
  CASE WHEN cost_per_active_hour IS NULL THEN '–' ELSE {_money('cost_per_active_hour')} END AS "$/act-hr", CASE WHEN cost_per_calendar_day IS NULL THEN '–' ELSE {_money('cost_per_calendar_day')} END AS "$/cal-day" FROM br""")
def burn_rows(s, d):
    return outputs.burn_rows(burn.burn(_priced(s, d)))


@query(_both_burns() + """ SELECT model, tokens, cost * 0.92::DOUBLE AS cost, active_secs AS active_seconds, tokens_per_min, cost_per_active_hour * 0.92::DOUBLE AS cost_per_active_hour,
  cost_per_calendar_day * 0.92::DOUBLE AS cost_per_calendar_day, 'EUR' AS currency FROM br""")
def burn_json(s, d):
    return outputs.json_burn(burn.burn(_priced(s, d)), "EUR", 0.92)


@query(f""", m AS (SELECT strftime(ts, '%Y-%m') AS bucket, model, {_PLAIN} AS short, sum(cost) AS c, {_SUMS} FROM priced GROUP BY ALL),
ml AS (SELECT bucket, string_agg(short, ', ' ORDER BY coalesce(c, 0) DESC, model) AS models,
  string_agg(concat_ws('/', model, input_tokens, output_tokens, cache_creation_input_tokens, cache_read_input_tokens, CASE WHEN c IS NULL THEN 'null' ELSE 'cost' END), ';' ORDER BY coalesce(c, 0) DESC, model) AS details FROM m GROUP BY 1)
SELECT strftime(ts, '%Y-%m') AS bucket, 'EUR' AS currency, {_SUMS}, CAST(sum(cost) AS DOUBLE) * 0.92::DOUBLE AS cost, any_value(models) AS models,
  string_agg(DISTINCT project, ', ' ORDER BY project) AS projects, any_value(details) AS details FROM priced JOIN ml ON strftime(ts, '%Y-%m') = ml.bucket GROUP BY 1""")
def json_report(s, d):
    out = outputs.json_report(_priced(s, d), "monthly", 0.92, "EUR")
    detail = F.transform("details", lambda x: F.concat_ws("/", x["model"], *[x[c].cast("string") for c in TOKENS], F.when(x["cost"].isNull(), "null").otherwise("cost")))
    return out.select("bucket", "currency", *TOKENS, "cost", F.array_join("models", ", ").alias("models"), F.array_join("projects", ", ").alias("projects"), F.array_join(detail, ";").alias("details"))


@query(f"SELECT org_uuid, {_SHORT} AS duration, CASE WHEN live_pct >= 90 THEN 'critical' WHEN live_pct >= 50 THEN 'warning' ELSE 'normal' END AS class,\n"
       "  CASE WHEN x > 100 THEN printf('>100%% (~%.0f%%)', x) ELSE printf('~%.0f%%', x) END AS projection FROM (SELECT *, limit_cents AS t, utilization * 1.5::DOUBLE AS x FROM orgs)")
def short_texts(s, d):
    return fx.orgs(s, d).select("org_uuid", X.format_duration_short(F.col("limit_cents") / 60).alias("duration"), X.threshold_class(F.col("live_pct"), 50, 90).alias("class"),
                                X.projection_text(F.col("utilization") * 1.5).alias("projection"))


@query(f"SELECT provider, strftime(ts, '%Y-%m-%d') AS usage_date, count(*) AS records, {_SUMS} FROM usage WHERE provider <> 'amp' GROUP BY 1, 2")
def usage_table(s, d):
    """Usage written as a partitioned table and read back with a partition left out."""
    path = f"{storage.shared_folder(s)}/usage-{uuid.uuid4().hex}"
    ingest.write_usage(_usage(s, d), path)
    table = s.read.parquet(path).filter("provider <> 'amp'")
    return table.groupBy("provider", F.date_format("usage_date", "yyyy-MM-dd").alias("usage_date")).agg(F.count(F.lit(1)).alias("records"), *[F.sum(c).alias(c) for c in TOKENS])


@query("SELECT usage_date, count(*) AS records FROM (SELECT strftime(ts, '%Y-%m-%d') AS usage_date FROM usage WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-13') GROUP BY 1")
def usage_table_range(s, d):
    """A range of days of the partitioned table, whose other days aren't read."""
    path = f"{storage.shared_folder(s)}/usage-{uuid.uuid4().hex}"
    ingest.write_usage(_usage(s, d), path)
    table = filters.in_range(s.read.parquet(path), "2024-01-10", "2024-01-12")
    return table.groupBy(F.date_format("usage_date", "yyyy-MM-dd").alias("usage_date")).agg(F.count(F.lit(1)).alias("records"))


@query("""SELECT 'month' AS kind, provider, count(*) AS records FROM usage WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-01' AND DATE '2024-01-30' GROUP BY 2
UNION ALL SELECT 'week', provider, count(*) FROM usage WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-24' AND DATE '2024-01-30' GROUP BY 2
UNION ALL SELECT 'subscription', provider, count(*) FROM usage WHERE CAST(ts AS DATE) BETWEEN DATE '2023-12-26' AND DATE '2024-01-30' GROUP BY 2
UNION ALL SELECT 'from', provider, count(*) FROM usage WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-20' AND DATE '2024-01-30' GROUP BY 2
UNION ALL SELECT 'to', provider, count(*) FROM usage WHERE CAST(ts AS DATE) <= DATE '2024-01-05' GROUP BY 2""")
def named_ranges(s, d):
    """Records in ranges that are named, and in ranges of which one end is given."""
    u, today, day = _usage(s, d), dt.date(2024, 1, 30), dt.date
    ranges = {k: filters.named_range(k, today) for k in ("month", "week", "subscription")}
    ranges |= {"from": filters.resolve_range(day(2024, 1, 20), None, today), "to": filters.resolve_range(None, day(2024, 1, 5), today)}
    return ingest.unify(*[filters.in_range(u, *r).groupBy(F.lit(k).alias("kind"), "provider").agg(F.count(F.lit(1)).alias("records")) for k, r in ranges.items()])


@query(f"""SELECT 'pi' AS provider, seq, concat_ws(':', 'pi', session_id, {_STAMP}, input_tokens, output_tokens) AS message_id FROM raw
UNION ALL SELECT 'codex', seq, concat_ws(':', 'codex', concat(project, '/', session_id), {_STAMP}, input_tokens, output_tokens) FROM raw WHERE input_tokens + output_tokens + cache_read_input_tokens > 0
UNION ALL SELECT 'kimi', seq, CASE WHEN seq % 2 = 0 THEN message_id ELSE concat_ws(':', 'kimi', session_id, {_STAMP_S}, input_tokens, output_tokens) END FROM raw WHERE {_NOT_EMPTY}""")
def composite_ids(s, d):
    """Message ids that are made of session, time and tokens where a log gives none."""
    u = fx.usage_raw(s, d)
    use = lambda *n: F.struct(*[F.col(c).alias(x) for c, x in zip(TOKENS, n, strict=True)])
    place = lambda *x: F.concat(*[F.lit(p) if p[0] == "/" or p[0] == "." else F.col(p) for p in x])
    pi = F.to_json(F.struct(_iso().alias("timestamp"), F.struct(F.lit("assistant").alias("role"), "model", use("input", "output", "cacheWrite", "cacheRead").alias("usage")).alias("message")))
    given = F.struct("input_tokens", "output_tokens", F.col("cache_read_input_tokens").alias("cached_input_tokens"))
    codex = F.to_json(F.struct(_iso().alias("timestamp"), F.struct(F.lit("token_count").alias("type"), F.struct(given.alias("last_token_usage")).alias("info")).alias("payload")))
    kimi = F.to_json(F.struct(F.unix_seconds(F.col("ts").cast("timestamp")).cast("double").alias("timestamp"), F.struct(F.lit("StatusUpdate").alias("type"), F.struct(
        F.when(F.col("seq") % 2 == 0, F.col("message_id")).alias("message_id"), use("input_other", "output", "input_cache_creation", "input_cache_read").alias("token_usage")).alias("payload")).alias("message")))
    parts = (providers.extract_pi(_lines(u, place("/l/sessions/", "project", "/2024_", "session_id", ".jsonl"), pi)),
             providers.extract_codex(_lines(u, place("/l/sessions/", "project", "/", "session_id", ".jsonl"), codex)),
             providers.extract_kimi(_lines(u, place("/s/", "project", "/", "session_id", "/wire.jsonl"), kimi)))
    return ingest.unify(*[p.select("provider", "seq", "message_id") for p in parts])


@query("SELECT concat('org-', c_nationkey, '-', c_custkey % 4) AS account_uuid, concat('acc-', min(c_custkey)) AS account_name FROM customer GROUP BY 1")
def registry_names(s, d):
    """Registries of all nations: an organisation with several accounts has the name of the first that was registered."""
    c = s.read.parquet(f"{d}/customer.parquet")
    text = lambda *x: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in x])
    org = text("org-", F.col("c_nationkey"), "-", F.col("c_custkey") % 4)
    entry = F.struct("c_custkey", F.struct(text("acc-", F.col("c_custkey")).alias("name"), org.alias("org_uuid")).alias("a"))
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["a"])
    registries = c.groupBy("c_nationkey").agg(F.to_json(F.struct(F.lit(1).alias("version"), listed.alias("accounts"))).alias("value"))
    people, _ = sa.read_registry(registries)
    return attribution.with_account_name(c.select(org.alias("account_uuid")).distinct(), people).select("account_uuid", "account_name")


# ---- tables with versions ----

_WHOLE = "concat(provider, '/', session_id, '/', strftime(ts, '%Y%m%d'))"
_NEWER = f"SELECT * REPLACE (input_tokens + 1 AS input_tokens) FROM usage WHERE provider IN ('pi', 'amp') AND {_WHOLE} LIKE '%/s1/%' AND ts < TIMESTAMP '2024-01-20'"


@query(f""", gone AS (SELECT DISTINCT {_WHOLE} AS f FROM usage WHERE provider IN ('pi', 'amp') AND session_id = 's1'),
t AS (SELECT provider, {_WHOLE} AS f, input_tokens FROM usage WHERE {_WHOLE} NOT IN (SELECT f FROM gone) UNION ALL SELECT provider, {_WHOLE}, input_tokens FROM ({_NEWER}))
SELECT provider, count(*) AS records, count(DISTINCT f) AS files, CAST(sum(input_tokens) AS BIGINT) AS input_tokens FROM t GROUP BY 1""")
def versioned_merge(s, d):
    """The usage table after its first ingestion and a second one, in which some files have changed and some of these have become empty."""
    u = _usage(s, d).withColumns({"source_file": F.concat_ws("/", "provider", "session_id", F.date_format("ts", "yyyyMMdd")), "ts": F.col("ts").cast("timestamp")})
    files = u.groupBy("provider", F.col("source_file").alias("path")).agg(F.max(F.unix_seconds("ts")).alias("mtime"), F.count(F.lit(1)).alias("size"))
    table = UsageTable(s, f"{storage.shared_folder(s)}/table-{uuid.uuid4().hex}")
    table.merge(u, files)
    again = u.filter("provider in ('pi', 'amp') and session_id = 's1'")
    listing = files.join(again.select("provider", F.col("source_file").alias("path")).distinct(), ["provider", "path"], "left_semi").withColumn("mtime", F.col("mtime") + 1)
    table.merge(again.filter("ts < timestamp '2024-01-20'").withColumn("input_tokens", F.col("input_tokens") + 1), ingest.plan_ingest(listing, table.manifest()))
    return table.read().groupBy("provider").agg(F.count(F.lit(1)).alias("records"), F.countDistinct("source_file").alias("files"), F.sum("input_tokens").alias("input_tokens"))


@query("""SELECT r.seq, k.t IS NOT NULL AS known, k.t AS known_ts FROM (SELECT * FROM raw WHERE seq % 4 = 3) r
LEFT JOIN (SELECT provider, message_id, request_id, coalesce(account_uuid, '') AS a, min(ts) AS t FROM raw WHERE seq % 4 <> 3 GROUP BY ALL) k
  ON k.provider = r.provider AND k.message_id = r.message_id AND k.request_id = r.request_id AND k.a = coalesce(r.account_uuid, '')""")
def known_keys(s, d):
    """Records of a third ingestion, and whether the two before have had their keys."""
    u = fx.usage_raw(s, d)
    index = KeyIndex(s, f"{storage.shared_folder(s)}/keys-{uuid.uuid4().hex}")
    for part in ("seq % 4 = 0", "seq % 4 in (1, 2)"):
        index.add(u.filter(part))
    return index.known(u.filter("seq % 4 = 3")).select("seq", "known", F.col("known_ts").cast("timestamp_ntz").alias("known_ts"))


# ---- streaming: the usage rows as files that land in parts, the last part days older than the first ----

#: Lines of one log file, some 130 MB: a file beyond ``ingest.MOST_FILE`` is none of a tool's logs, and all its lines are passed over.
LOG_LINES = 500_000


def _streamed(s: SparkSession, d: str, totals: live.Totals) -> DataFrame:
    """The view after two runs of one stream: the second reads its own files only and lands the earlier half of the duplicates."""
    base, name = f"{storage.shared_folder(s)}/stream-{uuid.uuid4().hex}", f"live_{uuid.uuid4().hex}"
    usage = fx.usage_raw(s, d)
    late = F.pmod(F.xxhash64("seq"), F.lit(3)) == 0
    for part in (usage.filter(~late), usage.filter(late)):
        part.write.mode("append").parquet(f"{base}/landed")
        live.start(live.read_usage(s, f"{base}/landed", usage.schema), totals, name, f"{base}/state", once=True).awaitTermination()
    return s.table(name)


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM priced WHERE provider = 'codex' GROUP BY 1")
def stream_daily(s, d):
    totals = live.Totals(fx.pricing(s), "daily", lambda kept: filters.by_tool(kept, "codex"))
    return totals.report(_streamed(s, d, totals))


@query(f"SELECT 'bar' AS bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM priced WHERE contains(project, 'oj-2')")
def stream_total(s, d):
    totals = live.Totals(fx.pricing(s), "all", lambda kept: filters.by_project(kept, "OJ-2"))
    return totals.report(_streamed(s, d, totals))


@query("SELECT model, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1")
def stream_models(s, d):
    totals = live.Totals(fx.pricing(s))
    return totals.models(_streamed(s, d, totals))


@query("""SELECT concat('January: $', printf('%.2f', CAST(sum(cost) AS DOUBLE)), ' | ',
  string_agg(concat(regexp_replace(regexp_replace(model, '^claude-', ''), '^(.+)-[0-9]{8}$', '\\1'), ': $', printf('%.2f', CAST(cost AS DOUBLE))), ', ' ORDER BY cost DESC, model)
  FILTER (cost > 0)) AS text
FROM (SELECT model, sum(cost) AS cost FROM priced WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-02' AND DATE '2024-01-20' GROUP BY 1)""")
def stream_line(s, d):
    totals = live.Totals(fx.pricing(s), "all", lambda kept: filters.in_range(kept, "2024-01-02", "2024-01-20"))
    return totals.line(_streamed(s, d, totals), "January")


@query(f"SELECT strftime(ts, '%Y-%m-%d') AS bucket, {_SUMS}, CAST(sum(cost) AS DOUBLE) AS cost FROM priced GROUP BY 1")
def stream_growing(s, d):
    """Claude logs that grow between two runs: lines to records to live totals. Every usage row is a line, whatever its tool."""
    base, name = f"{storage.shared_folder(s)}/growing-{uuid.uuid4().hex}", f"live_{uuid.uuid4().hex}"
    u = fx.usage_raw(s, d)
    line = F.to_json(F.struct(F.lit("assistant").alias("type"), _iso().alias("timestamp"), F.col("request_id").alias("requestId"),
                              F.concat(F.lit("/"), "project").alias("cwd"), F.struct(
        F.col("message_id").alias("id"), "model", F.struct(*TOKENS).alias("usage")).alias("message")))
    lines = u.select(F.pmod("seq", F.lit(2)).alias("half"), line.alias("value"))
    totals = live.Totals(fx.pricing(s))
    for half in (0, 1):
        lines.filter(F.col("half") == half).select("value").write.mode("append").option("maxRecordsPerFile", LOG_LINES).text(f"{base}/logs")
        growing.land(growing.read_growing(s, [f"{base}/logs"], "part-*"), providers.extract_claude, f"{base}/landed", f"{base}/land", once=True).awaitTermination()
    landed = s.read.parquet(f"{base}/landed/0").schema
    live.start(live.read_usage(s, f"{base}/landed", landed), totals, name, f"{base}/state", once=True).awaitTermination()
    return totals.report(s.table(name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

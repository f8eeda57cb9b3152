"""Extractors: log lines or documents of nine tools to usage records.

Each takes a table of ``schema.LINES`` and returns ``schema.USAGE``. Substring tests come before any
parsing; they are part of what the formats mean, not only faster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.functions.text import claude_folder, claude_project, droid_model, path_part, stem
from usagelake.sources.carry import carried
from usagelake.sources.ingest import guarded
from usagelake.sources.jsonx import LAST_MILLI, integer, millis, mistyped, once, rfc3339, string, text, tokens, u64

_MESSAGE = "struct<id:variant, model:string, usage:struct<input_tokens:bigint, output_tokens:bigint, cache_creation_input_tokens:bigint, cache_read_input_tokens:bigint>>"
CLAUDE = (f"type string, timestamp string, requestId variant, cwd variant, message {_MESSAGE}, "
          f"data struct<type:string, message:struct<timestamp:string, requestId:variant, message:{_MESSAGE}>>")
_USE = "struct<input_tokens:bigint, output_tokens:bigint, cached_input_tokens:bigint, cache_read_input_tokens:bigint>"
CODEX = f"timestamp string, payload struct<type:string, model:string, metadata:struct<model:string>, info:struct<model:string, metadata:struct<model:string>, last_token_usage:{_USE}, total_token_usage:{_USE}>>"


def _record(df: DataFrame, provider: str, n: tuple[Column, Column, Column, Column], **columns: Column) -> DataFrame:
    made = {"provider": F.lit(provider), "request_id": F.lit(""), "account_uuid": F.lit(None).cast("string"), "source_file": F.col("file_path"), "seq": F.col("line_id")} | columns
    made |= dict(zip(("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens"), n, strict=True))
    names = ("provider session_id ts project model message_id request_id input_tokens output_tokens cache_creation_input_tokens cache_read_input_tokens "
             "account_uuid source_file seq").split()
    return df.select(*[made[c].cast("bigint").alias(c) if c.endswith("tokens") else made[c].alias(c) for c in names]).filter(F.col("ts").isNotNull())


def _id(tool: str, sid: Column, ts: Column, a: Column, b: Column) -> Column:
    return F.concat_ws(":", F.lit(tool), sid, ts.cast("string"), a.cast("string"), b.cast("string"))


def _parsed(lines: DataFrame, schema: str) -> DataFrame:
    return once(lines, "j", F.from_json("value", schema))


def extract_claude(lines: DataFrame) -> DataFrame:
    """Assistant messages, and those of agents inside progress lines; models in angle brackets ``<synthetic>`` are none."""
    kept = lines.filter(F.col("value").contains('"type":"assistant"') | F.col("value").contains('"type":"progress"'))
    j = _parsed(guarded(kept, '"type":"'), CLAUDE)
    own, agent = F.col("j.type") == "assistant", (F.col("j.type") == "progress") & (F.col("j.data.type") == "agent_progress")
    j = j.withColumn("m", F.when(own, F.col("j.message")).when(agent, F.col("j.data.message.message")))
    model = F.when(own, text(F.col("m.model"), F.col("value"), "$.message.model")).otherwise(text(F.col("m.model"), F.col("value"), "$.data.message.message.model"))
    at = F.when(own, rfc3339(F.col("j.timestamp"))).otherwise(rfc3339(F.coalesce("j.data.message.timestamp", "j.timestamp")))
    folder = F.coalesce(F.nullif(path_part(F.regexp_replace(string(F.col("j.cwd")), "/+$", ""), 1), F.lit("")), claude_project(claude_folder(F.col("file_path"))))
    use = "m.usage."
    out = j.withColumn("model", model).filter(F.col("m.usage").isNotNull() & F.col("model").isNotNull() & (F.col("model") != "<synthetic>"))
    return _record(out, "claude", tuple(tokens(F.col(use + c)) for c in ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")),
                   session_id=stem(F.col("file_path")), ts=at, project=folder, model=F.col("model"), message_id=F.coalesce(string(F.col("m.id")), F.lit("")),
                   request_id=F.coalesce(string(F.when(own, F.col("j.requestId")).otherwise(F.col("j.data.message.requestId"))), F.lit("")))


def extract_codex(lines: DataFrame) -> DataFrame:
    """Token counts of each turn, as given or as differences of running totals; model and totals are carried along the file.

    Only lines of the two kinds are kept, and of these the fields in use, before they are dealt by segments of the file.
    """
    turn = F.col("value").contains('"turn_context"')
    kept = lines.filter(turn | F.col("value").contains('"token_count"')).withColumn("turn", turn)
    j = _parsed(kept, CODEX)
    p, info = "j.payload.", "j.payload.info."
    model = F.coalesce(*[text(F.col("j" + x), F.col("value"), "$" + x) for x in (".payload.info.model", ".payload.info.metadata.model", ".payload.model", ".payload.metadata.model")])
    # A usage that is present but null counts as present.
    last_given = F.try_variant_get(F.try_parse_json("value"), "$.payload.info.last_token_usage", "variant").isNotNull()
    given = F.col(info + "last_token_usage").isNotNull() | (F.col("value").contains('"last_token_usage"') & F.coalesce(last_given, F.lit(False)))

    def read(use: str) -> Column:
        use = info + use
        return F.struct(tokens(F.col(f"{use}.input_tokens")).alias("a"), tokens(F.col(f"{use}.output_tokens")).alias("b"),
                        tokens(F.coalesce(f"{use}.cached_input_tokens", f"{use}.cache_read_input_tokens")).alias("c"))

    j = j.select("file_path", "block_start", "line_id", "turn", model.alias("own"), rfc3339(F.col("j.timestamp")).alias("at"), given.alias("given"),
                 F.coalesce(F.col(p + "type") == "token_count", F.lit(False)).alias("count"), read("last_token_usage").alias("last"),
                 F.when(F.col(info + "total_token_usage").isNotNull(), read("total_token_usage")).alias("total"))
    # Events whose time is broken don't move the totals.
    event = ~F.col("turn") & F.col("count") & F.col("at").isNotNull() & (F.col("given") | F.col("total").isNotNull())
    j = j.filter(event | F.col("turn") & F.col("own").isNotNull())
    j = carried(j, {"carried": F.when(F.col("turn"), F.col("own")), "before": F.when(~F.col("turn") & ~F.col("given"), F.col("total"))}, strict=("before",))
    added = {x: F.when(F.col("given"), F.col(f"last.{x}")).otherwise(F.greatest(F.col(f"total.{x}") - F.coalesce(f"before.{x}", F.lit(0)), F.lit(0))) for x in "abc"}
    out = j.filter(~F.col("turn")).withColumns(added).filter("a + b + c > 0")
    sid = F.coalesce(F.nullif(F.regexp_extract("file_path", r"/sessions/(.*?)(?:\.jsonl)?$", 1), F.lit("")), stem(F.col("file_path")))
    return _record(out, "codex", (F.col("a"), F.col("b"), F.lit(0), F.col("c")), session_id=sid, ts=F.col("at"),
                   project=F.coalesce(F.nullif(F.when(F.col("file_path").contains("/sessions/"), F.split_part(sid, F.lit("/"), F.lit(1))), F.lit("")), F.lit("codex")),
                   model=F.coalesce("own", "carried", F.lit("unknown")), message_id=_id("codex", sid, F.col("at"), F.col("a"), F.col("b")))


def extract_pi(lines: DataFrame) -> DataFrame:
    j = _parsed(guarded(lines, '"assistant"'), "timestamp string, message struct<role:string, model:string, usage:struct<input:bigint, output:bigint, cacheWrite:bigint, cacheRead:bigint>>")
    u, name = "j.message.usage.", stem(F.col("file_path"))
    sid = F.when(name.contains("_"), F.regexp_extract(name, "^[^_]*_(.*)$", 1)).otherwise(name)
    a, b, at = u64(F.col(u + "input")), u64(F.col(u + "output")), rfc3339(F.col("j.timestamp"))
    out = j.filter((F.col("j.message.role") == "assistant") & a.isNotNull() & b.isNotNull())
    return _record(out, "pi", (a, b, tokens(F.col(u + "cacheWrite")), tokens(F.col(u + "cacheRead"))), session_id=sid, ts=at,
                   project=F.coalesce(F.nullif(F.regexp_extract("file_path", "/sessions/([^/]+)/", 1), F.lit("")), F.lit("pi")),
                   model=F.coalesce(text(F.col("j.message.model"), F.col("value"), "$.message.model"), F.lit("unknown")), message_id=_id("pi", sid, at, a, b))


def extract_amp(docs: DataFrame) -> DataFrame:
    """Events of a document's ledger; cache tokens are those of the message that the event names (the last of equal ids).

    Events meet messages in an equi-join on document and message id, so a document's cost is linear in both. There are as many messages as
    events, so both sides are dealt: Spark takes a variant for 2 KB and what is read out of it for a fortieth of that, and would broadcast all messages.
    """
    schema = "id variant, usageLedger struct<events:array<struct<id:variant, timestamp:string, model:variant, tokens:struct<input:bigint, output:bigint>, toMessageId:bigint>>>"
    j = _parsed(docs, schema).select("file_path", "j", F.posexplode("j.usageLedger.events").alias("n", "e")).filter("e.tokens is not null")
    told = _parsed(docs, "messages array<struct<role:string, messageId:bigint, usage:variant>>").select("file_path", F.posexplode("j.messages").alias("at", "m"))
    # A message without usage says nothing, one with a null says none.
    told = told.filter("m.role = 'assistant' and m.messageId >= 0 and m.usage is not null")
    use = F.struct(*[integer(F.try_variant_get("m.usage", f"$.{c}", "variant")).alias(c) for c in ("cacheCreationInputTokens", "cacheReadInputTokens")])
    told = told.groupBy(F.col("file_path").alias("_file"), F.col("m.messageId").alias("_message")).agg(F.max_by(use, "at").alias("u"))
    j = j.join(told.hint("merge"), (F.col("file_path") == F.col("_file")) & (F.col("e.toMessageId") == F.col("_message")), "left")
    return _record(j.withColumn("line_id", F.col("n").cast("bigint")), "amp",
                   (tokens(F.col("e.tokens.input")), tokens(F.col("e.tokens.output")), tokens(F.col("u.cacheCreationInputTokens")), tokens(F.col("u.cacheReadInputTokens"))),
                   session_id=F.coalesce(string(F.col("j.id")), F.lit("unknown")), ts=rfc3339(F.col("e.timestamp")), project=F.lit("amp"),
                   model=F.coalesce(string(F.col("e.model")), F.lit("unknown")), message_id=F.coalesce(string(F.col("e.id")), F.lit("")))


OPENCODE = "id variant, sessionID variant, providerID variant, modelID variant, role string, time struct<created:bigint>, tokens struct<input:bigint, output:bigint, cache:struct<read:bigint, write:bigint>>"


def _opencode(j: DataFrame, sid: Column, mid: Column, project: Column) -> DataFrame:
    t = "j.tokens."
    a, b = tokens(F.col(t + "input")), tokens(F.col(t + "output"))
    model = string(F.col("j.modelID"))
    out = j.filter(model.isNotNull() & F.col("j.time.created").isNotNull() & F.col("j.tokens").isNotNull() & (a + b > 0))
    return _record(out, "opencode", (a, b, tokens(F.col(t + "cache.write")), tokens(F.col(t + "cache.read"))), session_id=sid, ts=millis(F.col("j.time.created")),
                   project=project, model=model, message_id=mid)


def opencode_kind(path: Column) -> Column:
    """``session`` or ``message``: the part of the path nearest to its end that is one of these; null for other files than JSON and other places."""
    part = F.filter(F.split(path, "/"), lambda p: p.isin("session", "message"))
    return F.when(path.endswith(".json"), F.try_element_at(part, F.lit(-1)))


def extract_opencode_files(docs: DataFrame) -> DataFrame:
    """The files of a storage folder, told apart by their path: messages with the projects of their sessions."""
    kind = opencode_kind(F.col("file_path"))
    return extract_opencode(docs.filter(kind == "message"), docs.filter(kind == "session"))


def opencode_sessions(docs: DataFrame) -> DataFrame:
    """One row (sid, project) for each session file; of equal ids the last path counts."""
    j = _parsed(docs, "id variant, directory variant, projectID variant")
    j = j.select("file_path", *[string(F.col(f"j.{c}")).alias(c) for c in ("id", "directory", "projectID")]).filter("id is not null")
    name = F.coalesce(F.nullif(path_part(F.regexp_replace("directory", "/+$", ""), 1), F.lit("")), F.col("projectID"), F.lit("opencode"))
    return j.groupBy(F.col("id").alias("sid")).agg(F.max_by(name, "file_path").alias("session_project"))


def extract_opencode(messages: DataFrame, sessions: DataFrame) -> DataFrame:
    """Message files with the project of their session. Sessions are far fewer than messages; Spark picks the join by their size."""
    j = _parsed(messages, OPENCODE).withColumns({"message": string(F.col("j.id")), "session": string(F.col("j.sessionID"))})
    j = j.filter(F.col("message").isNotNull() & string(F.col("j.providerID")).isNotNull())
    joined = j.join(opencode_sessions(sessions), F.col("session") == F.col("sid"), "left")
    return _opencode(joined, F.coalesce("session", F.lit("unknown")), F.col("message"), F.coalesce("session_project", F.lit("opencode")))


def extract_opencode_table(table: DataFrame) -> DataFrame:
    """Message table (id, session_id, data): assistant rows with tokens."""
    placed = table.withColumns({"file_path": F.lit("table"), "line_id": F.lit(0).cast("bigint")})
    j = once(placed, "j", F.from_json("data", OPENCODE)).filter("j.role = 'assistant'")
    return _opencode(j, F.coalesce("session_id", F.lit("unknown")), F.col("id"), F.lit("opencode"))


def extract_gemini(docs: DataFrame) -> DataFrame:
    """Messages of a session document; one field of a wrong type drops the whole document."""
    schema = "sessionId variant, projectHash variant, messages array<struct<id:variant, type:variant, model:variant, timestamp:variant, tokens:struct<input:bigint, output:bigint, cached:bigint>>>, _bad string"
    j = once(docs, "j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"})).filter("j._bad is null")
    bad = mistyped(F.col("j.sessionId"), F.col("j.projectHash")) | F.coalesce(
        F.exists("j.messages", lambda m: mistyped(m["id"], m["type"], m["model"], m["timestamp"])), F.lit(False))
    j = j.filter(~bad).select("file_path", "mtime", "j", F.posexplode("j.messages").alias("n", "m")).withColumn("line_id", F.col("n").cast("bigint"))
    a, b = tokens(F.col("m.tokens.input")), tokens(F.col("m.tokens.output"))
    model = string(F.col("m.model"))
    out = j.filter((string(F.col("m.type")) == "gemini") & F.col("m.tokens").isNotNull() & model.isNotNull() & (a + b > 0))
    sid = F.coalesce(string(F.col("j.sessionId")), F.lit("unknown"))
    return _record(out, "gemini", (a, b, F.lit(0), tokens(F.col("m.tokens.cached"))), session_id=sid, ts=F.coalesce(rfc3339(string(F.col("m.timestamp"))), F.col("mtime")),
                   project=F.coalesce(F.nullif(string(F.col("j.projectHash")), F.lit("")), F.lit("gemini")), model=model,
                   message_id=F.concat_ws(":", F.lit("gemini"), sid, F.coalesce(string(F.col("m.id")), F.lit("unknown"))))


def extract_droid(docs: DataFrame) -> DataFrame:
    """One record for each settings file; a field of a wrong type drops it."""
    schema = "model variant, providerLockTimestamp variant, tokenUsage struct<inputTokens:bigint, outputTokens:bigint, cacheCreationTokens:bigint, cacheReadTokens:bigint>, _bad string"
    j = once(docs.filter(F.col("file_path").endswith(".settings.json")), "j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad"}))
    u = "j.tokenUsage."
    a, b = tokens(F.col(u + "inputTokens")), tokens(F.col(u + "outputTokens"))
    bad = mistyped(F.col("j.model"), F.col("j.providerLockTimestamp"))
    out = j.filter(F.col("j._bad").isNull() & ~bad & F.col("j.tokenUsage").isNotNull() & (a + b > 0))
    sid = F.regexp_replace(path_part(F.col("file_path"), 1), r"\.settings\.json$", "")
    at = F.coalesce(rfc3339(string(F.col("j.providerLockTimestamp"))), F.col("mtime"))
    return _record(out, "droid", (a, b, tokens(F.col(u + "cacheCreationTokens")), tokens(F.col(u + "cacheReadTokens"))), session_id=sid, ts=at, project=F.lit("droid"),
                   model=F.coalesce(droid_model(string(F.col("j.model"))), F.lit("unknown")), message_id=_id("droid", sid, at, a, b))


def extract_openclaw(lines: DataFrame) -> DataFrame:
    """Assistant messages; the model is carried along the file from model changes."""
    change = F.col("value").contains('"model_change"')
    kept = lines.filter(change | F.col("value").contains('"message"') & F.col("value").contains('"assistant"')).withColumn("change", change)
    j = _parsed(kept, "model string, message struct<role:string, model:string, timestamp:bigint, usage:struct<input:bigint, output:bigint, cacheRead:bigint, cacheWrite:bigint>>")
    u = "j.message.usage."
    a, b = tokens(F.col(u + "input")), tokens(F.col(u + "output"))
    own = F.when(F.col("change"), text(F.col("j.model"), F.col("value"), "$.model")).otherwise(text(F.col("j.message.model"), F.col("value"), "$.message.model"))
    said = ~F.col("change") & (F.col("j.message.role") == "assistant") & F.col("j.message.usage").isNotNull() & (a + b > 0)
    j = j.select("file_path", "block_start", "line_id", "change", own.alias("own"), millis(F.col("j.message.timestamp")).alias("at"), a.alias("a"), b.alias("b"),
                 tokens(F.col(u + "cacheWrite")).alias("w"), tokens(F.col(u + "cacheRead")).alias("r"), said.alias("said"))
    out = carried(j.filter(F.col("said") | F.col("change") & F.col("own").isNotNull()), {"carried": F.when(F.col("change"), F.col("own"))}).filter(~F.col("change"))
    sid, at = stem(F.col("file_path")), F.col("at")
    return _record(out, "openclaw", tuple(F.col(x) for x in "abwr"), session_id=sid, ts=at,
                   project=F.coalesce(F.nullif(F.regexp_extract("file_path", "/agents/([^/]+)/", 1), F.lit("")), F.lit("openclaw")),
                   model=F.coalesce("own", "carried", F.lit("unknown")), message_id=_id("openclaw", sid, at, F.col("a"), F.col("b")))


def extract_kimi(lines: DataFrame, default_model: str | None = None) -> DataFrame:
    """Status updates of wire logs; the model is the line's, else the configured, else a fixed one."""
    schema = ("type string, model variant, timestamp double, message struct<type:string, payload:struct<message_id:variant, "
              "token_usage:struct<input_other:bigint, output:bigint, input_cache_creation:bigint, input_cache_read:bigint>>>")
    j = _parsed(guarded(lines, "token_usage"), schema)
    u = "j.message.payload.token_usage."
    a, b = tokens(F.col(u + "input_other")), tokens(F.col(u + "output"))
    out = j.filter((F.coalesce("j.type", F.lit("")) != "metadata") & (F.col("j.message.type") == "StatusUpdate") & F.col("j.message.payload.token_usage").isNotNull() & (a + b > 0))
    sid, group = path_part(F.col("file_path"), 2), path_part(F.col("file_path"), 3)
    at = millis(F.when(F.abs("j.timestamp") <= LAST_MILLI / 1000, F.floor(F.col("j.timestamp") * 1000).cast("bigint")))
    return _record(out, "kimi", (a, b, tokens(F.col(u + "input_cache_creation")), tokens(F.col(u + "input_cache_read"))), session_id=sid, ts=at,
                   project=F.when(group.isin("", "sessions"), "kimi").otherwise(group), model=F.coalesce(string(F.col("j.model")), F.lit(default_model or "kimi-for-coding")),
                   message_id=F.coalesce(string(F.col("j.message.payload.message_id")), _id("kimi", sid, at, a, b)))


EXTRACTORS = {"claude": extract_claude, "codex": extract_codex, "pi": extract_pi, "amp": extract_amp, "opencode": extract_opencode, "gemini": extract_gemini,
              "droid": extract_droid, "openclaw": extract_openclaw, "kimi": extract_kimi}

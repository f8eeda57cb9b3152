"""Tables of the model, as DDL, and the fixed dimension of plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROVIDERS = ("claude", "codex", "gemini", "pi", "amp", "opencode", "openclaw", "droid", "kimi")

TOKENS = ("input_tokens", "output_tokens", "cache_creation_input_tokens", "cache_read_input_tokens")

#: One record of use; source_file and seq only break ties.
USAGE = (
    "provider string, session_id string, ts timestamp, project string, model string, message_id string, request_id string, "
    "input_tokens bigint, output_tokens bigint, cache_creation_input_tokens bigint, cache_read_input_tokens bigint, "
    "account_uuid string, source_file string, seq bigint"
)

#: Lines and whole documents as the readers give them to the extractors.
LINES = "file_path string, block_start bigint, line_id bigint, mtime timestamp, size bigint, value string"

#: Plan, label, capacity in units, USD a month, the plans above and below.
PLANS = [
    ("pro", "Claude Pro", 1.0, 20.0, "max5x", None),
    ("max5x", "Claude Max (5x)", 5.0, 100.0, "max20x", "pro"),
    ("max20x", "Claude Max (20x)", 20.0, 200.0, None, "max5x"),
]


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, "plan string, label string, units double, price double, higher string, lower string")

"""Live totals with state, and streams over files that grow."""

import datetime as dt
import json
import random
import time

import pytest
from pyarrow import fs
from pyspark.sql import functions as F
from test_usage import at, prices, usage  # noqa: F401
from usagelake.operators import filters
from usagelake.plans import queries
from usagelake.schema import TOKENS
from usagelake.sources import ingest, providers
from usagelake.streaming import growing, live


def land(df, path):
    df.coalesce(1).write.mode("append").parquet(path)


def run(spark, path, schema, totals, tmp_path, name="live_view", per_trigger=None):
    query = live.start(live.read_usage(spark, path, schema, per_trigger), totals, name, str(tmp_path / "state"), once=True)
    query.awaitTermination()
    return query


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_an_earlier_duplicate_that_lands_days_late_is_put_in_place(spark, prices, tmp_path):  # noqa: F811
    path, totals = str(tmp_path / "landed"), live.Totals(prices)
    land(usage(spark, [{"message_id": "x", "ts": at(5, 9), "input_tokens": 100}, {"message_id": "y", "ts": at(6, 9)}]), path)
    schema = spark.read.parquet(path).schema
    run(spark, path, schema, totals, tmp_path)
    assert [r.bucket for r in totals.report(spark.table("live_view")).collect()] == ["2024-01-09"]
    # The record that counts for x is now one of another day and another model without a price.
    land(usage(spark, [{"message_id": "x", "ts": at(5, 2), "model": "free", "input_tokens": 7}, {"message_id": "y", "ts": at(8, 11)}]), path)
    run(spark, path, schema, totals, tmp_path)
    want = live.live_totals(spark.read.parquet(path), prices)
    got = totals.report(spark.table("live_view"))
    assert rows(got) == rows(want) and {r.bucket: r.cost is None for r in got.collect()} == {"2024-01-02": True, "2024-01-09": False}
    # Moved away altogether: a bucket without records is gone.
    land(usage(spark, [{"message_id": "y", "ts": at(1, 3)}]), path)
    run(spark, path, schema, totals, tmp_path)
    assert {r.bucket for r in totals.report(spark.table("live_view")).collect()} == {"2024-01-02", "2024-01-03"}


@pytest.mark.parametrize("per_trigger", [None, 1])
def test_totals_equal_the_batch_query_in_any_order_of_files(spark, prices, tmp_path, per_trigger):  # noqa: F811
    rng = random.Random(8)
    path = str(tmp_path / "landed")
    chosen = lambda kept: filters.by_project(kept, "Q")
    totals = live.Totals(prices, "daily", chosen)
    for _ in range(3):
        made = [{"message_id": f"m{rng.randrange(12)}", "request_id": rng.choice(["", "r"]), "ts": at(rng.randrange(2000), rng.randint(1, 20)), "model": rng.choice(["m", "other"]),
                 "project": rng.choice(["pq", "p"]), "account_uuid": rng.choice([None, "", "a"]), "input_tokens": rng.randrange(1000)} for _ in range(40)]
        made += [{"message_id": "", "request_id": "", "ts": at(rng.randrange(2000))} for _ in range(200)]  # a hot key
        land(usage(spark, made), path)
        schema = spark.read.parquet(path).schema
        run(spark, path, schema, totals, tmp_path, per_trigger=per_trigger)
        assert rows(totals.report(spark.table("live_view"))) == rows(live.live_totals(spark.read.parquet(path), prices, "daily", chosen))
    assert len(live.versions(spark, str(tmp_path / "state"))) == 2


def test_a_second_trigger_reads_its_own_files_only(spark, prices, tmp_path):  # noqa: F811
    path, totals = str(tmp_path / "landed"), live.Totals(prices)
    first = usage(spark, [{"message_id": f"a{i}"} for i in range(500)])
    land(first, path)
    run(spark, path, first.schema, totals, tmp_path)
    land(usage(spark, [{"message_id": "b"}]), path)
    query = run(spark, path, first.schema, totals, tmp_path)
    assert sum(p.numInputRows for p in query.recentProgress) == 1
    assert totals.report(spark.table("live_view")).first().input_tokens == 2 * 501


def test_a_trigger_that_fails_is_run_again(spark, prices, tmp_path):  # noqa: F811
    path = str(tmp_path / "landed")
    df = usage(spark, [{"message_id": "a"}, {"message_id": "b"}])
    land(df, path)

    class Broken(live.Totals):
        def of(self, signed):
            signed.count()
            raise RuntimeError("on purpose")

    with pytest.raises(Exception, match="on purpose"):
        run(spark, path, df.schema, Broken(prices), tmp_path)
    totals = live.Totals(prices)
    run(spark, path, df.schema, totals, tmp_path)
    assert totals.report(spark.table("live_view")).first().input_tokens == 4


def test_keys_share_states(spark, prices, tmp_path, monkeypatch):  # noqa: F811
    """A call of Python for a group of keys, not for each key, in the first trigger and in one with duplicates."""
    monkeypatch.setattr(live, "GROUPS", 8, raising=False)
    path, totals = str(tmp_path / "landed"), live.Totals(prices)
    first = usage(spark, [{"message_id": f"a{i}", "project": None, "ts": at(100 + i)} for i in range(300)])
    for more in (first, usage(spark, [{"message_id": f"a{i}", "account_uuid": "" if i % 2 else None, "model": "free", "ts": at(i)} for i in range(200, 400)])):
        land(more, path)
        query = run(spark, path, first.schema, totals, tmp_path)
        assert 0 < query.recentProgress[0]["stateOperators"][0]["numRowsUpdated"] <= 8
        assert rows(totals.report(spark.table("live_view"))) == rows(live.live_totals(spark.read.parquet(path), prices))
    assert {r.model: r.n for r in spark.table("live_view").groupBy("model").sum("n").withColumnRenamed("sum(n)", "n").collect()} == {"m": 200, "free": 200}


def test_lines_as_shown(spark, prices, tmp_path):  # noqa: F811
    path, totals = str(tmp_path / "landed"), live.Totals(prices, "all")
    df = usage(spark, [{"model": "claude-a-20250101"}])
    run(spark, path_of_empty(spark, df, path), df.schema, totals, tmp_path)
    assert totals.line(spark.table("live_view"), "Today").first().text == "Today: $0.00"
    land(df, path)
    run(spark, path, df.schema, totals, tmp_path)
    assert totals.line(spark.table("live_view"), "Today").first().text == "Today: N/A"
    land(usage(spark, [{"message_id": "z", "input_tokens": 5_000_000}]), path)
    run(spark, path, df.schema, totals, tmp_path)
    assert totals.line(spark.table("live_view"), "Today", "E", 0.5).first().text == "Today: E2.50 | m: E2.50"


def path_of_empty(spark, df, path):
    df.filter("false").write.parquet(path)
    return path


def test_an_interval_renews_by_itself(spark, prices, tmp_path):  # noqa: F811
    path, totals = str(tmp_path / "landed"), live.Totals(prices)
    df = usage(spark, [{"message_id": "a"}])
    land(df, path)
    query = live.start(live.read_usage(spark, path, df.schema), totals, "ticking", str(tmp_path / "state"), interval="200 milliseconds")
    try:
        for n, message in ((1, None), (2, "b"), (3, "c")):
            if message:
                land(usage(spark, [{"message_id": message}]), path)
            until = time.time() + 60
            while time.time() < until and [r.n for r in spark.table("ticking").groupBy().sum("n").withColumnRenamed("sum(n)", "n").collect()] != [n]:
                time.sleep(0.2)
            assert totals.report(spark.table("ticking")).first().input_tokens == 2 * n
    finally:
        query.stop()


def claude_line(i, minute, model="m"):
    return json.dumps({"type": "assistant", "timestamp": f"2024-01-02T00:{minute:02d}:00Z", "requestId": "r", "message": {
        "id": f"m{i}", "model": model, "usage": {"input_tokens": 3, "output_tokens": 1}}}, separators=(",", ":")) + "\n"


def test_totals_follow_a_growing_file(spark, prices, tmp_path):  # noqa: F811
    logs, landed, totals = tmp_path / "logs" / "projects" / "-home-u-git-app", str(tmp_path / "landed"), live.Totals(prices)
    logs.mkdir(parents=True)

    def refresh():
        growing.land(growing.read_growing(spark, [str(tmp_path / "logs")]), providers.extract_claude, landed, str(tmp_path / "land"), once=True).awaitTermination()
        run(spark, landed, spark.read.option("recursiveFileLookup", True).parquet(landed).schema, totals, tmp_path)
        return sum(r.input_tokens for r in totals.report(spark.table("live_view")).collect())

    file = logs / "s1.jsonl"
    file.write_text(claude_line(1, 1) + claude_line(2, 2))
    assert refresh() == 6
    whole = claude_line(3, 3)
    with file.open("a") as f:
        f.write(whole[:20])  # a line without its end waits
    assert refresh() == 6
    with file.open("a") as f:
        f.write(whole[20:])
    (logs / "s2.jsonl").write_text(claude_line(4, 4) + "\r\n" + claude_line(2, 1))
    assert refresh() == 12  # the repeated message counts once
    file.write_text(claude_line(5, 5))  # shorter than before: a new file
    assert refresh() == 15
    assert refresh() == 15


def test_growing_logs_hold_every_record_of_the_table(spark, monkeypatch):
    """Of all tools, with all ids, and of tables larger than a log file may be: the totals are those of the daily report."""
    monkeypatch.setattr(queries, "LOG_LINES", 50, raising=False)
    monkeypatch.setattr(ingest, "MOST_FILE", 20_000)
    folder = "/root/testdata/sf0.001"
    got, want = (queries.QUERIES[name](spark, folder).select("bucket", *TOKENS, F.round("cost", 9).alias("cost")) for name in ("stream_growing", "report_daily"))
    assert rows(got) == rows(want) and got.count() > 1


def codex(kind, **payload):
    return json.dumps({"timestamp": "2024-01-02T00:00:00Z", "type": kind, "payload": {"type": kind, **payload}}) + "\n"


def test_a_model_is_carried_over_the_place_where_a_file_has_grown(spark, prices, tmp_path):  # noqa: F811
    logs, landed, totals = tmp_path / "sessions" / "a", str(tmp_path / "landed"), live.Totals(prices)
    logs.mkdir(parents=True)
    total = lambda n: codex("token_count", info={"total_token_usage": {"input_tokens": n, "output_tokens": 0}})
    for more, want in ((codex("turn_context", model="m") + total(10), {"m": 10}), (total(25), {"m": 25}), (codex("turn_context", model="k") + total(26), {"m": 25, "k": 1})):
        with (logs / "s.jsonl").open("a") as f:
            f.write(more)
        growing.land(growing.read_growing(spark, [str(tmp_path / "sessions")], whole=True), providers.extract_codex, landed, str(tmp_path / "land"), once=True).awaitTermination()
        run(spark, landed, spark.read.option("recursiveFileLookup", True).parquet(landed).schema, totals, tmp_path)
        assert {r.model: r.input_tokens for r in spark.table("live_view").collect()} == want


def test_ranges_of_a_file_give_each_line_once(tmp_path):
    rng = random.Random(3)
    lines = ["x" * rng.choice([0, 1, 5, 40, 300]) + str(i) for i in range(200)]
    file = tmp_path / "f.jsonl"
    file.write_bytes("\n".join(lines).encode() + b"\nhalf a line")
    reader = growing.GrowingReader({"paths": f"file://{tmp_path}", "split": "97"})
    end = reader.latestOffset()
    parts = reader.partitions({}, end)
    assert len(parts) > 50
    store = fs.LocalFileSystem()
    got = [line.decode() for p in parts for held in growing.lines_of(store, p) for _, line in held]
    assert got == lines and reader.partitions(end, end) == []
    half = end[str(file)] // 2
    start = growing._after_line_end(file.open("rb"), half, end[str(file)])
    rest = [line.decode() for p in reader.partitions({str(file): start}, end) for held in growing.lines_of(store, p) for _, line in held]
    assert rest == lines[-len(rest) :] and 0 < len(rest) < 200


def test_times_and_signs_of_changes(spark, tmp_path):
    """Records go through the state unchanged, to the microsecond, with nulls and any text."""
    path = str(tmp_path / "landed")
    odd = usage(spark, [{"message_id": "é\"\\\n", "project": None, "ts": dt.datetime(1969, 12, 31, 23, 59, 59, 999999), "input_tokens": 9_223_372_036_854_775_807}])
    land(odd, path)
    out = live.changes(live.read_usage(spark, path, odd.schema)).writeStream.outputMode("update").foreachBatch(
        lambda b, n: b.write.mode("overwrite").parquet(str(tmp_path / "out"))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert rows(got.drop("sign")) == rows(odd) and got.select(F.sum("sign")).first()[0] == 1

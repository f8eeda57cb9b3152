"""Tables with versions, merges that die, and the index of keys."""

import random

import pytest
from pyspark.sql import functions as F
from test_usage import at, usage
from usagelake.operators.dedup import dedup
from usagelake.sources import ingest, storage
from usagelake.sources.table import KeyIndex, UsageTable, VersionedTable, partition

FILES = "provider string, path string, mtime bigint, size bigint"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def of_files(spark, made):
    """Records (file, day, tokens) as usage."""
    df = usage(spark, [{"ts": at(5 + i % 3, d), "input_tokens": n, "message_id": f"{f}-{i}", "request_id": f} for i, (f, d, n) in enumerate(made)])
    return df.withColumns({"source_file": F.col("request_id"), "ts": F.col("ts").cast("timestamp")})


def listing(spark, *files):
    return spark.createDataFrame([("claude", f, m, 1) for f, m in files], FILES)


def shown(table):
    return sorted((r.source_file, r.usage_date.day, r.input_tokens) for r in table.read().collect())


def test_merges_touch_their_days_only(spark, tmp_path):
    table = UsageTable(spark, str(tmp_path))
    table.merge(of_files(spark, [("a", 1, 1), ("a", 2, 2), ("b", 2, 3), ("c", 9, 4)]), listing(spark, ("a", 1), ("b", 1), ("c", 1)))
    before = table.rows.partitions()
    assert shown(table) == [("a", 1, 1), ("a", 2, 2), ("b", 2, 3), ("c", 9, 4)] and len(before) == 3
    changed = ingest.plan_ingest(listing(spark, ("a", 2), ("b", 1), ("c", 1)), table.manifest())
    assert [r.path for r in changed.collect()] == ["a"]
    table.merge(of_files(spark, [("a", 2, 20), ("a", 3, 30)]), changed)  # a has no records of day 1 any more
    after = table.rows.partitions()
    assert shown(table) == [("a", 2, 20), ("a", 3, 30), ("b", 2, 3), ("c", 9, 4)]
    assert after[partition(provider="claude", usage_date="2024-01-09")] == before[partition(provider="claude", usage_date="2024-01-09")]
    assert partition(provider="claude", usage_date="2024-01-01") not in after
    # Readers of the version before still have it.
    assert len(table.rows.read(version=0).collect()) == 4
    table.merge(of_files(spark, []), listing(spark, ("b", 5)))
    assert shown(table) == [("a", 2, 20), ("a", 3, 30), ("c", 9, 4)] and table.manifest().filter("path = 'b'").first().mtime == 5
    table.prune(listing(spark, ("c", 1)))
    assert shown(table) == [("c", 9, 4)] and [r.path for r in table.manifest().collect()] == ["c"]
    table.rows.clean(keep=1)
    assert shown(table) == [("c", 9, 4)] and len(storage.names(spark, f"{tmp_path}/usage/data")) == 1


def test_a_merge_that_dies_leaves_the_table(spark, tmp_path):
    table = UsageTable(spark, str(tmp_path))
    first = of_files(spark, [("a", 1, 1), ("b", 2, 2)])
    table.merge(first, listing(spark, ("a", 1), ("b", 1)))
    broken = of_files(spark, [("a", 1, 5), ("a", 3, 6)])
    dies = broken.withColumn("output_tokens", F.when(F.col("input_tokens") == 6, F.raise_error(F.lit("on purpose"))).otherwise(F.lit(1)).cast("bigint"))
    with pytest.raises(Exception, match="on purpose"):
        table.merge(dies, listing(spark, ("a", 2)))
    assert shown(table) == [("a", 1, 1), ("b", 2, 2)]
    # Rows written and committed, the list of files not: the same merge again gives the same rows.
    files, table.files.replace = table.files.replace, lambda *_: (_ for _ in ()).throw(RuntimeError("stopped"))
    with pytest.raises(RuntimeError, match="stopped"):
        table.merge(broken, listing(spark, ("a", 2)))
    table.files.replace = files
    assert [r.path for r in ingest.plan_ingest(listing(spark, ("a", 2), ("b", 1)), table.manifest()).collect()] == ["a"]
    table.merge(broken, listing(spark, ("a", 2)))
    assert shown(table) == [("a", 1, 5), ("a", 3, 6), ("b", 2, 2)]


def test_of_two_changes_at_a_time_one_fails(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path), "x int, p string", ("p",))
    one = spark.createDataFrame([(1, "a"), (2, "b c/d")], "x int, p string")
    with pytest.raises(ValueError):
        table.replace(one, ["p=a"])
    assert table.version() == -1 and table.read().count() == 0
    table.append(one)
    table.append(one.filter("x = 2"))
    assert rows(table.read()) == [(1, "a"), (2, "b c/d"), (2, "b c/d")]
    table.version = lambda: 0  # as another writer saw it
    with pytest.raises(FileExistsError):
        table.append(one)
    assert rows(VersionedTable(spark, str(tmp_path), "x int, p string", ("p",)).read()) == [(1, "a"), (2, "b c/d"), (2, "b c/d")]
    assert not [n for n in storage.names(spark, f"{tmp_path}/versions") if "draft" in n]


@pytest.mark.parametrize("bits", [1 << 20, 8])
def test_known_keys(spark, tmp_path, bits):
    """Against deduplication of all; with eight bits nearly everything may be known."""
    rng = random.Random(bits)
    index, before = KeyIndex(spark, str(tmp_path), bits), []
    for _ in range(3):
        made = [{"message_id": rng.choice(["", None, *map(str, range(30))]), "request_id": rng.choice(["r", "q"]), "ts": at(rng.randrange(5000)), "account_uuid": rng.choice([None, "", "x"])} for _ in range(60)]
        new = usage(spark, made)
        got = {r.seq: (r.known, r.known_ts) for r in index.known(new).collect()}
        for i, r in enumerate(made):
            key = (r["message_id"], r["request_id"], r["account_uuid"] or "")
            times = [b["ts"] for b in before if (b["message_id"], b["request_id"], b["account_uuid"] or "") == key]
            assert got[i][0] == bool(times) and (not times or got[i][1].replace(tzinfo=None) == min(times))
        kept = {r.seq for r in index.unseen(new).collect()}
        assert kept == {r.seq for r in dedup(new).collect() if not got[r.seq][0]}
        index.add(new)
        before += made
    index.compact()
    assert index.known(new).filter("not known").count() == 0
    assert all(len(f) == 1 for f in index.keys.partitions().values())


def test_new_keys_read_nothing_of_the_index(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path))
    index.add(usage(spark, [{"message_id": f"a{i}"} for i in range(3000)]))
    new = usage(spark, [{"message_id": f"b{i}"} for i in range(50)])
    maybe = index._marked(new).filter("_maybe")
    assert maybe.count() == 0
    read = []
    index.keys.read = lambda version=None, only=None, f=index.keys.read: read.append(list(only)) or f(version, only)
    assert index.known(new).filter("known").count() == 0 and read == [[]]
    seen = usage(spark, [{"message_id": "a7"}])
    out = index.known(seen)
    assert out.first().known and len(read[-1]) == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    semi = [line for line in plan.splitlines() if "LeftSemi" in line]
    assert semi and all("BroadcastHashJoin" in line for line in semi), plan  # the index isn't dealt out anew

"""Live totals with Structured Streaming: a trigger reads only what has landed since the last one.

The stream keeps one state for each key of the deduplication: the record that counts, the first by time, file and place. A record that
lands late and comes before it takes its place, and the stream gives out both with their signs, so totals are corrected whatever the
age of a file. Keys are dealt by their hash into ``GROUPS`` groups, and the records that count for a group's keys are one value in RocksDB, saved with the
checkpoint: a call of Python for each key would take milliseconds a key. Records of one key are reduced within each task before they are dealt, so a key
that a third of all records share sends a few rows a task.

Totals are sums by bucket and model, which a trigger adds to those of the trigger before: their size is that of the report. A trigger that is run
again after a failure writes its own version again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from usagelake.functions.text import format_cost, short_model
from usagelake.operators.cost import cost_sum, price
from usagelake.operators.dedup import KEY, dedup
from usagelake.operators.reports import bucket, sums
from usagelake.schema import TOKENS
from usagelake.sources import storage

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = "spark.sql.streaming.stateStore.providerClass"
#: Groups of keys that share a value of state; of a checkpoint's life it is one number. A trigger reads and writes the values of the groups that its records are in.
GROUPS = 2048
_PACKED = "key string, ts long, file string, seq long, record string"
_HELD = pa.schema([("key", pa.string()), ("ts", pa.int64()), ("file", pa.string()), ("seq", pa.int64()), ("record", pa.string())])


def read_usage(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files of usage records as they land, in the folder or below; a file is read once, whatever its age."""
    read = spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFileAge", "36500d")
    return (read.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else read).parquet(path)


def _packed(usage: DataFrame) -> DataFrame:
    """Key and the whole record as JSON, and its place; times as microseconds. A missing place comes first."""
    def of(name: str, kind: str) -> Column:
        return F.col(name).cast(kind) if name in usage.columns else F.lit(None).cast(kind)

    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    record = F.to_json(F.struct(*[micros.alias("ts") if c == "ts" else F.col(c) for c in usage.columns]))
    first = F.lit(-(1 << 63))
    key = F.to_json(F.struct(*KEY, F.coalesce("account_uuid", F.lit("")).alias("account")))
    return usage.select(
        key.alias("key"), F.coalesce(micros, first).alias("ts"),
        F.coalesce(F.concat(F.lit("/"), of("source_file", "string")), F.lit("")).alias("file"), F.coalesce(of("seq", "bigint"), first).alias("seq"), record.alias("record"))


def _earliest(columns: list[list], kept: dict[str, tuple]) -> None:
    """Put the first record of each key into ``kept``."""
    for key, *row in zip(*columns, strict=True):
        if key not in kept or tuple(row) < kept[key]:
            kept[key] = tuple(row)


def _table(kept: dict[str, tuple]) -> pa.Table:
    columns = zip(*[(key, *row) for key, row in kept.items()], strict=True) if kept else [()] * len(_HELD)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns, _HELD, strict=True)], schema=_HELD)


def _combined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the records of one key in a batch of a task the first."""
    for batch in batches:
        kept: dict[str, tuple] = {}
        _earliest([c.to_pylist() for c in batch.columns], kept)
        yield from _table(kept).to_batches()


def _first(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """For each key of the group the record that counts from now on with sign 1, and the one that did so far with sign -1, if they differ.

    The state is a compressed Arrow stream; of its rows only those of the keys that have come are looked at one by one.
    """
    new: dict[str, tuple] = {}
    for frame in frames:
        _earliest([frame[c].tolist() for c in _HELD.names], new)
    held = pa.ipc.open_stream(bytes(state.get[0])).read_all() if state.exists else _table({})
    old: dict[str, tuple] = {}
    _earliest([c.to_pylist() for c in held.filter(pc.is_in(held["key"], value_set=pa.array(list(new), pa.string()))).columns], old)
    new = {key: row for key, row in new.items() if key not in old or row < old[key]}
    if new:
        gone = [key for key in new if key in old]
        stays = held.filter(pc.invert(pc.is_in(held["key"], value_set=pa.array(gone, pa.string()))))
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _HELD, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(pa.concat_tables([stays, _table(new)]).combine_chunks())
        state.update((sink.getvalue().to_pybytes(),))
        yield pd.DataFrame([(old[key][-1], -1) for key in gone] + [(row[-1], 1) for row in new.values()], columns=["record", "sign"])


def changes(usage: DataFrame) -> DataFrame:
    """The records of a stream that count, as they come (``sign`` 1) and go (-1): at any time their sum is ``dedup`` of all that has landed."""
    packed = _packed(usage).mapInArrow(_combined, _PACKED)
    dealt = packed.withColumn("keys", F.pmod(F.xxhash64("key"), F.lit(GROUPS)).cast("int"))
    signed = dealt.groupBy("keys").applyInPandasWithState(_first, "record string, sign int", "held binary", "update", GroupStateTimeout.NoTimeout)
    kind = usage.schema["ts"].dataType
    fields = T.StructType([T.StructField(f.name, T.LongType() if f.name == "ts" else f.dataType) for f in usage.schema])
    out = signed.select(F.from_json("record", fields).alias("r"), "sign").select("r.*", "sign")
    return out.withColumn("ts", F.timestamp_micros("ts").cast(kind))


@dataclass(frozen=True)
class Totals:
    """Sums of a live view by bucket and model. ``chosen`` filters rows; like all filters it works on what deduplication has kept."""

    pricing: DataFrame
    by: str = "daily"
    chosen: Callable[[DataFrame], DataFrame] | None = None

    def of(self, signed: DataFrame) -> DataFrame:
        """Sums of signed records: bucket, model, n, priced, four kinds of tokens, cost."""
        kept = price(self.chosen(signed) if self.chosen else signed, self.pricing)
        plus = lambda c: F.sum(F.when(F.col("sign") > 0, c).otherwise(-c))
        return kept.groupBy(bucket(self.by).alias("bucket"), "model").agg(
            F.sum("sign").alias("n"), F.sum(F.when(F.col("cost").isNotNull(), F.col("sign")).otherwise(0)).alias("priced"), *[plus(F.col(c)).alias(c) for c in TOKENS],
            plus(F.col("cost")).cast("decimal(38,12)").alias("cost"))

    @staticmethod
    def added(*parts: DataFrame) -> DataFrame:
        """Sums of sums; what has no record left is gone."""
        both = parts[0]
        for more in parts[1:]:
            both = both.unionByName(more)
        out = both.groupBy("bucket", "model").agg(
            *[F.sum(c).alias(c) for c in ("n", "priced", *TOKENS)], F.sum(F.coalesce("cost", F.lit(0))).cast("decimal(38,12)").alias("cost"))
        return out.filter("n <> 0")

    @staticmethod
    def _cost() -> Column:
        return F.when(F.sum("priced") > 0, F.sum("cost")).cast("double").alias("cost")

    def report(self, table: DataFrame) -> DataFrame:
        """One row a bucket; a bucket without a priced record has no cost."""
        return table.groupBy("bucket").agg(*sums(), self._cost())

    def models(self, table: DataFrame) -> DataFrame:
        """Cost of each model."""
        return table.groupBy("model").agg(self._cost())

    def line(self, table: DataFrame, label: str, sign: str = "$", rate: float = 1.0) -> DataFrame:
        """One row ``text``: label, cost of all, and of each model that costs anything, the dearest first; without records a cost of 0."""
        models = table.groupBy("model").agg(self._cost(), F.sum("n").alias("n"))
        part = F.struct((-F.col("cost")).alias("c"), "model")
        out = models.agg(F.sum("cost").alias("cost"), F.sum("n").alias("n"), F.array_sort(F.collect_list(F.when(F.col("cost") > 0, part))).alias("parts"))
        total = F.when(F.coalesce("n", F.lit(0)) == 0, F.lit(0.0)).otherwise(F.col("cost") * rate)
        each = F.transform("parts", lambda p: F.concat(short_model(p["model"]), F.lit(": "), format_cost(-p["c"] * rate, sign)))
        return out.select(F.concat(F.lit(f"{label}: "), format_cost(total, sign), F.when(F.size("parts") > 0, F.concat(F.lit(" | "), F.array_join(each, ", "))).otherwise("")).alias("text"))


def live_totals(usage: DataFrame, pricing: DataFrame, by: str = "daily", chosen: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The rows of ``Totals.report`` over a whole table, without a stream."""
    kept = dedup(usage.withColumn("ts", F.col("ts").cast("timestamp")))
    return price(chosen(kept) if chosen else kept, pricing).groupBy(bucket(by).alias("bucket")).agg(*sums(), cost_sum("ignore").alias("cost"))


def versions(spark: SparkSession, checkpoint: str) -> list[int]:
    return sorted(int(x) for x in storage.names(spark, f"{checkpoint}-totals") if x.isdigit())


def start(usage: DataFrame, totals: Totals, name: str, checkpoint: str, once: bool = False, interval: str = "2 seconds") -> StreamingQuery:
    """Keep the sums of ``totals`` over the stream ``usage`` as the view ``name``, renewed every interval in which records land, or once.

    ``totals.report``, ``models`` and ``line`` of that view are what is shown. The last two versions are kept beside the checkpoint; a
    version that fails half-way is written again from the one before. Prices are those of the start.
    """
    spark, checkpoint = usage.sparkSession, checkpoint.rstrip("/")
    place = lambda n: f"{checkpoint}-totals/{n}"
    fields = ", ".join(["bucket string", "model string", "n bigint", "priced bigint", *[f"{c} bigint" for c in TOKENS], "cost decimal(38,12)"])

    def renew(signed: DataFrame, number: int) -> None:
        new = totals.of(signed)
        if number:
            new = totals.added(new, spark.read.schema(fields).parquet(place(number - 1)))
        else:
            new = totals.added(new)
        new.write.mode("overwrite").parquet(place(number))
        spark.read.schema(fields).parquet(place(number)).createOrReplaceTempView(name)
        storage.remove(spark, place(number - 2))

    have = versions(spark, checkpoint)
    (spark.read.schema(fields).parquet(place(have[-1])) if have else spark.createDataFrame([], fields)).createOrReplaceTempView(name)
    if spark.conf.get(_STATE, ROCKSDB) != ROCKSDB or not spark.conf.get(_STATE, None):
        spark.conf.set(_STATE, ROCKSDB)
    write = changes(usage).writeStream.outputMode("update").foreachBatch(renew).option("checkpointLocation", checkpoint)
    return (write.trigger(availableNow=True) if once else write.trigger(processingTime=interval)).start()

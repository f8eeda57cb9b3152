"""A table of Parquet files with versions: a change writes the partitions that it touches into a folder of its own and then names its version.

A version is a small text that says, for each partition, in which folders its files are; it appears whole or not at all, so readers see the version before or
the one after a change, and a change that dies leaves files that no version names (``clean`` removes them). Two changes at a time: the second one to
finish fails (in stores that rename at once, as HDFS and shared disks do). The text has a line for each partition: providers x days, or a fixed number of buckets, never files or records.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from usagelake.operators.dedup import dedup
from usagelake.schema import USAGE
from usagelake.sources import storage
from usagelake.sources.ingest import MOST_RECORDS


def partition(**values) -> str:
    """A partition's name, as its folder has it."""
    return "/".join(f"{k}={v}" for k, v in values.items())


class VersionedTable:
    """Rows of ``schema`` (DDL, with the partition columns last) below ``path``, partitioned by ``by``."""

    def __init__(self, spark: SparkSession, path: str, schema: str, by: tuple[str, ...]):
        self.spark, self.path, self.by = spark, path.rstrip("/"), by
        self.schema = spark.createDataFrame([], schema).schema

    def version(self) -> int:
        """The newest version; -1 for a table that isn't there yet."""
        return max([int(x) for x in storage.names(self.spark, f"{self.path}/versions") if x.isdigit()], default=-1)

    def partitions(self, version: int | None = None) -> dict[str, list[str]]:
        """Partition to its folders."""
        version = self.version() if version is None else version
        if version < 0:
            return {}
        text = storage.read_text(self.spark, f"{self.path}/versions/{version:010}")
        return {p: folders.split(",") for p, folders in (line.split("\t") for line in text.splitlines() if line)}

    def read(self, version: int | None = None, only: Iterable[str] | None = None) -> DataFrame:
        """The rows of a version, or of some of its partitions."""
        have = self.partitions(version)
        chosen = sorted(have if only is None else set(only) & set(have))
        if not chosen:
            return self.spark.createDataFrame([], self.schema)
        read = self.spark.read.schema(self.schema).option("basePath", f"{self.path}/data")
        return read.parquet(*[f"{self.path}/data/{folder}/{p}" for p in chosen for folder in have[p]]).select(*self.schema.names)

    def _written(self, rows: DataFrame) -> tuple[str, list[str]]:
        """A new folder with the rows, and the partitions in it."""
        folder = f"written=w{uuid.uuid4().hex}"  # reads as a partition of all folders, which no row has
        out = rows.select(*self.schema.names).hint("rebalance", *self.by)
        out.write.option("maxRecordsPerFile", MOST_RECORDS).partitionBy(*self.by).parquet(f"{self.path}/data/{folder}")
        return folder, self._folders(f"{self.path}/data/{folder}")

    def _commit(self, number: int, places: dict[str, list[str]]) -> int:
        storage.create_text(self.spark, f"{self.path}/versions/{number:010}", "".join(f"{p}\t{','.join(f)}\n" for p, f in sorted(places.items())))
        return number

    def replace(self, rows: DataFrame, touched: Iterable[str]) -> int:
        """A version in which ``rows`` are all that the partitions ``touched`` hold; the others keep their files. Returns its number."""
        before, touched = self.version(), set(touched)
        have = self.partitions(before)
        folder, made = self._written(rows)
        if odd := set(made) - touched:
            raise ValueError(f"rows of partitions that were not to be touched: {sorted(odd)[:3]}")
        return self._commit(before + 1, {p: f for p, f in have.items() if p not in touched} | {p: [folder] for p in made})

    def append(self, rows: DataFrame) -> int:
        """A version with ``rows`` added; nothing that is there is read or written."""
        before = self.version()
        have = self.partitions(before)
        folder, made = self._written(rows)
        return self._commit(before + 1, have | {p: [*have.get(p, []), folder] for p in made})

    def _folders(self, top: str) -> list[str]:
        found = [""]
        for _ in self.by:
            found = [f"{f}/{n}".lstrip("/") for f in found for n in storage.names(self.spark, f"{top}/{f}".rstrip("/")) if "=" in n]
        return found

    def clean(self, keep: int = 2) -> None:
        """Remove versions but the newest ``keep``, and the folders that none of these name. No change may be under way."""
        numbers = sorted(int(x) for x in storage.names(self.spark, f"{self.path}/versions") if x.isdigit())
        used = {f for n in numbers[-keep:] for folders in self.partitions(n).values() for f in folders}
        for n in numbers[:-keep]:
            storage.remove(self.spark, f"{self.path}/versions/{n:010}")
        for folder in storage.names(self.spark, f"{self.path}/data"):
            if folder not in used:
                storage.remove(self.spark, f"{self.path}/data/{folder}")


#: Buckets of the list of files and of the index of keys.
BUCKETS = 64


def bucket_of(*columns: str):
    return F.pmod(F.xxhash64(*columns), F.lit(BUCKETS)).cast("int")


class UsageTable:
    """The usage table by provider and UTC date, and the list of files that it has read, with the days that each has records of."""

    def __init__(self, spark: SparkSession, path: str):
        fields = USAGE.replace("provider string, ", "", 1)  # partition columns stand behind
        self.rows = VersionedTable(spark, f"{path.rstrip('/')}/usage", f"{fields}, provider string, usage_date date", ("provider", "usage_date"))
        self.files = VersionedTable(spark, f"{path.rstrip('/')}/files", "provider string, path string, mtime bigint, size bigint, days array<date>, bucket int", ("bucket",))

    def read(self) -> DataFrame:
        return self.rows.read()

    def manifest(self) -> DataFrame:
        """Files that have been read: provider, path, mtime, size."""
        return self.files.read().select("provider", "path", "mtime", "size")

    def _buckets(self, files: DataFrame) -> list[str]:
        return [partition(bucket=r[0]) for r in files.select(bucket_of("path")).distinct().collect()]  # at most BUCKETS

    def merge(self, new: DataFrame, changed: DataFrame) -> None:
        """Put ``new`` (records of the files ``changed(provider, path, mtime, size)``) in the place of what these files have given before.

        Only days on which such a file has or had records are read and written. The rows come first, the list of files last: if it
        dies between, the files count as changed still and are merged again, with the same outcome.
        """
        changed = changed.select("provider", "path", "mtime", "size")
        new = new.withColumn("usage_date", F.to_date("ts"))
        buckets = self._buckets(changed)
        before = self.files.read(only=buckets)
        days = before.join(changed.select("provider", "path"), ["provider", "path"], "left_semi").select("provider", F.explode("days").alias("usage_date"))
        touched = {partition(provider=r[0], usage_date=r[1]) for r in days.unionByName(new.select("provider", "usage_date")).distinct().collect()}  # providers x days at most
        gone = changed.select("provider", F.col("path").alias("source_file"))
        kept = self.rows.read(only=touched).join(gone, ["provider", "source_file"], "left_anti")
        self.rows.replace(kept.unionByName(new.select(*kept.columns)), touched)
        has = new.groupBy("provider", F.col("source_file").alias("path")).agg(F.array_sort(F.collect_set("usage_date")).alias("days"))
        listed = changed.join(has, ["provider", "path"], "left").select("provider", "path", "mtime", "size", F.coalesce("days", F.array().cast("array<date>")).alias("days"), bucket_of("path").alias("bucket"))
        others = before.join(changed.select("provider", "path"), ["provider", "path"], "left_anti")
        self.files.replace(others.unionByName(listed), buckets)

    def prune(self, listing: DataFrame) -> None:
        """Drop the rows of files that are in the list no more; days without such rows keep their files."""
        gone = self.files.read().join(listing.select("provider", "path"), ["provider", "path"], "left_anti").select("provider", "path", "days")
        touched = {partition(provider=r[0], usage_date=r[1]) for r in gone.select("provider", F.explode("days")).distinct().collect()}
        buckets = self._buckets(gone)
        paths = gone.select("provider", F.col("path").alias("source_file"))
        if not buckets:
            return
        if touched:
            self.rows.replace(self.rows.read(only=touched).join(paths, ["provider", "source_file"], "left_anti"), touched)
        self.files.replace(self.files.read(only=buckets).join(listing.select("provider", "path"), ["provider", "path"], "left_semi"), buckets)


#: Keys that are broadcast to the index instead of dealing both out: some hundred bytes each.
FEW_KEYS = 200_000


class KeyIndex:
    """Keys of the deduplication that have been seen, with the place of the record that counts, in ``BUCKETS`` buckets behind a bitmap.

    The bitmap has ``bits`` bits, set by a hash of the key: what hits none is new, without a look at the index. Of the
    others only the buckets that they fall into are read, and the few keys go to these, not the other way round. Keys that come in are
    appended; ``compact`` makes one piece of many.
    """

    KEY = ("provider", "message_id", "request_id", "account")
    PLACE = ("ts", "source_file", "seq")

    def __init__(self, spark: SparkSession, path: str, bits: int = 1 << 30):
        self.spark, self.bits = spark, bits
        keys = ", ".join(f"{k} string" for k in self.KEY)
        self.keys = VersionedTable(spark, f"{path.rstrip('/')}/keys", f"{keys}, ts timestamp, source_file string, seq bigint, bucket int", ("bucket",))
        self.maps = VersionedTable(spark, f"{path.rstrip('/')}/maps", "part bigint, map binary, bucket int", ("bucket",))

    def _keyed(self, usage: DataFrame) -> DataFrame:
        account = F.coalesce("account_uuid", F.lit(""))
        bit = F.pmod(F.xxhash64("provider", "message_id", "request_id", account), F.lit(self.bits))
        part = F.bitmap_bucket_number(bit)
        return usage.withColumns({"account": account, "bucket": F.pmod(part, F.lit(BUCKETS)).cast("int"), "_part": part, "_bit": F.bitmap_bit_position(bit)})

    def _maps(self, only: list[str] | None = None) -> DataFrame:
        return self.maps.read(only=only).groupBy("part", "bucket").agg(F.bitmap_or_agg("map").alias("map"))

    def _places(self, rows: DataFrame) -> DataFrame:
        """One row a key: its first place."""
        first = rows.groupBy(*self.KEY, "bucket").agg(F.min(F.struct(*self.PLACE)).alias("p"))
        return first.select(*self.KEY, "p.*", "bucket")

    @staticmethod
    def _buckets(rows: DataFrame) -> list[str]:
        return [partition(bucket=r[0]) for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS

    def _marked(self, usage: DataFrame) -> DataFrame:
        """``usage`` keyed, with ``_maybe``: whether the key's bit is set."""
        keyed = self._keyed(usage)
        maps = self._maps(self._buckets(keyed)).select(F.col("part").alias("_of"), "map")
        out = keyed.join(maps, F.col("_part") == F.col("_of"), "left")
        byte = F.conv(F.hex(F.substring("map", F.floor(F.col("_bit") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return out.withColumn("_maybe", F.coalesce(F.floor(byte / F.pow(F.lit(2), F.col("_bit") % 8)) % 2 == 1, F.lit(False))).drop("map", "_of")

    def known(self, usage: DataFrame) -> DataFrame:
        """``usage`` with ``known``: whether its key has been seen, and ``known_ts, known_file, known_seq``, the place of the record that counts."""
        columns = usage.columns
        marked = self._marked(usage)
        sought = marked.filter("_maybe").select(*self.KEY, "bucket").distinct()
        there = self.keys.read(only=self._buckets(sought))
        sought = F.broadcast(sought) if sought.limit(FEW_KEYS + 1).count() <= FEW_KEYS else sought
        same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in (*self.KEY, "bucket")]
        hits = self._places(there.alias("i").join(sought.alias("n"), same("i", "n"), "left_semi")).withColumn("known", F.lit(True))
        hits = hits.select(*self.KEY, "bucket", "known", F.col("ts").alias("known_ts"), F.col("source_file").alias("known_file"), F.col("seq").alias("known_seq"))
        out = marked.alias("n").join(hits.alias("i"), same("n", "i"), "left")
        return out.select(*[F.col(f"n.{c}") for c in columns], F.coalesce("known", F.lit(False)).alias("known"), "known_ts", "known_file", "known_seq")

    def unseen(self, usage: DataFrame) -> DataFrame:
        """What deduplication keeps of ``usage``, without the keys that have been seen."""
        return self.known(dedup(usage)).filter("not known").select(*usage.columns)

    def add(self, usage: DataFrame) -> None:
        """Take the keys of ``usage`` in; of records of one key the first by time, file and place counts, whenever it comes.

        The keys come first and the bitmap last: between the two a key counts as new and is taken in again.
        """
        place = [(F.col(c) if c in usage.columns else F.lit(None)).cast(t).alias(c) for c, t in zip(self.PLACE, ("timestamp", "string", "bigint"), strict=True)]
        keyed = self._keyed(usage).select(*self.KEY, *place, "bucket", "_part", "_bit")
        self.keys.append(self._places(keyed))
        self.maps.append(keyed.groupBy(F.col("_part").alias("part"), "bucket").agg(F.bitmap_construct_agg("_bit").alias("map")).select("part", "map", "bucket"))

    def compact(self) -> None:
        """One piece a bucket, of keys and of the bitmap."""
        self.keys.replace(self._places(self.keys.read()), self.keys.partitions())
        self.maps.replace(self._maps().select("part", "map", "bucket"), self.maps.partitions())

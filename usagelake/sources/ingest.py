"""Readers of log files, guards, and incremental ingestion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Files and lines beyond these sizes (bytes) are skipped.
MOST_FILE, MOST_LINE = 500 << 20, 16 << 20
#: Records of one file of the usage table, at most.
MOST_RECORDS = 5_000_000


def _read(spark: SparkSession, paths: list[str], glob: str, most_file: int | None, **options) -> DataFrame:
    """Text files below the paths. Files beyond ``most_file`` bytes are left out by their listing and never opened; None reads all."""
    read = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("ignoreMissingFiles", True).text(paths, **options)
    return read if most_file is None else read.filter(F.col("_metadata.file_size") <= most_file)


def read_lines(spark: SparkSession, paths: list[str], glob: str = "*.jsonl", most_file: int | None = MOST_FILE) -> DataFrame:
    """Lines of all files under the paths, with their place: files stay splittable, order is block start and line number.

    Two formats (codex, openclaw) have no bound in the tool whose results are to be matched: ``most_file=None`` for these.
    """
    return _read(spark, paths, glob, most_file).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_block_start").alias("block_start"), F.monotonically_increasing_id().alias("line_id"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), "value")


def read_docs(spark: SparkSession, paths: list[str], glob: str = "*.json", most_file: int | None = MOST_FILE) -> DataFrame:
    """Whole documents under the paths."""
    return _read(spark, paths, glob, most_file, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.lit(0).cast("bigint").alias("block_start"), F.lit(0).cast("bigint").alias("line_id"),
        F.col("_metadata.file_modification_time").alias("mtime"), F.col("_metadata.file_size").alias("size"), "value")


def guarded(lines: DataFrame, needle: str) -> DataFrame:
    """Lines that hold the text, of files and with a length within bounds. The test comes before any parsing."""
    return lines.filter((F.col("size") <= MOST_FILE) & (F.octet_length("value") <= MOST_LINE) & F.col("value").contains(needle))


def unify(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def plan_ingest(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files to read: new ones, and those whose modification time or size changed."""
    return listing.join(manifest.select("provider", "path", "mtime", "size"), ["provider", "path", "mtime", "size"], "left_anti")


def merge_ingest(old: DataFrame, new: DataFrame, changed: DataFrame) -> DataFrame:
    """The table after an ingestion: rows of the files read again are replaced, rows of deleted files stay."""
    return old.join(changed.select("provider", F.col("path").alias("source_file")), ["provider", "source_file"], "left_anti").select(*new.columns).unionByName(new)


def prune(old: DataFrame, listing: DataFrame) -> DataFrame:
    """Only rows of files that still exist."""
    return old.join(listing.select("provider", F.col("path").alias("source_file")), ["provider", "source_file"], "left_semi").select(*old.columns)


def drop_known(json: DataFrame, table: DataFrame) -> DataFrame:
    """Records of message files without those that the message table has."""
    return json.join(table.select("message_id"), "message_id", "left_anti").select(*json.columns)


def write_usage(usage: DataFrame, path: str, mode: str = "append") -> None:
    """The usage table as Parquet by provider and UTC date; a day of very many records is split over tasks and files."""
    dated = usage.withColumn("usage_date", F.to_date("ts")).hint("rebalance", "provider", "usage_date")
    dated.write.mode(mode).option("maxRecordsPerFile", MOST_RECORDS).partitionBy("provider", "usage_date").parquet(path)

"""The shared folder, and paths in any store that Spark can write."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession

_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one of the application only where that is unset and the session has one machine."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="usagelake-")
    return where.rstrip("/")


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, in order; none if there is no such folder."""
    where, store = _at(spark, path)
    return sorted(x.getPath().getName() for x in store.listStatus(where)) if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    where, store = _at(spark, path)
    store.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    where, store = _at(spark, path)
    stream = store.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_text(spark: SparkSession, path: str, text: str) -> None:
    """A new file with the text, which appears whole or not at all; an error if there is one of that name already."""
    where, store = _at(spark, path)
    jvm = spark.sparkContext._jvm
    draft = where.suffix("." + jvm.java.util.UUID.randomUUID().toString() + ".draft")
    stream = store.create(draft, False)
    stream.write(text.encode())
    stream.close()
    if store.exists(where) or not store.rename(draft, where):
        store.delete(draft, False)
        raise FileExistsError(path)

"""Helpers that several operators use: the shared folder, size-checked broadcasts, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII capitals and their small letters, for lower-casing A-Z and nothing else.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


#: Folders made for applications that name none.
_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only where that is unset, in a session of one machine (tests), a temporary one of the application."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        where = _own[app] = _own.get(app) or "file://" + tempfile.mkdtemp(prefix="usagelake-")
    return where.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet into the shared folder and read it back.

    Cuts the lineage, so a lost executor costs a read instead of the steps before, and a table that
    is used several times is computed once. The folder's owner clears it (it is a checkpoint folder).
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete what ``stored`` wrote for these frames; only for tables that nothing to come reads."""
    for df in frames:
        jvm = df.sparkSession.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def freeing(run):
    """A task's function over batches that gives its memory back to the system at the end, as Python workers stay for later tasks."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def small_enough(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most ``rows`` rows; reads no more than one row beyond that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its checked size allows it, else unchanged (Spark shuffles)."""
    return F.broadcast(df) if small_enough(df, rows) else df


def lower_ascii(text: Column) -> Column:
    """Text with A-Z lower-cased and every other character kept; null becomes empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def held_out(doc_id: Column, modulus: int) -> Column:
    """Whether crc32 of the id as text leaves the remainder 2; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == 2, F.lit(False))


def spanning_links(near: np.ndarray) -> list[tuple[int, int]]:
    """Links that join all that the symmetric matrix joins: a spanning forest."""
    out: list[tuple[int, int]] = []
    new = near.any(axis=1)
    while new.any():
        todo = [int(np.argmax(new))]
        new[todo[0]] = False
        while todo:
            at = todo.pop()
            found = np.flatnonzero(near[at] & new).tolist()
            new[found] = False
            out += [(at, x) for x in found]
            todo += found
    return out


def contracted(edges: DataFrame) -> DataFrame:
    """Edges ``a, b`` that join the same nodes as ``edges(a, b)`` with a < b: of each b the one to its smallest a, and from that to its other a.

    Where very many nodes share few small neighbours, as texts share the heads of their buckets, the edges among these neighbours are soon the same.
    """
    stars = edges.groupBy("b").agg(F.min("a").alias("a"), F.collect_set("a").alias("others"))
    each = stars.select("a", F.explode(F.array_union(F.array("b"), "others")).alias("b"))
    return each.filter("a <> b").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a, b)``: one row ``node, component`` for each node of an edge.

    The component is its smallest node. Each round every node takes the smallest label among its neighbours' and
    its label's own, so stars settle at once and chains shrink by doubling: one join and one pre-aggregated grouping; a
    node with very many edges is split by the skewed-join handling. Labels only fall, so an unchanged sum of labels ends it.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = stored(both, "edges")
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label"))
    labels = stored(labels, "labels")
    before = None
    for _ in range(max_rounds):
        links = both.union(labels.select(F.col("node").alias("a"), F.col("label").alias("b")))
        near = links.join(labels.select(F.col("node").alias("b"), "label").hint("merge"), "b").groupBy("a").agg(F.min("label").alias("label"))
        old, labels = labels, stored(near.select(F.col("a").alias("node"), "label"), "labels")
        discard(old)
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    discard(both)
    return labels.select("node", F.col("label").alias("component"))

"""Vectors as codes of four bytes: an integer codebook for each quarter of the vector, trained over all distinct parts.

Every component x becomes floor(1024 * x) and a vector is cut into ``PARTS`` equal consecutive parts. Equal parts are counted
first (a hot vector is one row from then on), then dealt by ranges, so that a task holds its parts in lexicographic order. That
order is a trie over the components, and a task walks it depth first: a node holds the distances of its prefix to all entries of
the codebook, a child adds one component's squares to its parent's, so parts share what their common prefix costs, and a leaf takes
the nearest entry (ties to the lower index) and adds its components, weighted by its count, to that entry's sums. The walk takes
leaves in blocks of bounded memory and carries the path of the last leaf into the next block. Only an entry's sums leave a
task, and only sums of entries reach the driver: entries x components, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.shared import broadcast_if_small, freeing, stored

PARTS = 4
ENTRIES = 256
ROUNDS = 4
SCALE = 1024
#: Integer components beyond this count as this: squares of larger ones, summed over 16, don't fit a long.
LARGEST = 1 << 28
#: Distances held at a time by a task's walk.
CELLS = 1 << 20
#: Most labels whose totals are broadcast.
FEW_LABELS = 100_000


@dataclass(frozen=True)
class Codebooks:
    """``entries[p][e]``: the components of entry e of part p; ``size``: components of a vector, a multiple of ``PARTS``."""

    entries: np.ndarray
    size: int

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest entry and its squared distance, for each of ``parts`` in lexicographic order: the depth-first walk."""
    n, depth = parts.shape
    path = np.zeros((depth + 1, len(entries)), dtype=np.int64)  # the distances of the last leaf's prefixes
    found, error = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    block = max(1, CELLS // max(1, len(entries)))
    for low in range(0, n, block):
        some = parts[low : low + block]
        opens = np.ones(some.shape, dtype=bool)  # whether a leaf is the first one below its prefix
        opens[1:] = np.logical_or.accumulate(some[1:] != some[:-1], axis=1)
        if low:
            opens[0] = np.logical_or.accumulate(some[0] != parts[low - 1])
        held, node = path[:1], np.zeros(len(some), dtype=np.int64)
        for j in range(depth):
            first = np.flatnonzero(opens[:, j])
            step = some[first, j, None] - entries[None, :, j]
            below = held[node[first]] + step * step
            carried = not opens[0, j]
            held = np.concatenate([path[j + 1 : j + 2], below]) if carried else below
            node = np.cumsum(opens[:, j]) - (not carried)
            path[j + 1] = held[-1]
        best = held.argmin(axis=1)
        found[low : low + block] = best[node]
        error[low : low + block] = held[np.arange(len(held)), best][node]
    return found, error


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """An array column of ``width`` values a row, as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), width)


def _finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, v array<int>`` of the rows whose vector is there and holds finite numbers only."""
    v = F.col("embedding").cast("array<double>")
    whole = F.transform(v, lambda x: F.floor(F.least(F.greatest(x * SCALE, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))).cast("int"))
    return vectors.filter(_finite(v)).select("vec_id", "label", whole.alias("v"))


def _sized(kept: DataFrame, size: int) -> DataFrame:
    """Shorter vectors with zeros behind; all have ``size`` components."""
    return kept.select("vec_id", "label", F.concat("v", F.array_repeat(F.lit(0), F.lit(size) - F.size("v"))).alias("v"))


def _sums(shared, width: int):
    """For each entry of a task's sorted parts (p, part, n): the number of vectors and the sums of components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        count = np.zeros(books.shape[:2], dtype=np.int64)
        total = np.zeros(books.shape, dtype=np.int64)
        for batch in batches:
            which = batch.column("p").to_numpy(zero_copy_only=False)
            part, n = _matrix(batch.column("part"), width), batch.column("n").to_numpy(zero_copy_only=False)
            for p in np.unique(which):
                some = which == p
                entry, _ = nearest(part[some], books[p])
                np.add.at(count[p], entry, n[some])
                np.add.at(total[p], entry, part[some] * n[some, None])
        p, e = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))],
            names=["p", "e", "n", "total"])

    return freeing(run)


def distinct_parts(kept: DataFrame, size: int) -> DataFrame:
    """``p, part, n``: every distinct part with its count, written once, each task's in lexicographic order."""
    width = size // PARTS
    cut = F.array(*[F.slice("v", 1 + p * width, width) for p in range(PARTS)])
    counted = kept.select(F.posexplode(cut).alias("p", "part")).groupBy("p", "part").agg(F.count("*").alias("n"))
    return stored(counted.repartitionByRange("p", "part").sortWithinPartitions("p", "part"), "parts")


def train(vectors: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks over all rows of ``vectors(vec_id, embedding)``, of the parts of the ``entries`` smallest ids to begin with.

    Rows of one id follow the order of their vectors, rows without an id come last; fewer rows make fewer entries. Vectors are as long as
    the longest, rounded up to a multiple of ``PARTS``: shorter ones count as if zeros followed. No vectors, no entries.
    """
    spark = vectors.sparkSession
    kept = integers(vectors if "label" in vectors.columns else vectors.withColumn("label", F.lit(None).cast("int")))
    longest = kept.agg(F.max(F.size("v"))).first()[0]
    if longest is None:
        return Codebooks(np.zeros((PARTS, 0, 0), dtype=np.int64), 0)
    size = -(-longest // PARTS) * PARTS
    kept = _sized(kept, size)
    first = kept.orderBy(F.asc_nulls_last("vec_id"), "v").limit(entries).collect()
    books = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), PARTS, size // PARTS).transpose(1, 0, 2).copy()
    parts = distinct_parts(kept, size)
    for _ in range(rounds):
        sums = parts.mapInArrow(_sums(spark.sparkContext.broadcast(books), size // PARTS), "p int, e int, n long, total array<long>")
        by_entry = sums.select("p", "e", "n", F.posexplode_outer("total").alias("at", "x")).groupBy("p", "e", "at").agg(
            F.sum("n").alias("n"), F.sum("x").alias("x"))
        books = books.copy()
        for r in by_entry.filter("at is not null").collect():
            books[r.p, r.e, r.at] = r.x // r.n
    return Codebooks(books, size)


def _codes(shared, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = shared.value
        for batch in batches:
            vectors = _matrix(batch.column("v"), size).reshape(batch.num_rows, PARTS, size // PARTS)
            code, error = np.empty((batch.num_rows, PARTS), dtype=np.uint8), np.zeros(batch.num_rows, dtype=np.int64)
            for p in range(PARTS):
                part = vectors[:, p]
                order = np.lexsort(part.T[::-1]) if size else np.arange(len(part))
                entry, distance = nearest(part[order], books[p])
                code[order, p] = entry
                error[order] += distance
            text = [bytes(c).hex() for c in code]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(text, pa.string()), pa.array(error)],
                                             names=["vec_id", "label", "code", "error"])

    return freeing(run)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, label, code, error`` of each row of ``vectors(vec_id, embedding, label)`` that holds finite numbers only.

    ``code``: two hex digits for each part; ``error``: the squared distance of the integer vector to what ``decode`` gives. A vector
    longer than the codebooks' raises an error. Repeated rows stay; other columns are ignored; integer components beyond
    ``LARGEST`` (numbers beyond 262,144) count as that.
    """
    kinds = dict(vectors.select("vec_id", "label").dtypes)
    kept = _sized(integers(vectors), books.size)
    return kept.mapInArrow(_codes(vectors.sparkSession.sparkContext.broadcast(books.entries), books.size),
                           f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def decode(codes: DataFrame, books: Codebooks) -> DataFrame:
    """``vec_id, embedding array<double>``: each code's entries, one part after the other, divided by ``SCALE``. Null or odd codes give null."""
    width = books.entries.shape[2]
    table = F.array(*[F.array(*[F.lit(e.tolist()) for e in book]) for book in books.entries]) if books.entries.size else F.lit(None).cast("array<array<array<int>>>")
    whole = F.col("code").rlike(f"^[0-9a-f]{{{2 * PARTS}}}$")
    parts = [F.get(F.get(table, F.lit(p)), F.conv(F.substring("code", 2 * p + 1, 2), 16, 10).cast("int")) for p in range(PARTS)]
    vector = F.transform(F.concat(*parts), lambda x: x / F.lit(float(SCALE)))
    return codes.select("vec_id", F.when(whole, vector).cast("array<double>").alias("embedding")) if width else codes.select(
        "vec_id", F.lit(None).cast("array<double>").alias("embedding"))


def compress(vectors: DataFrame) -> DataFrame:
    """Train and encode all rows: vec_id, code, error, label_error (the errors of all rows with that label, nulls together), codebooks_sha256.

    Rows whose vector is null or holds null or non-finite components are dropped; an empty table gives no rows.
    """
    books = train(vectors)
    codes = stored(encode(vectors, books), "codes")
    totals = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    joined = codes.join(broadcast_if_small(totals, FEW_LABELS), F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))

"""Embedding near-dedup by a forest of random-projection trees with spill.

Each tree splits the unit vectors by random projections at the median of a bounded sample, down to
leaves of about ``LEAF`` vectors; vectors within the spill margin of a split go to both sides. Vectors that
share a leaf in any tree are compared, so a pair is missed only if every tree parts it. Leaves get vectors as sketches of
16-bit numbers, a quarter of their bytes, by which they are also routed; pairs that the rounding leaves open are compared exactly (double
precision) with the vectors joined later, so a link is never wrong. A task can tell from the sketches which leaves two vectors share, so a pair
counts in the first of them only, and the task returns each vector's number of links and links that join them, not
the pairs: its rows grow with the vectors, however many are close together. A leaf that holds more vectors than expected, because they lie close together, is compared in
blocks, pair of blocks by pair of blocks. Equal vectors are one vector with a multiplicity.

The trees are fitted on at most ``FIT_ROWS`` distinct vectors chosen by hash; every vector is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.shared import broadcast_if_small, components, spanning_links, stored

COSINE = 0.9
TREES = 12
LEAF = 400
#: Half-width of the spill zone around a split, in units of the projection of a unit vector. Many trees of narrow zones miss fewer pairs at
#: any depth, with fewer copies of a vector, than few trees of wide ones.
SPILL = 0.03
FIT_ROWS = 50_000
#: Rows of a block of an overfull leaf.
BLOCK = 1_000
#: Vectors that are routed at a time; each gives a row for every leaf it is in.
ROUTED = 1_000
#: A component of 1 in a sketch.
UNIT = 32_767
#: What a row of a leaf's results is: a vector and the number of rows that it is linked with, a link that joins, or a pair left open.
COUNT, JOIN, OPEN = 0, 1, 2
#: Overfull leaves are broadcast up to so many (20 bytes each).
BROADCAST_LEAVES = 1_000_000


class Forest:
    """For each tree and node a direction and a threshold; nodes are numbered as in a heap."""

    def __init__(self, sample: np.ndarray, rows: int, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, seed: int = 5):
        self.spill, self.seed, self.size = spill, seed, sample.shape[1] if len(sample) else 0
        self.depth = max(0, int(np.ceil(np.log2(max(1, rows) / leaf))))
        self.thresholds: list[tuple[np.ndarray, np.ndarray]] = []  # nodes in order, and where they split
        for tree in range(trees):
            found: dict[int, float] = {}
            parts = {1: np.arange(len(sample))}
            for level in range(self.depth):
                below = {}
                for node, mine in parts.items():
                    if len(mine) < 2:  # below what the sample tells, splits are at 0, so the forest is bounded by the sample
                        continue
                    place = (sample[mine] * self.direction(tree, level)).sum(axis=1)
                    found[node] = float(np.median(place))
                    below[2 * node], below[2 * node + 1] = mine[place <= found[node]], mine[place > found[node]]
                parts = below
            nodes = np.array(sorted(found), np.int64)
            self.thresholds.append((nodes, np.array([found[int(n)] for n in nodes])))

    def direction(self, tree: int, level: int) -> np.ndarray:
        v = np.random.default_rng([self.seed, tree, level]).normal(size=self.size)
        return v / np.linalg.norm(v)

    def leaves(self, vectors: np.ndarray, trees: int | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each tree, or the first ``trees``: rows and leaves; a row in spill zones is in several leaves."""
        for tree, (nodes, splits) in enumerate(self.thresholds[:trees]):
            row, node = np.arange(len(vectors)), np.ones(len(vectors), np.int64)
            for level in range(self.depth):
                place = (vectors * self.direction(tree, level)).sum(axis=1)[row]  # the same to the last bit in every task
                at = np.minimum(np.searchsorted(nodes, node), max(0, len(nodes) - 1))
                split = np.where(nodes[at] == node, splits[at], 0.0) if len(nodes) else 0.0
                left, right = place <= split + self.spill, place > split - self.spill
                row, node = np.r_[row[left], row[right]], np.r_[2 * node[left], 2 * node[right] + 1]
            yield tree, row, node


def _vectors(column) -> np.ndarray:
    return np.array(column.to_pylist() if isinstance(column, pa.Array) else list(column), dtype=np.float64)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Usable vectors at unit length: without nulls, non-finite components or length zero."""
    for batch in batches:
        ids, keep, out = batch.column("vec_id").to_pylist(), [], []
        for i, v in enumerate(batch.column("embedding").to_pylist()):
            if ids[i] is None or not v or any(x is None for x in v):
                continue
            x = np.array(v, dtype=np.float64)
            top = np.abs(x).max()
            if np.isfinite(top) and top > 0:
                x = x / top  # so that squares neither overflow nor vanish
                keep.append(ids[i])
                out.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([pa.array(keep, pa.int64()), pa.array([len(x) for x in out], pa.int32()), pa.array(out, pa.list_(pa.float64()))],
                                         names=["vec_id", "size", "v"])


def _routed(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            for start in range(0, batch.num_rows, ROUTED):
                part = batch.slice(start, ROUTED)
                sketch = np.rint(_vectors(part.column("v")) * UNIT)
                sketches = pa.array([x.tobytes() for x in sketch.astype("<i2")], pa.binary())
                for tree, row, node in forest.leaves(sketch / UNIT):
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), tree, np.int32)), pa.array(node), part.column("id").take(at), part.column("times").take(at), sketches.take(at)],
                                                     names=["tree", "leaf", "id", "times", "v"])

    return run


def _sketched(column: pd.Series) -> np.ndarray:
    """Sketches as whole numbers; their products are exact in double precision."""
    return np.frombuffer(b"".join(column), "<i2").reshape(len(column), -1).astype(np.float64)


def _met_before(forest: Forest, x: np.ndarray, y: np.ndarray, tree: int, leaf: int) -> np.ndarray:
    """Which vectors of x and y share a leaf of an earlier tree, or an earlier leaf of this one."""
    seen = np.zeros((len(x), len(y)), dtype=bool)
    for (number, row, node), (_, other, its) in zip(forest.leaves(x, tree + 1), forest.leaves(y, tree + 1), strict=True):
        if number == tree:
            row, node, other, its = row[node < leaf], node[node < leaf], other[its < leaf], its[its < leaf]
        nodes = np.intersect1d(node, its)
        for at in range(0, len(nodes), 2_000):
            some = nodes[at : at + 2_000]
            sides = []
            for n, r, v in ((len(x), row, node), (len(y), other, its)):
                on = np.isin(v, some)
                one = np.zeros((n, len(some)), dtype=np.float32)
                one[r[on], np.searchsorted(some, v[on])] = 1
                sides.append(one)
            seen |= sides[0] @ sides[1].T > 0
    return seen


def _compared(least: float, shared):
    """The links within a block (one side only) or between two blocks of a leaf, of pairs that meet there first: COUNT, JOIN and OPEN rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = rows[rows["side"] == 0]
        two = rows[rows["side"] == 1] if rows["x"].iloc[0] < rows["y"].iloc[0] else one
        out = [np.zeros((3, 0), np.int64)]
        if len(one) and len(two):
            x, y = _sketched(one["v"]), _sketched(two["v"])
            off = np.sqrt(x.shape[1]) * 0.5 / UNIT  # the most by which a sketch is off its unit vector
            slack = 2 * off + off * off + 1e-9
            dot = x @ y.T
            a, b = one["id"].to_numpy(), two["id"].to_numpy()
            near = (dot >= (least - slack) * UNIT**2) & (a[:, None] < b[None, :] if two is one else a[:, None] != b[None, :])
            i, j = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
            near, dot, a, b = near[np.ix_(i, j)], dot[np.ix_(i, j)], a[i], b[j]
            if near.any():
                near &= ~_met_before(shared.value, x[i] / UNIT, y[j] / UNIT, int(rows["tree"].iloc[0]), int(rows["leaf"].iloc[0]))
                sure = near & (dot >= (least + slack) * UNIT**2)
                p, q = np.nonzero(near & ~sure)
                out.append(np.array([np.full(len(p), OPEN), np.minimum(a[p], b[q]), np.maximum(a[p], b[q])]))
                for ids, count in ((a, sure @ two["times"].to_numpy()[j]), (b, one["times"].to_numpy()[i] @ sure)):
                    out.append(np.array([np.full((count > 0).sum(), COUNT), ids[count > 0], count[count > 0]]))
                ids = np.union1d(a, b)
                square = np.zeros((len(ids), len(ids)), dtype=bool)
                square[np.ix_(np.searchsorted(ids, a), np.searchsorted(ids, b))] = sure
                joins = np.array(spanning_links(square | square.T), np.int64).reshape(-1, 2)
                out.append(np.array([np.full(len(joins), JOIN), ids[joins].min(axis=1), ids[joins].max(axis=1)]))
        kind, a, b = np.concatenate(out, axis=1)
        return pd.DataFrame({"kind": kind.astype(np.int32), "a": a, "b": b})

    return run


def _exact(least: float):
    """The pairs (a, b) whose vectors x and y have at least that cosine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                on = np.einsum("ij,ij->i", _vectors(batch.column("x")), _vectors(batch.column("y"))) >= least
                yield batch.select(["a", "b"]).filter(pa.array(on))

    return run


def link(vectors: DataFrame, cosine: float = COSINE, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL) -> DataFrame:
    """One row for each row of ``vectors(vec_id, embedding)``: vec_id, n_links, component_id, kept.

    ``n_links`` counts the other rows linked directly (cosine of at least ``cosine`` in double precision), ``component_id``
    is the smallest vec_id reachable by links, ``kept`` whether it is the row's own. Null and zero vectors, and those that hold null or
    non-finite components, link with nothing; so do vectors of different lengths. Equal vectors, repeated rows included, link with each other. Rows
    of a null vec_id have no links and a null component and aren't kept; rows that share a vec_id with unlike vectors have the larger of
    their numbers of links and join their components; an empty table gives no rows; other columns are ignored.
    """
    spark = vectors.sparkSession
    pairs = vectors.select("vec_id", "embedding").mapInArrow(_units, "vec_id long, size int, v array<double>")
    units = stored(pairs, "units")
    same = units.groupBy("size", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("times"), F.countDistinct("vec_id").alias("ids"))
    same = stored(same, "distinct-vectors")
    sizes = [r[0] for r in same.select("size").distinct().collect()]
    links = None
    for size in sizes:
        mine = same.filter(F.col("size") == size)
        sample = mine.orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("v").toPandas()
        shared = spark.sparkContext.broadcast(Forest(_vectors(sample["v"]), mine.count(), trees, leaf, spill))
        routed = mine.select("id", "times", "v").mapInArrow(_routed(shared), "tree int, leaf long, id long, times long, v binary")
        full = routed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK)
        full = stored(full.select("tree", "leaf", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "full-leaves")
        rows = routed.join(broadcast_if_small(full, BROADCAST_LEAVES), ["tree", "leaf"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        rows = rows.withColumn("block", F.pmod(F.xxhash64("id", "tree"), F.col("blocks")).cast("int"))
        # Every two blocks x <= y of a leaf meet once, in the group named by both.
        block, last = F.col("block"), F.col("blocks") - 1
        meets = F.concat(
            F.transform(F.sequence(block, last), lambda y: F.struct(block.alias("x"), y.alias("y"), F.lit(0).alias("side"))),
            F.when(block > 0, F.transform(F.sequence(F.lit(0), block - 1), lambda x: F.struct(x.alias("x"), block.alias("y"), F.lit(1).alias("side")))).otherwise(
                F.array().cast("array<struct<x:int,y:int,side:int>>")))
        rows = rows.select("tree", "leaf", "id", "times", "v", F.explode(meets).alias("m")).select("tree", "leaf", "id", "times", "v", "m.*")
        met = stored(rows.groupBy("tree", "leaf", "x", "y").applyInPandas(_compared(cosine, shared), "kind int, a long, b long"), "met")
        known = met.filter(F.col("kind") == OPEN).join(mine.select(F.col("id").alias("a"), F.col("v").alias("x")).hint("merge"), "a")
        known = known.join(mine.select(F.col("id").alias("b"), F.col("v").alias("y")).hint("merge"), "b").select("a", "b", "x", "y")
        met = met.filter(F.col("kind") != OPEN).unionByName(known.mapInArrow(_exact(cosine), "a long, b long").withColumn("kind", F.lit(OPEN)))
        links = met if links is None else links.unionByName(met)
    if links is None:
        links = spark.createDataFrame([], "kind int, a long, b long")
    links = stored(links, "vector-links")
    times, pairs = same.select("id", "times"), links.filter(F.col("kind") == OPEN)
    sides = pairs.select(F.col("a").alias("id"), F.col("b").alias("o")).union(pairs.select(F.col("b").alias("id"), F.col("a").alias("o")))
    sides = sides.join(times.select(F.col("id").alias("o"), "times").hint("merge"), "o").select("id", "times")
    counted = links.filter(F.col("kind") == COUNT).select(F.col("a").alias("id"), F.col("b").alias("times"))
    others = counted.union(sides).groupBy("id").agg(F.sum("times").alias("others"))
    of_row = units.join(same.select("size", "v", "id", "times").hint("merge"), ["size", "v"]).select("vec_id", "id", "times")
    of_row = stored(of_row.groupBy("vec_id", "id", "times").agg(F.count("*").alias("rows")), "vector-ids")
    edges = links.filter(F.col("kind") != COUNT).select("a", "b").unionByName(of_row.filter("vec_id <> id").select(F.col("vec_id").alias("a"), F.col("id").alias("b")))
    labels = components(edges)
    linked = of_row.join(others.hint("merge"), "id", "left").select("vec_id", (F.col("times") - 1 + F.coalesce("others", F.lit(0))).alias("n"))
    linked = linked.groupBy("vec_id").agg(F.max("n").alias("n"))
    out = vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(linked.hint("merge"), "vec_id", "left")
    out = out.join(labels.select(F.col("node").alias("vec_id"), "component").hint("merge"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))

"""Near-duplicate documents by BagMinHash: weighted-Jaccard signatures, banding, exact verification.

A document is the multiset of its five-word shingles. Each shingle starts one Poisson process per level
of a dyadic hierarchy of weights: level 0 covers weight (0, 1], level j covers (2**(j-1), 2**j]. A process
of rate equal to its level's width drops points (time, weight position, component); a document of weight c sees
the points at positions up to c, positions being discretised to whole counts. The earliest point seen in each component is its
signature value, so two documents agree in a component with probability equal to their weighted Jaccard similarity. Points
are drawn in order of time and only up to the time by which all components are filled.

Equal texts are one class from the start. Signatures are cut into bands, and texts that share buckets, directly or through
others, are a group of candidates. The counted shingles of a group go to one task, which compares its texts as rows of
a matrix and returns only links that join them (a spanning forest), so no pair is a row. A group of more than
a block is cut into blocks, and each two blocks meet in a task. Groups of very many blocks first verify each text with a leader of one of
its buckets, in rounds, which settles crowds of copies by a few stars; then blocks of the texts outside of a bucket's largest
component meet the others of the bucket. Links are exact similarities, so banding can only miss (at 0.8: one pair in 20,000), never invent.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.hashing import mix, run_hashes, split_words, word_hashes
from usagelake.llm.shared import broadcast_if_small, components, contracted, discard, freeing, spanning_links, stored

SHINGLE = 5
SIMILARITY = 0.8
BANDS = 25
ROWS = 5
#: Bands of the first round of leaders.
FIRST_BANDS = 5
#: Texts and shingles of a block, about. Two blocks and the matrix of their overlaps are in a task at once.
BLOCK_TEXTS = 512
BLOCK_SHINGLES = 1_000_000
#: A group of up to so many blocks is compared at once, each block with each; beyond it leaders go first.
MOST_BLOCKS = 32
#: Portions of texts that are signed together: bytes and texts.
PORTION_BYTES = 1 << 18
PORTION_TEXTS = 256
#: Ids of texts to verify are broadcast up to so many (8 bytes each), else shuffled.
BROADCAST_IDS = 2_000_000


def _multiset(words: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their counts; a text shorter than a shingle is one shingle."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(shingle, n)
    return np.unique(run_hashes(words, np.arange(n - k + 1), np.arange(k, n + 1)), return_counts=True)


def signatures(keys: np.ndarray, counts: np.ndarray, doc: np.ndarray, docs: int, size: int) -> np.ndarray:
    """BagMinHash signatures, (docs, size) values of 64 bits, of non-empty multisets with whole counts.

    ``doc`` says whose each key is, ascending from 0.
    """
    out = np.zeros((docs, size), np.uint64)
    weight = np.bincount(doc, counts, docs)
    limit = size * (np.log(size) + 3.0) / weight
    todo = np.arange(docs)
    while len(todo):
        number = np.full(docs, -1)
        number[todo] = np.arange(len(todo))
        mine = np.flatnonzero(number[doc] >= 0)
        levels = np.ceil(np.log2(counts[mine])).astype(np.int64) + 1  # 1 for count 1, j+1 for counts up to 2**j
        owner = np.repeat(mine, levels)
        level = np.arange(len(owner)) - np.repeat(np.cumsum(levels) - levels, levels)
        low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
        width = np.maximum(low, 1)
        seed = mix(keys[owner] + np.uint64(0x9E3779B97F4A7C15) * (level + 1).astype(np.uint64))
        most, base, until = counts[owner], number[doc[owner]] * size, limit[doc[owner]]
        time, step, points = np.zeros(len(seed)), 0, []
        while len(seed):
            step += 1
            bits = mix(seed + np.full(1, step, np.uint64) * np.uint64(0xD1B54A32D192ED03))
            time = time - np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
            on = np.flatnonzero(time <= until)
            seed, low, width, most, base, until, time, bits = (x[on] for x in (seed, low, width, most, base, until, time, bits))
            bits = mix(bits ^ seed)
            seen = low + ((bits >> np.uint64(40)).astype(np.float64) * 2.0**-24 * width).astype(np.int64) < most
            comp = base + ((bits & np.uint64(0xFFFFFFFF)) * np.uint64(size) >> np.uint64(32)).astype(np.int64)
            points.append((time[seen], comp[seen], bits[seen]))
        time, comp, bits = (np.concatenate(x) for x in zip(*points, strict=True))
        first = np.full(len(todo) * size, np.inf)
        np.minimum.at(first, comp, time)
        value = np.zeros(len(first), np.uint64)
        won = time == first[comp]
        value[comp[won]] = mix(bits[won])
        filled = np.isfinite(first).reshape(-1, size).all(axis=1)
        out[todo[filled]] = value.reshape(-1, size)[filled]
        todo = todo[~filled]
        limit[todo] *= 2
    return out


def _texts(batches: Iterator[pa.RecordBatch], size: int = PORTION_BYTES, most: int = PORTION_TEXTS) -> Iterator[tuple[list[pa.Array], list[bytes]]]:
    """The other columns of the rows, and their texts, in portions of about ``size`` bytes and at most ``most`` texts."""
    for batch in batches:
        start, texts, have = 0, [], 0
        rest = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
        for i, t in enumerate(batch.column("text")):
            texts.append(t.as_py() or b"")
            have += len(texts[-1])
            if have >= size or len(texts) >= most or i == batch.num_rows - 1:
                yield [c.slice(start, i + 1 - start) for c in rest], texts
                start, texts, have = i + 1, [], 0


def _sets(texts: list[bytes], shingle: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles, counts and owner of all texts; texts without words have none."""
    found = [_multiset(word_hashes(t, *split_words(t)), shingle) for t in texts]
    return (np.concatenate([k for k, _ in found]), np.concatenate([c for _, c in found]),
            np.repeat(np.arange(len(texts)), [len(k) for k, _ in found]))


def _lists(values: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _signed(shingle: int, bands: int, rows: int):
    """For each text a hash of its words (128 bits of the words themselves), its number of shingles and its bands (none without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (ids,), texts in _texts(batches):
            split = [split_words(t) for t in texts]
            words = [word_hashes(t, *x) for t, x in zip(texts, split, strict=True)]
            found = [_multiset(w, shingle) for w in words]
            counts = np.concatenate([c for _, c in found])
            doc = np.repeat(np.arange(len(texts)), [len(k) for k, _ in found])
            own, part = np.unique(doc, return_inverse=True)
            sig = signatures(np.concatenate([k for k, _ in found]), counts, part, len(own), bands * rows).ravel()
            at = np.arange(0, len(sig), rows)
            lengths = np.zeros(len(texts), np.int64)
            lengths[own] = bands
            whole = np.frombuffer(b"".join([hashlib.md5(b" ".join(t.split())).digest() for t in texts]), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(np.bincount(doc, counts, len(texts)).astype(np.int32)),
                 _lists(run_hashes(sig, at, at + rows), lengths)], names=["id", "k1", "k2", "n", "bands"])

    return run


def _items(shingle: int):
    """The counted shingles of each text as a set, one 64-bit number for each occurrence."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rest, texts in _texts(batches):
            keys, counts, doc = _sets(texts, shingle)
            owner = np.repeat(np.arange(len(keys)), counts)
            nth = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.uint64)
            each = np.split(mix(keys[owner] ^ mix(nth)), np.cumsum(np.bincount(doc, counts, len(texts)).astype(np.int64))[:-1])
            yield pa.RecordBatch.from_arrays([rest[0].cast(pa.int64()), pa.array([x.tobytes() for x in each], pa.binary())], names=["id", "items"])

    return run


def joining_links(sets: list[np.ndarray], side: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs of ``sets`` that overlap in at least ``similarity`` of their union.

    With both sides present, pairs across them only.
    """
    n = len(sets)
    size = np.array([len(x) for x in sets], dtype=np.float64)
    owner = np.repeat(np.arange(n), size.astype(np.int64))
    _, item, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    kept = times[item] > 1
    owner, item = owner[kept], item[kept]
    order = np.argsort(item, kind="stable")
    owner, item = owner[order], item[order]
    times = np.unique(item, return_counts=True)[1] if len(item) else np.zeros(0, np.int64)
    both = np.zeros((n, n))
    wide = max(256, (4 << 20) // max(1, n))  # columns of a matrix of 16 MB
    rare = times <= 8 if n * len(times) > 4 << 20 else np.zeros(len(times), dtype=bool)
    start = np.cumsum(times) - times
    for d in range(2, 9):  # items of few sets: their pairs are counted
        at = start[rare & (times == d)]
        if len(at):
            these = owner[at[:, None] + np.arange(d)]
            for i in range(d):
                for j in range(i + 1, d):
                    both += np.bincount(these[:, i] * n + these[:, j], minlength=n * n).reshape(n, n)
    both += both.T
    common = np.flatnonzero(~rare)
    for a in range(0, len(common), wide):
        some = common[a : a + wide]
        inside = np.repeat(np.arange(len(some)), times[some])
        at = np.repeat(start[some], times[some]) + np.arange(len(inside)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
        matrix = np.zeros((n, len(some)), dtype=np.float32)
        matrix[owner[at], inside] = 1
        both += matrix @ matrix.T
    near = both >= similarity * (size[:, None] + size[None, :] - both)
    if side.any() and not side.all():
        near &= side[:, None] != side[None, :]
    np.fill_diagonal(near, False)
    return spanning_links(near)


def _linked(similarity: float):
    """Rows ``block, id, side, items``, sorted by block and id: the links within each block."""

    def links(ids: list[np.ndarray], sides: list[np.ndarray], sets: list[bytes]) -> pa.RecordBatch:
        id_, side = np.concatenate(ids), np.concatenate(sides)
        # A row that repeats is one set; an id with several texts stays several sets.
        keep = [i for i in range(len(id_)) if not i or id_[i] != id_[i - 1] or side[i] != side[i - 1] or sets[i] != sets[i - 1]]
        found = joining_links([np.frombuffer(sets[i], np.uint64) for i in keep], side[keep], similarity) if len(keep) > 1 else []
        a, b = (id_[keep][np.array([x[i] for x in found], np.int64)] for i in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ids, sides, sets = None, [], [], []
        for batch in batches:
            blocks = batch.column("block").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(blocks)) + 1).tolist(), len(blocks)]
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if a == b:
                    continue
                if block is not None and blocks[a] != block:
                    yield links(ids, sides, sets)
                    ids, sides, sets = [], [], []
                block = blocks[a]
                part = batch.slice(a, b - a)
                id_, side, items = part.column("id").to_numpy(), part.column("side").to_numpy(), part.column("items").to_pylist()
                # Of rows that repeat one after the other only the first is held.
                new = [i for i in range(len(items)) if not (i and id_[i] == id_[i - 1] and side[i] == side[i - 1] and items[i] == items[i - 1])]
                ids.append(id_[new])
                sides.append(side[new])
                sets += [items[i] for i in new]
        if sets:
            yield links(ids, sides, sets)

    return run


def _compared(members: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """Links a, b between the texts of ``members(id, block, side)`` that meet in a block; an id stands in as many blocks as it has rows."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = stored(members.select("id").distinct(), "ids")
    chosen = texts.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi").mapInArrow(freeing(_items(shingle)), "id long, items binary")
    rows = members.join(chosen.hint("merge"), "id").select("block", "id", "side", "items")
    found = rows.repartition(parts, "block").sortWithinPartitions("block", "id").mapInArrow(freeing(_linked(similarity)), "a long, b long")
    return stored(found.filter("a <> b").distinct(), "links")


def _verified(pairs: DataFrame, texts: DataFrame, similarity: float, shingle: int) -> DataFrame:
    """The pairs (a, b) whose multisets overlap in at least ``similarity`` of their union.

    Only the texts of one side's ids are turned into sets; their ids are broadcast up to a checked number,
    so that a text that is in no pair isn't shuffled.
    """

    def side(column: str, as_name: str) -> DataFrame:
        ids = stored(pairs.select(F.col(column).alias("id")).distinct(), "ids")
        chosen = texts.join(broadcast_if_small(ids, BROADCAST_IDS), "id", "left_semi")
        return chosen.mapInArrow(freeing(_items(shingle)), "id long, items binary").select(F.col("id").alias(column), F.col("items").alias(as_name)).hint("merge")

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(t, np.uint64) for t in batch.column(c).to_pylist()] for c in ("x", "y"))
            both = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)])
            size = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)])
            yield batch.select(["a", "b"]).filter(pa.array(both >= similarity * (size - both)))

    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return stored(met.mapInArrow(freeing(alike), "a long, b long").distinct(), "links")


def _blocks(rows: str, shingles: str):
    """How many blocks hold so many texts and shingles."""
    return F.greatest(F.ceil(F.col(rows) / BLOCK_TEXTS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _met_in_blocks(members: DataFrame) -> DataFrame:
    """Rows ``id, g, k``, a group cut into k blocks, as members of each two blocks of it."""
    own = F.pmod(F.xxhash64("id"), F.col("k")).cast("int")
    met = members.select("id", "g", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("other"))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return met.select("id", F.xxhash64("g", low, high).alias("block"), (F.col("own") > F.col("other")).cast("int").alias("side"))


def _crowds(same: DataFrame, texts: DataFrame, similarity: float, shingle: int, max_rounds: int) -> DataFrame:
    """Links of the texts ``same(id, n, bands)`` of groups of very many blocks: rounds of leaders, then blocks within buckets."""
    spread = same.select("id", "n", F.posexplode("bands").alias("band", "key"))
    total = same.count()
    some = spread.filter(F.col("band") < FIRST_BANDS)
    lead = some.groupBy("band", "key").agg(F.min(F.struct(F.col("id").alias("a"), F.col("n").alias("na"))).alias("lead"), F.count("*").alias("size")).filter("size > 1")
    pairs = some.join(lead.select("band", "key", "lead.a", "lead.na").hint("merge"), ["band", "key"]).filter("a <> id").filter(_alike_in_size(similarity))
    pairs = stored(pairs.groupBy(F.col("id").alias("b")).agg(F.min("a").alias("a")).select("a", "b"), "pairs")
    edges = _verified(pairs, texts, similarity, shingle)
    labels, before = stored(components(edges), "components"), None
    for number in range(max_rounds):
        marked = same.join(labels.hint("merge"), same["id"] == labels["node"], "left").select(
            "id", "n", F.coalesce("component", "id").alias("c"), F.posexplode("bands").alias("band", "key"))
        marked = stored(marked, "marked")
        parts = marked.groupBy("band", "key", "c").agg(F.count("*").alias("size"), F.sum("n").alias("shingles"), F.min(F.struct(F.xxhash64("id", F.lit(number)).alias("o"), "id", "n")).alias("one"))
        mixed = parts.groupBy("band", "key").agg(F.sum("size").alias("all"), F.sum("shingles").alias("weight"), F.count("*").alias("parts"),
                                                 F.max(F.struct("size", "c", "shingles", "one")).alias("top")).filter("parts > 1")
        mixed = stored(mixed.select("band", "key", "all", "weight", "top.size", "top.shingles", F.col("top.c").alias("top"), F.col("top.one.id").alias("a"), F.col("top.one.n").alias("na")), "mixed")
        left = mixed.agg(F.sum(F.expr("cast(all - size as double) * all"))).first()[0]
        if not left:
            break
        # So little is left that blocks do it, or leaders no longer help: what still shares a bucket is mostly unlike.
        last = left <= MOST_BLOCKS * BLOCK_TEXTS * total or number == max_rounds - 1 or before is not None and 2 * left > before
        before = left
        if last:
            few = _blocks("few", "few_shingles")
            cut = mixed.withColumn("few", F.col("all") - F.col("size")).withColumn("few_shingles", F.col("weight") - F.col("shingles"))
            cut = cut.select("band", "key", "top", few.alias("kf"), _blocks("size", "shingles").alias("kt"))
            met = marked.join(cut.hint("merge"), ["band", "key"])
            outside, bucket = F.col("c") != F.col("top"), F.xxhash64("band", "key")
            own = F.pmod(F.xxhash64("id"), F.when(outside, F.col("kf")).otherwise(F.col("kt"))).cast("int")
            # A text outside of the largest component meets all blocks, others only those outside: (block outside, block, side).
            each = F.transform(F.sequence(F.lit(0), F.col("kf") - 1), lambda j: F.when(
                outside, F.struct(F.xxhash64(bucket, F.lit(0), F.least(own, j), F.greatest(own, j)).alias("block"), (own > j).cast("int").alias("side"))).otherwise(
                F.struct(F.xxhash64(bucket, F.lit(1), j, own).alias("block"), F.lit(1).alias("side"))))
            more = F.when(outside, F.transform(F.sequence(F.lit(0), F.col("kt") - 1), lambda t: F.struct(
                F.xxhash64(bucket, F.lit(1), own, t).alias("block"), F.lit(0).alias("side")))).otherwise(F.array().cast("array<struct<block:bigint,side:int>>"))
            members = met.select("id", F.explode(F.concat(each, more)).alias("at")).select("id", "at.block", "at.side").distinct()
            return edges.unionByName(_compared(members, texts, similarity, shingle))
        met = marked.join(mixed.select("band", "key", "top", "a", "na").hint("merge"), ["band", "key"]).filter("c <> top")
        pairs = stored(met.filter(_alike_in_size(similarity)).select("a", F.col("id").alias("b")).distinct(), "pairs")
        found = _verified(pairs, texts, similarity, shingle)
        discard(marked, mixed, pairs)
        edges = edges.unionByName(found)
        old, labels = labels, stored(components(edges), "components")
        discard(old)
    return edges


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS,
                    rows: int = ROWS, max_rounds: int = 5) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, text_id, class_id, kept.

    ``text_id`` is the smallest doc_id with the same word sequence (the links between equal texts);
    ``class_id`` the smallest doc_id reachable by links of weighted Jaccard similarity >= ``similarity`` between multisets of
    ``shingle``-word shingles; ``kept`` whether the row's doc_id is the class_id. Words are separated by white
    space and compared unchanged. A text shorter than a shingle is one shingle; null and empty texts have no shingles and form one
    class of equal texts; rows with null doc_id have null classes, are not kept and link nothing; repeated rows are copies of each
    other, and each is returned (a doc_id with several texts joins their classes); other columns are ignored; an empty table gives no rows. Texts of any length
    are compared whole: a task holds all shingles of the texts of a block, one text at least.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text"))
    signed = stored(texts.mapInArrow(freeing(_signed(shingle, bands, rows)), "id long, k1 long, k2 long, n int, bands array<long>"), "signed")
    same = signed.filter("id is not null").groupBy("k1", "k2").agg(F.min(F.struct("id", "n", "bands")).alias("one"))
    same = stored(same.select("k1", "k2", F.col("one.id").alias("id"), F.col("one.n").alias("n"), F.col("one.bands").alias("bands")), "texts")
    spread = same.filter("n > 0").select("id", F.posexplode("bands").alias("band", "key"))
    head = spread.groupBy("band", "key").agg(F.min("id").alias("a"), F.count("*").alias("size")).filter("size > 1").select("band", "key", "a")
    stars = spread.join(head.hint("merge"), ["band", "key"]).filter("a <> id").select("a", F.col("id").alias("b"))
    group = components(contracted(stars)).select(F.col("node").alias("id"), F.col("component").alias("g"))
    members = stored(same.select("id", "n").groupBy("id").agg(F.max("n").alias("n")).join(group.hint("merge"), "id"), "members")
    sizes = members.groupBy("g").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")).select("g", _blocks("texts", "shingles").alias("k"))
    sizes = stored(sizes, "groups")
    usual = members.join(sizes.filter(F.col("k") <= MOST_BLOCKS).hint("merge"), "g")
    edges = _compared(_met_in_blocks(usual), texts, similarity, shingle)
    crowds = sizes.filter(F.col("k") > MOST_BLOCKS)
    if crowds.limit(1).count():
        ids = members.join(crowds.hint("merge"), "g").select("id")
        edges = edges.unionByName(_crowds(stored(same.join(ids.hint("merge"), "id", "left_semi").select("id", "n", "bands"), "crowds"), texts, similarity, shingle, max_rounds))
    twice = signed.filter("id is not null").select("id", "k1", "k2").join(same.select("k1", "k2", F.col("id").alias("first")).hint("merge"), ["k1", "k2"])
    split = twice.groupBy("id").agg(F.min("first").alias("a"), F.max("first").alias("b")).filter("a < b")
    split = stored(split.select("id"), "split")
    if split.limit(1).count():  # one id with several texts
        edges = edges.unionByName(twice.join(split.hint("merge"), "id").select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b").distinct())
    labels = components(edges)
    first = same.select("k1", "k2", F.col("id").alias("text_id")).hint("merge")
    out = signed.select(F.col("id").alias("doc_id"), "k1", "k2").join(first, ["k1", "k2"], "left")
    out = out.join(labels.hint("merge"), out["text_id"] == labels["node"], "left")
    has = F.col("doc_id").isNotNull()
    return out.select(
        "doc_id", F.when(has, F.col("text_id")).alias("text_id"), F.when(has, F.coalesce("component", "text_id")).alias("class_id"),
        (has & (F.col("doc_id") == F.coalesce("component", "text_id"))).alias("kept"))


def _alike_in_size(similarity: float):
    return F.least("na", "n") >= similarity * F.greatest("na", "n")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each class; all columns stay.

    Classes are of rows, matched by id and text, so unlike texts that share a doc_id, null included, each stay. Of a class the row
    of the smallest doc_id stays (null ids last); of rows that repeat both id and text one. Of all null and empty texts, which are one class, one
    stays; texts of any length are compared whole; other columns may have any name; an empty table gives no rows.
    """
    # One column holds the row, so no name of it can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    classes = near_duplicates(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).groupBy(F.col("doc_id").alias("key")).agg(
        F.min("class_id").alias("class_id"), F.count("*").alias("n"))
    ids = keyed.select("key", F.col("row")["doc_id"].alias("doc_id")).distinct()
    first = F.min_by(F.struct("key", "n"), F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("one")
    kept = classes.join(ids.hint("merge"), "key").groupBy("class_id").agg(first)
    kept = stored(kept.select("one.key", "one.n"), "kept")
    out = keyed.join(kept.select("key").hint("merge"), "key", "left_semi")
    if kept.filter("n > 1").limit(1).count():
        out = out.dropDuplicates(["key"])
    return out.select("row.*")

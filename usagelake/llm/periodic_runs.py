"""Maximal periodic runs of words: tiles for each octave of periods, solved alone, stitched by document and period.

Tiles. Periods from B to 2B - 1 (B a power of two) are an octave. A document is exploded into tiles for each octave, of at least ``SPAN``
x B words with margins of 2B before and 4B behind; octaves whose tiles are the same words share one. Tiles of many documents stand
one after the other in an array, with a sign between them that nothing equals.

A tile. A run of period q holds, in its first q words, a boundary (every B/2 words) whose next B/2 words stand again q words later. So
boundaries with equal names at a distance of the octave are all candidates. Names are exact: a run of 2^j words is named by its two
halves, and only what occurs twice in a tile is named at all, so texts without repeats stop after two or three levels. A candidate's
Z-functions, forwards and backwards from the boundary against q words later, are read off the names in steps of falling powers of two, for all
candidates at once, up to 2B words. If the two make up q words, they bound a fragment of a run.

Stitching. Fragments of one run at neighbouring boundaries share at least q words, different runs of period q never do: fragments
are shuffled by document and period and joined where they share q words. A stretch found for several periods has the smallest one
(its others are multiples). Only fragments are shuffled, and of texts with fragments their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from usagelake.llm.shared import freeing, stored

#: A run has at least this many words, and twice its period.
LEAST = 12
#: Words of a tile's core, at least, and for each B of the octave.
CORE = 1 << 15
SPAN = 16
#: Words solved at a time.
PORTION = 1 << 20
#: Octaves up to this B look at every distance in turn, larger ones search equal names.
DENSE = 8

FRAGMENTS = pa.list_(pa.struct([("q", pa.int64()), ("s", pa.int64()), ("e", pa.int64())]))


def tiles_of(n: int) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(low, high, first and end of the core, first and last octave) of each tile of a document of n words."""
    if n < LEAST:
        return
    top, k = (n // 2).bit_length() - 1, 0
    while k <= top:
        core = max(CORE, SPAN << k)
        if core >= n:
            yield 0, n, 0, n, k, top
            return
        last = min(top, max(k, (CORE // SPAN).bit_length() - 1))
        b = 1 << last
        for at in range(0, n, core):
            end = min(at + core, n)
            yield max(0, at - 2 * b), min(n, end + 4 * b), at, end, k, last
        k = last + 1


class Names:
    """Names of all runs of 2^j signs that occur at least twice; other places have a negative name that nothing else has."""

    def __init__(self, signs: np.ndarray):
        self.none = -np.arange(1, len(signs) + 1)
        self.levels = [np.where(np.bincount(signs)[signs] > 1, signs, self.none)]

    def level(self, j: int) -> np.ndarray | None:
        """Level j, or nothing if no run of 2^j signs occurs twice."""
        while len(self.levels) <= j:
            half, step = self.levels[-1], 1 << (len(self.levels) - 1)
            live = np.flatnonzero(half[:-step] >= 0) if step < len(half) else np.zeros(0, dtype=np.int64)
            live = live[half[live + step] >= 0]
            if not len(live):
                return None
            _, name, times = np.unique(half[live] * (half.max() + 1) + half[live + step], return_inverse=True, return_counts=True)
            again = times[name] > 1
            if not again.any():
                return None
            new = self.none.copy()
            new[live[again]] = name[again]
            self.levels.append(new)
        return self.levels[j]

    def common(self, a: np.ndarray, b: np.ndarray, most: int, backwards: bool) -> np.ndarray:
        """How many signs (at most ``most``, a power of two) from a and from b on are equal, or before them: Z-functions."""
        n = np.zeros(len(a), dtype=np.int64)
        top = most.bit_length() - 1
        self.level(top)
        for j in range(min(top, len(self.levels) - 1), -1, -1):
            names, step = self.levels[j], 1 << j
            x, y = (a - n - step, b - n - step) if backwards else (a + n, b + n)
            fits = (n + step <= most) & (x >= 0)
            n += step * (fits & (names[np.maximum(x, 0)] == names[np.maximum(y, 0)]))
        return n


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _joined(tile: np.ndarray, q: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments of one tile and period that share at least q words become one."""
    order = np.lexsort((e, s, q, tile))
    tile, q, s, e = tile[order], q[order], s[order], e[order]
    head = np.flatnonzero(np.r_[True, (tile[1:] != tile[:-1]) | (q[1:] != q[:-1]) | (s[1:] > e[:-1] - q[1:])])
    return tile[head], q[head], s[head], np.maximum.reduceat(e, head)


def solve(parts: list[np.ndarray], shapes: np.ndarray) -> tuple[np.ndarray, ...]:
    """Fragments (tile, q, start, end in words of the document) of the tiles: ``parts`` has each one's signs (from 0), ``shapes`` its ``tiles_of``."""
    lengths = np.array([len(p) for p in parts])
    begin = np.cumsum(lengths + 1) - lengths - 1
    signs = np.empty(int(lengths.sum()) + len(parts), dtype=np.int64)
    base = 0
    for at, part in zip(begin.tolist(), parts, strict=True):
        signs[at : at + len(part)] = part + base
        base += int(part.max(initial=-1)) + 1
        signs[at + len(part)] = base
        base += 1
    tile_of = np.repeat(np.arange(len(parts)), lengths + 1)
    low, _, first, end, octave, last = shapes.T
    names, total, out = Names(signs), len(signs), []

    def boundaries(at: np.ndarray, k: int) -> np.ndarray:
        tile = tile_of[at]
        place = at - begin[tile] + low[tile]
        return at[(place % max(1, 1 << k >> 1) == 0) & (place >= first[tile]) & (place < end[tile]) & (octave[tile] <= k) & (last[tile] >= k)]

    for k in range(int(last.max()) + 1):
        b = 1 << k
        level = names.level(max(0, k - 1))
        if level is None:
            break
        if b <= DENSE:
            found = [(at := boundaries(np.flatnonzero(level[:-q] == level[q:]), k), np.full(len(at), q)) for q in range(b, 2 * b) if q < total]
            at, q = (np.concatenate(x) for x in zip(*found, strict=True))
        else:
            live = np.flatnonzero(level >= 0)
            keys = np.sort(level[live] * total + live)
            at = boundaries(live, k)
            name = level[at] * total
            left, right = (np.searchsorted(keys, name + np.minimum(at + x, total)) for x in (b, 2 * b))
            counts = right - left
            at, name = np.repeat(at, counts), np.repeat(name, counts)
            q = keys[_spread(left, counts)] - name - at
        if not len(at):
            continue
        ahead, behind = (names.common(at, at + q, 2 * b, x) for x in (False, True))
        run = ahead + behind >= q
        at, q, ahead, behind = at[run], q[run], ahead[run], behind[run]
        tile = tile_of[at]
        place = at - begin[tile] + low[tile]
        if len(at):
            out.append(_joined(tile, q, place - behind, place + q + ahead))
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 4
    tile, q, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    # Where one tile is the document for all octaves, fragments are whole: short ones and multiples of a period go at once.
    whole = (octave == 0) & (first == 0) & (lengths == end)
    stay = ~whole[tile] | (e - s >= LEAST)
    tile, q, s, e = tile[stay], q[stay], s[stay], e[stay]
    order = np.lexsort((q, e, s, tile))
    tile, q, s, e = tile[order], q[order], s[order], e[order]
    same = np.r_[False, (tile[1:] == tile[:-1]) & (s[1:] == s[:-1]) & (e[1:] == e[:-1])] & whole[tile]
    return tile[~same], q[~same], s[~same], e[~same]


def _fragments(words: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Fragments (text, q, start, end) of a portion's texts, by text."""
    out, parts, shapes, owner, held = [], [], [], [], 0

    def flush() -> None:
        nonlocal parts, shapes, owner, held
        if parts:
            tile, q, s, e = solve(parts, np.array(shapes, dtype=np.int64))
            out.append((np.array(owner, dtype=np.int64)[tile], q, s, e))
        parts, shapes, owner, held = [], [], [], 0

    for i, text in enumerate(words):
        index: dict[bytes, int] = {}
        number = index.setdefault
        signs = np.array([number(w, len(index)) for w in text], dtype=np.int64) if len(text) >= LEAST else None
        for shape in tiles_of(len(text)):
            part = signs[shape[0] : shape[1]]
            parts.append(part)
            shapes.append(shape)
            owner.append(i)
            held += len(part)
            if held >= PORTION:
                flush()
    flush()
    if not out:
        return (np.zeros(0, dtype=np.int64),) * 4
    text, q, s, e = (np.concatenate(x) for x in zip(*out, strict=True))
    order = np.argsort(text, kind="stable")
    return text[order], q[order], s[order], e[order]


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[int, int, list[list[bytes]]]]:
    """Rows from, rows to, and their words: some ``PORTION`` words at a time."""
    texts = batch.column("text")
    start, held, have = 0, [], 0
    for i in range(batch.num_rows):
        words = (texts[i].as_py() or b"").split()  # of bytes, white space is 0x20 and 0x09 to 0x0D
        held.append(words)
        have += len(words)
        if have >= PORTION or i == batch.num_rows - 1:
            yield start, i + 1, held
            start, held, have = i + 1, [], 0


def _scan(keep: bool):
    """Each text's fragments; its words where it has some (or ``keep`` says so), else their digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            for start, end, words in _portions(batch):
                text, q, s, e = _fragments(words)
                at = np.searchsorted(text, np.arange(len(words) + 1))
                some = np.diff(at) > 0
                joined = [b" ".join(w) for w in words]
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.StructArray.from_arrays([pa.array(x) for x in (q, s, e)], ["q", "s", "e"]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row + np.arange(len(words))), batch.column("doc_id").slice(start, end - start), pa.array([len(w) for w in words], pa.int64()),
                     pa.array([None if x or keep else hashlib.sha256(j).hexdigest() for x, j in zip(some, joined, strict=True)], pa.string()),
                     pa.array([j if x or keep else None for x, j in zip(some, joined, strict=True)], pa.binary()), lists],
                    names=["row", "doc_id", "n_words", "digest", "words", "fragments"])
                row += len(words)

    return freeing(run)


def _stitched(scan: DataFrame) -> DataFrame:
    """``row, runs``: the runs of each text that has some, by start, then period."""
    pieces = scan.filter(F.size("fragments") > 0).select("row", F.inline("fragments"))
    by_start = Window.partitionBy("row", "q").orderBy("s", "e")
    fresh = F.coalesce(F.col("s") > F.lag("e").over(by_start) - F.col("q"), F.lit(True))
    pieces = pieces.withColumn("fresh", fresh.cast("int")).withColumn("run", F.sum("fresh").over(by_start))
    whole = pieces.groupBy("row", "q", "run").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    long = whole.filter(F.col("e") - F.col("s") >= F.greatest(F.lit(LEAST), 2 * F.col("q")))
    one = long.groupBy("row", "s", "e").agg(F.min("q").alias("q"))
    run = F.struct(F.col("s").alias("start"), (F.col("e") - F.col("s")).alias("length"), F.col("q").alias("period"))
    return one.groupBy(F.col("row").alias("of")).agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _collapsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words that no run holds after its first period."""
    for batch in batches:
        out = []
        for words, runs in zip(batch.column("words"), batch.column("runs"), strict=True):
            words = words.as_py()
            if words is not None and runs.is_valid and len(runs):
                words = words.split(b" ")
                r = {name: runs.values.field(name).to_numpy(zero_copy_only=False) for name in ("start", "length", "period")}
                mark = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(mark, r["start"] + r["period"], 1)
                np.add.at(mark, r["start"] + r["length"], -1)
                words = b" ".join([words[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) == 0).tolist()])
            out.append(words)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), batch.column("runs"), batch.column("digest"), pa.array(out, pa.binary())],
                                         names=["doc_id", "n_words", "runs", "digest", "collapsed"])


def _found(docs: DataFrame, keep: bool) -> DataFrame:
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    scan = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(
        _scan(keep), f"row long, doc_id {kind}, n_words long, digest string, words binary, fragments array<struct<q:long,s:long,e:long>>")
    scan = stored(scan, "fragments")
    runs = _stitched(scan)
    joined = scan.join(runs, F.col("row") == F.col("of"), "left").select("doc_id", "n_words", "digest", "words", "runs")
    return joined.mapInArrow(
        freeing(_collapsed), f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, digest string, collapsed binary")


def collapse(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, runs, collapsed`` of each row of ``docs(doc_id, text)``.

    Words are runs of characters other than space and tab to carriage return. A run is a stretch of words with smallest period q and of at least
    ``LEAST`` and 2q words that no neighbouring word extends; ``runs`` has each one's start (from 0), length and period, by start, then period.
    ``collapsed`` are the words, joined by one space, that no run holds after its first q words. Null and empty texts have no words and
    no runs; repeated rows and ids stay; other columns are ignored; an empty table gives no rows. Texts of any length are solved whole:
    a task holds one text, its fragments and the names of its largest tile (n log n in time, and in memory if all of it repeats).
    """
    found = _found(docs, keep=True)
    return found.select("doc_id", "n_words", F.coalesce("runs", F.array()).alias("runs"), F.col("collapsed").cast("string").alias("collapsed"))


def planted(docs: DataFrame) -> DataFrame:
    """``doc_id, text``: with h = crc32(decimal doc_id), texts with h % 10 = 0 repeat themselves from word g % n on (g = h // 10), with
    period 1 + (n - g % n) // (3 + g % 8); the others, null texts and null ids stay."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeated(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        tail = F.transform(F.sequence(a, n - 1), lambda i: F.get(words, (a + (i - a) % p).cast("int")))
        return F.when(n > 0, F.array_join(F.concat(F.slice(words, F.lit(1), a.cast("int")), tail), " ")).otherwise(F.lit(""))

    words = F.filter(F.split("text", "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    # A lambda's variable is worked out once; a column would be at each use.
    text = F.get(F.transform(F.array(words), repeated), F.lit(0))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), text).otherwise(F.col("text").cast("string")).alias("text"))


def digest(docs: DataFrame) -> DataFrame:
    """One row for each document: its number of runs, the longest one (ties: smallest start, then period) and digests of runs and collapsed words."""
    found = _found(docs, keep=False)
    runs = F.coalesce("runs", F.array())
    line = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    rows = found.select("doc_id", "digest", "collapsed", F.size(runs).cast("long").alias("n_runs"), F.array_join(line, "").alias("lines"), best.alias("best"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.s")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.p")).alias("exponent_milli"), F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.coalesce("digest", F.sha2("collapsed", 256)).alias("collapsed_sha256"))

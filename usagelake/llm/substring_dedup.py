"""Substring dedup by hashes of windows and content-defined reference blocks, in place of relative Lempel-Ziv factoring.

Reference blocks. Every run of ``ANCHOR`` words is hashed and the smallest hash of each window's runs is
the window's anchor (``WINDOW`` words hold ``WINDOW - ANCHOR + 1`` runs), so equal windows have equal anchors wherever they stand. A
block is the text of all consecutive windows of one anchor. All distinct blocks of the corpus are the
reference, indexed by anchor, each with its number of occurrences.

Marks. No longest match is searched. A block that occurs again is a copy of the reference; what is marked are
maximal runs of such blocks, extended at both boundaries, where blocks differ (an edit, the end of a
shared passage) and single windows are checked against the windows of every distinct block with the same
anchor. Runs of at least ``WINDOW`` words are the duplicate spans. Copies meet as counts of
equal blocks, never as pairs; what is checked window by window are distinct blocks only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.hashing import Runs, split_words, word_hashes
from usagelake.llm.shared import stored

#: Words of a window: shorter repeats are kept.
WINDOW = 35
#: Words of an anchor.
ANCHOR = 18


def _batch_words(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one buffer; word starts and ends; the first word of each text (one more at the end)."""
    data = b"\n".join(texts)
    starts, ends = split_words(data)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    return data, starts, ends, np.searchsorted(starts, at)


def _pieces(batches: Iterator[pa.RecordBatch], size: int = 2 << 20) -> Iterator[tuple[np.ndarray, list, list[bytes]]]:
    """Rows and texts in portions of about ``size`` bytes, so that a batch of long texts needs no more memory."""
    for batch in batches:
        texts, rows = batch.column("text"), batch.column("row").to_numpy(zero_copy_only=False)
        rest = [batch.column(i) for i in range(2, batch.num_columns)]
        start, held, have = 0, [], 0
        for i in range(batch.num_rows):
            t = texts[i].as_py() or b""
            held.append(t)
            have += len(t)
            if have >= size or i == batch.num_rows - 1:
                yield rows[start : i + 1], [c.slice(start, i + 1 - start) for c in rest], held
                start, held, have = i + 1, [], 0


def _both_runs(data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[Runs, Runs]:
    """Two independent hashes of words and of their runs, so that runs are told apart by 128 bits."""
    return Runs(word_hashes(data, starts, ends)), Runs(word_hashes(data, starts, ends, seed=1))


def _windows(first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all whole windows and the text of each."""
    counts = np.maximum(np.diff(first) - window + 1, 0)
    text = np.repeat(np.arange(len(counts)), counts)
    offset = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    return first[text] + offset, text


def _blocks(window: int, anchor: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, texts in _pieces(batches):
            data, begin, end, first = _batch_words(texts)
            start, text = _windows(first, window)
            if not len(start):
                continue
            runs, second = _both_runs(data, begin, end)
            grams = runs.hashes(np.arange(len(begin) - anchor + 1), np.arange(anchor, len(begin) + 1))
            span = window - anchor + 1
            low, where = grams[start], start.copy()
            for j in range(1, span):  # leftmost smallest: equal windows choose the same place
                x = grams[start + j]
                less = x < low
                low = np.where(less, x, low)
                where = np.where(less, start + j, where)
            head = np.flatnonzero(np.r_[True, (where[1:] != where[:-1]) | (text[1:] != text[:-1])])
            tail = np.r_[head[1:], len(start)] - 1
            a, b = start[head], start[tail]
            block, check = (x.hashes(a, b + window) for x in (runs, second))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[text[head]]), pa.array((a - first[text[head]]).astype(np.int32)), pa.array((b - a + 1).astype(np.int16)),
                 pa.array(low[head].view(np.int64)), pa.array(block.view(np.int64)), pa.array(check.view(np.int64))],
                names=["row", "at", "n", "anchor", "block", "check"],
            )

    return run


def _edge_windows(window: int):
    """Hashes of the windows of the wanted blocks: for each text its list of (at, n, block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (wanted,), texts in _pieces(batches):
            data, begin, end, first = _batch_words(texts)
            runs = _both_runs(data, begin, end)
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, row in enumerate(rows):
                w = wanted[i].values
                at = w.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                n = w.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                block = np.repeat(np.arange(len(at)), n)
                start = at[block] + np.arange(len(block)) - np.repeat(np.cumsum(n) - n, n)
                h, check = (x.hashes(first[i] + start, first[i] + start + window) for x in runs)
                for k, x in enumerate((np.full(len(start), row), start.astype(np.int32), h.view(np.int64), check.view(np.int64),
                                       w.field("times").to_numpy(zero_copy_only=False)[block],
                                       w.field("lone").to_numpy(zero_copy_only=False)[block])):
                    out[k].append(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], names=["row", "at", "h", "check", "times", "lone"])

    return run


def _numbered(docs: DataFrame) -> DataFrame:
    """Rows by (row, text): ``row`` is the row's own id, as ids of documents may repeat or be null."""
    return docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"))


def duplicate_windows(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """Rows (row, at, n): the n windows from word ``at`` of a text are all repeated somewhere.

    ``row`` is xxhash64(doc_id, text); rows equal in both share it and all their windows are repeated.
    """
    texts = _numbered(docs)
    blocks = stored(texts.mapInArrow(_blocks(window, anchor), "row long, at int, n short, anchor long, block long, check long"), "blocks")
    kinds = blocks.groupBy("anchor", "block", "check").agg(F.count("*").alias("times"))
    # Anchors of at least two different blocks: their windows have to be looked at one by one.
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("times").alias("total")).filter("total > 1")
    mixed = stored(mixed.select("anchor", (F.col("kinds") > 1).alias("mixed")), "anchors")
    met = stored(blocks.join(mixed, "anchor"), "met")
    times = stored(met.groupBy("block", "check").agg(
        F.count("*").alias("times"), F.min(F.struct("row", "at", "n")).alias("one"), F.max("mixed").alias("mixed")), "kinds")
    whole = met.join(times.filter("times > 1").select("block", "check"), ["block", "check"]).select("row", "at", "n")

    # One occurrence of each distinct block of such an anchor speaks for all its occurrences.
    wanted = times.filter("mixed").select(
        F.col("one.row").alias("id"), F.struct(F.col("one.at").alias("at"), F.col("one.n").alias("n"), "times",
                                               (F.col("times") == 1).alias("lone")).alias("w"))
    wanted = wanted.groupBy("id").agg(F.collect_list("w").alias("wanted"))
    edges = texts.join(wanted, F.col("row") == F.col("id")).select("row", "text", "wanted").mapInArrow(
        _edge_windows(window), "row long, at int, h long, check long, times long, lone boolean")
    edges = stored(edges, "edges")
    again = stored(edges.groupBy("h", "check").agg(F.sum("times").alias("times")).filter("times > 1").select("h", "check"), "again")
    single = edges.filter("lone").join(again, ["h", "check"]).select("row", "at", F.lit(1).cast("short").alias("n"))
    return whole.unionByName(single)


def _kept(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, (ids, spans), texts in _pieces(batches):
            data, starts, ends, first = _batch_words(texts)
            kept, total, removed, cut = [], [], [], []
            for i in range(len(rows)):
                lo, hi = first[i], first[i + 1]
                mark = np.zeros(hi - lo + 1, dtype=np.int32)
                if spans[i].is_valid and len(spans[i]):
                    s = spans[i].values
                    at = s.field("at").to_numpy(zero_copy_only=False).astype(np.int64)
                    n = s.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                    np.add.at(mark, at, 1)
                    np.add.at(mark, np.minimum(at + n - 1 + window, hi - lo), -1)
                gone = np.cumsum(mark[:-1]) > 0
                stay = np.flatnonzero(~gone) + lo
                total.append(hi - lo)
                removed.append(int(gone.sum()))
                kept.append(b" ".join([data[a:b] for a, b in zip(starts[stay].tolist(), ends[stay].tolist(), strict=True)]))
                edge = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                cut.append([{"start": int(a), "end": int(b)} for a, b in edge.reshape(-1, 2)])
            yield pa.RecordBatch.from_arrays(
                [ids.cast(pa.int64()), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()),
                 pa.array(cut, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                names=["doc_id", "n_words", "n_removed", "kept", "spans"],
            )

    return run


def remove_duplicates(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, n_removed, kept, spans.

    Words are runs of characters other than space and tab to carriage return. Every word in a window of
    ``window`` words whose sequence also starts at another place of any row (the same one included) is
    removed; ``spans`` are the removed runs of words (from 0, end exclusive), ``kept`` the other words
    joined by one space. Null and empty texts have no words and keep an empty text; an empty table gives
    no rows; repeated rows are copies of each other; other columns are ignored. Texts of any length, and words of any length, are compared whole.
    """
    spans = duplicate_windows(docs, window, anchor)
    spans = spans.groupBy(F.col("row").alias("id")).agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), F.col("text").cast("binary").alias("text"),
                        F.col("doc_id").cast("long").alias("doc_id"))
    joined = texts.join(spans, F.col("row") == F.col("id"), "left").select("row", "text", "doc_id", "spans")
    return joined.mapInArrow(
        _kept(window), "doc_id long, n_words long, n_removed long, kept string, spans array<struct<start:int,end:int>>")


def digest(docs: DataFrame) -> DataFrame:
    """``remove_duplicates`` with a digest of the kept words in their place."""
    return remove_duplicates(docs).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))

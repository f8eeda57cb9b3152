"""LM scoring: marginal document probability over a subword lattice.

The pieces of an existing vocabulary file (its path is a parameter) and the 256 single bytes are the
symbols of a unigram model; a text is its lower-cased words, each with a word start, then one end. Its probability is the sum
over all segmentations into pieces, by the forward recursion in log space. Pieces do not cross word
starts, so a text's log probability is the sum over its words, and each distinct word is worked out
once a portion.

The public vocabulary file is a BPE model: its scores are ranks of merges, not log probabilities, so they can't weight
segmentations as they stand. The ranks give starting weights (Zipf's law), which expectation
maximisation over the word counts of all training texts turns into probabilities: each step adds up,
over the distinct words of the corpus, the expected number of uses of each piece. Piece counts are as
long as the vocabulary; word counts, which grow with the corpus, stay distributed.

Beside it stands the base score, add-one word counts. Words that make up at least 1 in ``HOT`` of the
training tokens, so at most ``HOT`` words, are looked up in a broadcast table, all others by a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.hashing import mix
from usagelake.llm.sentencepiece import MARK, MODEL, Vocabulary
from usagelake.llm.shared import held_out, stored

#: Steps of expectation maximisation.
STEPS = 2
#: Added to the expected uses of each piece.
SMOOTHING = 0.1
#: Broadcast words have at least 1/HOT of the training tokens (and at most LONGEST_HOT bytes).
HOT = 300_000
LONGEST_HOT = 64
#: Bytes of text whose distinct words are worked out together, and cells of a lattice worked on at once.
PORTION = 24 << 20
CELLS = 1 << 21

_BASE = 0x9E3779B97F4A7C15


class Lattice:
    """Pieces as byte strings with natural-log weights, and recursions over many words at once."""

    def __init__(self, pieces: list[bytes], weights: np.ndarray):
        self.pieces, self.weights = pieces, weights
        self.longest = max(map(len, pieces))
        keys = np.array([self._key(p) for p in pieces], np.uint64)
        order = np.argsort(keys)
        self.keys, self.order = keys[order], order
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have one hash")
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.keys >> np.uint64(42)).astype(np.int64)] = True

    @staticmethod
    def _key(piece: bytes) -> int:
        h = 0
        for b in piece:
            h = (h * _BASE + b + 1) & 0xFFFFFFFFFFFFFFFF
        return int(mix(np.array([h ^ len(piece)], np.uint64))[0])

    def edges(self, codes: np.ndarray) -> list[np.ndarray]:
        """For words of one length (rows of bytes): by piece length, the piece at each place or -1."""
        out, n = [], codes.shape[1]
        h = np.zeros_like(codes, dtype=np.uint64)
        for size in range(1, min(self.longest, n) + 1):
            h = h[:, : n - size + 1] * np.uint64(_BASE) + codes[:, size - 1 :] + np.uint64(1)
            key = mix(h ^ np.uint64(size))
            piece = np.full(key.shape, -1, np.int64)
            may = np.nonzero(self.sieve[(key >> np.uint64(42)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.keys, key[may]), len(self.keys) - 1)
            piece[may] = np.where(self.keys[at] == key[may], self.order[at], -1)
            out.append(piece)
        return out

    def _batches(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of equal length, with a word start, and whose they are."""
        sizes = np.array([len(w) for w in words], np.int64)
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(np.r_[-1, sizes[order], -1]))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            n = int(sizes[order[a]]) + 1
            step = max(1, CELLS // (n * min(n, self.longest)))
            for x in range(a, b, step):
                mine = order[x : min(b, x + step)]
                data = b"".join([b" " + words[i] for i in mine])
                yield np.frombuffer(data, np.uint8).reshape(len(mine), n).astype(np.uint64), mine

    def _forward(self, edges: list[np.ndarray], rows: int, n: int) -> tuple[np.ndarray, list[np.ndarray]]:
        weights = np.r_[self.weights, -np.inf]
        weight = [weights[e] for e in edges]
        alpha = np.full((n + 1, rows), -np.inf)
        alpha[0] = 0
        for end in range(1, n + 1):
            for size in range(1, min(len(edges), end) + 1):
                alpha[end] = np.logaddexp(alpha[end], alpha[end - size] + weight[size - 1][:, end - size])
        return alpha, weight

    def log_probabilities(self, words: list[bytes]) -> np.ndarray:
        """Of each word, over all its segmentations."""
        out = np.zeros(len(words))
        for codes, mine in self._batches(words):
            edges = self.edges(codes)
            out[mine] = self._forward(edges, *codes.shape)[0][-1]
        return out

    def expected_uses(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """How often each piece is used in the words, by the forward and backward recursions."""
        out = np.zeros(len(self.pieces) + 1)
        for codes, mine in self._batches(words):
            rows, n = codes.shape
            edges = self.edges(codes)
            alpha, weight = self._forward(edges, rows, n)
            beta = np.full((n + 1, rows), -np.inf)
            beta[n] = 0
            for at in range(n - 1, -1, -1):
                for size in range(1, min(len(edges), n - at) + 1):
                    beta[at] = np.logaddexp(beta[at], beta[at + size] + weight[size - 1][:, at])
            for size, piece in enumerate(edges, 1):
                on = piece >= 0
                use = (alpha[: n - size + 1].T + weight[size - 1] + beta[size:].T - alpha[-1][:, None])[on]
                out += np.bincount(piece[on], np.exp(use) * np.broadcast_to(counts[mine][:, None], piece.shape)[on], len(out))
        return out[:-1]


def starting_lattice(model: str = MODEL) -> Lattice:
    """The vocabulary's pieces that lower-cased words can use, and all bytes, weighted by the rank of their scores."""
    with open(model, "rb") as file:
        v = Vocabulary(file.read())
    rank: dict[bytes, float] = {}
    best = sorted((i for i in v.plain), key=lambda i: -v.scores[i])
    for place, i in enumerate(best):
        piece = v.pieces[i].replace(MARK, " ").encode()
        if " " not in v.pieces[i].replace(MARK, " ")[1:] and piece == piece.lower():
            rank.setdefault(piece, place)
    for b in range(256):
        if bytes([b]) != b" ":
            rank.setdefault(bytes([b]), len(best))
    rank.setdefault(b" ", len(best))
    weights = -np.log(np.array(list(rank.values())) + 10.0)
    return Lattice(list(rank), weights - np.log(np.exp(weights).sum()))


def _texts(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    rows, texts, have = [], [], 0
    for batch in batches:
        rest = [batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names) if c != "text"]
        for row, t in zip(zip(*rest, strict=True), batch.column("text"), strict=True):
            rows.append(row)
            texts.append((t.as_py() or b"").lower())  # of bytes: A-Z only
            have += len(texts[-1])
            if have >= size:
                yield rows, texts
                rows, texts, have = [], [], 0
    if rows:
        yield rows, texts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word counts of each portion; the row without a word counts the texts."""
    for rows, texts in _texts(((b.append_column("one", pa.nulls(b.num_rows))) for b in batches), PORTION):
        found: Counter = Counter()
        for t in texts:
            found.update(t.split())
        words, counts = list(found), list(found.values())
        for a in range(0, len(words), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(words[a : a + 50_000], pa.binary()), pa.array(counts[a : a + 50_000], pa.int64())], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.binary()), pa.array([len(rows)], pa.int64())], names=["word", "n"])


def _expected(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = shared.value
        total = np.zeros(len(lattice.pieces))
        for batch in batches:
            total += lattice.expected_uses(batch.column("word").to_pylist(), batch.column("n").to_numpy(zero_copy_only=False).astype(float))
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], names=["piece", "uses"])

    return run


def _scored(shared):
    """For each text its marginal probability, what the broadcast words add to the base score, and its other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, hot = shared.value
        for rows, texts in _texts(batches, PORTION):
            words = [t.split() for t in texts]
            index: dict[bytes, int] = {}
            ids = np.fromiter((index.setdefault(w, len(index)) for ws in words for w in ws), np.int64, sum(map(len, words)))
            distinct = list(index)
            logs = lattice.log_probabilities(distinct)
            known = np.array([hot.get(w, -1) for w in distinct], np.int64)
            add = np.log10(np.maximum(known, 0) + 1.0)
            size = np.array([len(ws) for ws in words])
            bounds = np.r_[0, np.cumsum(size)]
            for a in range(0, len(rows), 500):
                out: list[list] = [[] for _ in range(6)]
                for i in range(a, min(len(rows), a + 500)):
                    mine = ids[bounds[i] : bounds[i + 1]]
                    is_hot = known[mine] >= 0
                    rest, times = np.unique(mine[~is_hot], return_counts=True)
                    values = (len(mine), float(logs[mine].sum()), float(add[mine[is_hot]].sum()), int(is_hot.sum()), [distinct[j] for j in rest.tolist()], times.tolist())
                    for column, x in zip(out, values, strict=True):
                        column.append(x)
                kinds = (pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int32()))
                part = rows[a : a + 500]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in part], pa.int64()), pa.array([r[1] for r in part], pa.int64()), *[pa.array(x, k) for x, k in zip(out, kinds, strict=True)]],
                    names=["row_no", "doc_id", "words", "logs", "hot_add", "hot_known", "rest", "times"])

    return run


def score(docs: DataFrame, model: str = MODEL, steps: int = STEPS) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Scores are log10 probabilities of the whole text and its end. Learned from the texts whose crc32 of the id leaves another
    remainder than 2 modulo 7 (a null id is learned from). Null and empty texts are an end alone; without training texts all counts are
    0; an empty table gives no rows; repeated rows count as often as they occur; other columns are ignored. Texts of any length are scored whole; a
    word is one row of a lattice, so one of a megabyte takes a task some hundred megabytes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    training = texts.filter(~held_out(F.col("doc_id"), 7)).select("text")
    counts = training.mapInArrow(_counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "word-counts")
    ends = counts.filter("word is null").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    counts = counts.filter("word is not null")
    words, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    tokens, kinds = words + ends, distinct + (ends > 0)

    lattice, log_end = starting_lattice(model), np.log(0.5)
    for _ in range(steps):
        shared = spark.sparkContext.broadcast(lattice)
        uses = np.zeros(len(lattice.pieces))
        for row in counts.mapInArrow(_expected(shared), "piece int, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).collect():
            uses[row["piece"]] = row["uses"]  # as many rows as pieces
        total = uses.sum() + ends + SMOOTHING * (len(uses) + 1)
        lattice = Lattice(lattice.pieces, np.log((uses + SMOOTHING) / total))
        log_end = np.log((ends + SMOOTHING) / total)

    least = max(1, -(-words // HOT))
    hot = {bytes(r["word"]): r["n"] for r in counts.filter((F.col("n") >= least) & (F.octet_length("word") <= LONGEST_HOT)).collect()}
    shared = spark.sparkContext.broadcast((lattice, hot))
    read = texts.select(F.monotonically_increasing_id().alias("row_no"), "doc_id", "text")
    found = stored(read.mapInArrow(
        _scored(shared), "row_no long, doc_id long, words long, logs double, hot_add double, hot_known long, rest array<binary>, times array<int>"), "scored")
    rest = found.select("row_no", F.explode(F.arrays_zip("rest", "times")).alias("x")).select("row_no", F.col("x.rest").alias("word"), F.col("x.times").alias("times"))
    rest = rest.join(counts.hint("merge"), "word").groupBy("row_no").agg(
        F.sum(F.col("times") * F.log10(F.col("n") + 1.0)).alias("add"), F.sum("times").alias("known"))
    out = found.drop("rest", "times").join(rest.hint("merge"), "row_no", "left")
    n_tokens = F.col("words") + 1
    return out.select(
        "doc_id", held_out(F.col("doc_id"), 7).alias("held_out"), n_tokens.alias("n_tokens"),
        (F.col("hot_known") + F.coalesce("known", F.lit(0)) + (1 if ends else 0)).cast("long").alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"),
        (F.col("hot_add") + F.coalesce("add", F.lit(0.0)) + float(np.log10(ends + 1)) - n_tokens * float(np.log10(tokens + kinds + 1))).alias("base_score"),
        ((F.col("logs") + float(log_end)) / float(np.log(10))).alias("score"))

"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

Features of a text: its words (hashed, binary, scaled to unit length), binned statistics of its
structure (one-hot), and its binned length as metadata. The score is a bias, a linear term, and the pairwise
interactions of low-rank factors, in linear time by the identity
sum_{i<j} <v_i, v_j> x_i x_j = 1/2 sum_f ((sum_i v_if x_i)**2 - sum_i v_if**2 x_i**2).

The model is fitted on a bounded sample of the labelled rows; features of the sample are made by
Spark tasks and the fit itself, a few thousand short rows, is done by one process. Scoring reads every whole text in Arrow batches.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from usagelake.llm.hashing import split_words, word_hashes
from usagelake.llm.shared import freeing, held_out

#: The most labelled rows that the model is fitted on, chosen by a hash of their id.
FIT_ROWS = 6_000
#: Hashed word buckets, factors, passes over the sample.
BUCKETS = 1 << 14
RANK = 8
PASSES = 12
#: A text with at least this score is predicted to be of quality 1.
THRESHOLD = 0.7
#: Bytes of text whose features are held at once.
PART = 1 << 20
#: Bins of each structure statistic.
BINS = 12

_CODE = np.zeros(256, dtype=np.uint8)  # 1 upper, 2 lower or beyond ASCII, 3 digit, 4 full stop etc., 5 other sign, 6 white space
for _c in range(256):
    _CODE[_c] = (1 if 65 <= _c <= 90 else 2 if 97 <= _c <= 122 or _c >= 128 else 3 if 48 <= _c <= 57
                 else 4 if chr(_c) in ".,;:?'\"-()" else 6 if _c in (32, 9, 10, 11, 12, 13) else 5)
STATISTICS = ("upper", "digits", "stops", "signs", "distinct", "top word", "repeats", "word length", "line words", "lone lines", "longest")
DIMENSIONS = BUCKETS + (len(STATISTICS) + 1) * BINS


def _statistics(data: bytes, starts: np.ndarray, ends: np.ndarray, words: np.ndarray) -> list[float]:
    """Each statistic of a text's structure, from 0 to 1."""
    n = len(words)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(_CODE[np.frombuffer(data, dtype=np.uint8)], minlength=7)
    letters, shown = max(1, count[1] + count[2]), max(1, len(data) - count[6])
    _, times = np.unique(words, return_counts=True)
    lines = [x for x in data.split(b"\n") if x.strip()]
    return [
        count[1] / letters, count[3] / shown, min(1.0, 4 * count[4] / shown), min(1.0, 3 * count[5] / shown), len(times) / n, times.max() / n,
        float((words[1:] == words[:-1]).mean()) if n > 1 else 0.0, min(1.0, float((ends - starts).mean()) / 24),
        min(1.0, n / max(1, len(lines)) / 60), 1 - len(set(lines)) / max(1, len(lines)), min(1.0, float((ends - starts).max()) / 80),
    ]


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Feature numbers, values and the owner of each, texts in order."""
    ids, values, owner = [], [], []
    for i, data in enumerate(texts):
        starts, ends = split_words(data)
        words = word_hashes(data, starts, ends)
        hashed = np.unique((words >> np.uint64(40)).astype(np.int64) % BUCKETS)
        stats = np.array([*_statistics(data, starts, ends, words), min(1.0, np.log1p(len(data)) / 12)])
        bins = np.minimum((stats * BINS).astype(np.int64), BINS - 1) + BUCKETS + BINS * np.arange(len(stats))
        ids += [hashed, bins]
        values += [np.full(len(hashed), 1 / np.sqrt(max(1, len(hashed)))), np.ones(len(bins)) * 0.5]
        owner.append(np.full(len(hashed) + len(bins), i))
    if not texts:
        return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
    return np.concatenate(ids), np.concatenate(values), np.concatenate(owner)


class Model:
    """Weights of a factorisation machine and its score."""

    def __init__(self, bias: float, linear: np.ndarray, factors: np.ndarray):
        self.bias, self.linear, self.factors = bias, linear, factors

    def raw(self, ids: np.ndarray, values: np.ndarray, owner: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
        """Each row's score before the logistic function, and its sums of factors."""
        sums = np.empty((rows, self.factors.shape[1]))
        squares = np.zeros(rows)
        for f in range(self.factors.shape[1]):
            part = self.factors[ids, f] * values
            sums[:, f] = np.bincount(owner, part, rows)
            squares += np.bincount(owner, part * part, rows)
        return self.bias + np.bincount(owner, self.linear[ids] * values, rows) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(*features(texts), len(texts))[0], -30, 30)))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], passes: int = PASSES, rank: int = RANK, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Logistic loss, mini-batches and per-weight (Adagrad) steps; without both labels every score is their share."""
    rng = np.random.default_rng(7)
    model = Model(0.0, np.zeros(DIMENSIONS), rng.normal(0, 0.05, (DIMENSIONS, rank)))
    labels = np.array([y for _, _, y in rows], dtype=np.float64)
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.bias = float(np.log(share / (1 - share)))
    if len(set(labels)) < 2:
        return model
    seen = {"linear": np.full(DIMENSIONS, 1e-6), "factors": np.full((DIMENSIONS, rank), 1e-6)}
    weight = np.where(labels > 0, 0.5 / labels.mean(), 0.5 / (1 - labels.mean()))
    for _ in range(passes):
        for batch in np.array_split(rng.permutation(len(rows)), max(1, len(rows) // 64)):
            ids = np.concatenate([rows[i][0] for i in batch])
            values = np.concatenate([rows[i][1] for i in batch])
            owner = np.repeat(np.arange(len(batch)), [len(rows[i][0]) for i in batch])
            raw, sums = model.raw(ids, values, owner, len(batch))
            wrong = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[batch]) * weight[batch] / len(batch)
            model.bias -= rate * wrong.sum()
            used, at = np.unique(ids, return_inverse=True)
            step = np.bincount(at, wrong[owner] * values, len(used)) + decay * model.linear[used]
            seen["linear"][used] += step * step
            slope = np.empty((len(used), rank))
            for f in range(rank):
                slope[:, f] = np.bincount(at, wrong[owner] * values * (sums[owner, f] - model.factors[ids, f] * values), len(used))
            slope += decay * model.factors[used]
            seen["factors"][used] += slope * slope
            model.linear[used] -= rate * step / np.sqrt(seen["linear"][used])
            model.factors[used] -= rate * slope / np.sqrt(seen["factors"][used])
    return model


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids, values, _ = features([batch.column("text")[i].as_py() or b""])
            yield pa.RecordBatch.from_arrays([batch.column("label").slice(i, 1), pa.array([ids.astype(np.int32)], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float64()))],
                                             names=["label", "ids", "values"])


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Fit on at most ``rows`` rows that ``labels(doc_id, quality)`` marks 0 or 1 and that aren't held out.

    They are those of the smallest hash of the id. Ids with contradicting labels aren't used.
    """
    marked = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(
        F.min("quality").alias("label"), F.max("quality").alias("other")).filter("label = other")
    marked = marked.filter(~held_out(F.col("doc_id"), 4)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).select(F.col("doc_id").alias("_id"), F.col("label").cast("int").alias("label"))
    docs = docs.select("doc_id", "text")
    sample = docs.join(F.broadcast(marked), docs["doc_id"] == marked["_id"]).select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    made = sample.mapInArrow(freeing(_featured), "label int, ids array<int>, values array<double>").collect()
    made.sort(key=lambda r: (r["label"], zlib.crc32(str(r["ids"]).encode())))  # the order of tasks doesn't matter
    return fit([(np.array(r["ids"], np.int64), np.array(r["values"]), r["label"]) for r in made])


def _parts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts as bytes, of about ``PART`` bytes together and at most 256 texts, and where each begins."""
    at, part, have = 0, [], 0
    for i, t in enumerate(column):
        text = t.as_py() or b""
        part.append(text.encode() if isinstance(text, str) else text)
        have += len(part[-1])
        if have >= PART or len(part) == 256 or i == len(column) - 1:
            yield at, part
            at, part, have = i + 1, [], 0


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, part in _parts(batch.column("text")):
                rest = [batch.column(i).slice(at, len(part)) for i in range(batch.num_columns) if batch.schema.names[i] != "text"]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(model.score(part))], names=[*[c for c in batch.schema.names if c != "text"], "score"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, held_out, score, predicted.

    The score (0 to 1, higher: quality 1 is likelier) depends on the text alone; null and empty texts get the score of
    a text without words; texts of any length are scored whole; an empty table gives no rows; repeated rows are each scored; other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(freeing(_scored(shared)), f"doc_id {kind}, score double")
    return out.select("doc_id", held_out(F.col("doc_id"), 4).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the classifier doesn't reject: those with a score of at least ``least``; all columns stay.

    Each row is judged by its own text: null and empty texts by the score of a text without words, rows that repeat or share a doc_id
    each for itself, null ids like others; texts of any length are judged whole; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, texts in _parts(batch.column(names.index("text"))):
                yield batch.slice(at, len(texts)).filter(pa.array(model.score(texts) >= least))

    return docs.mapInArrow(freeing(run), docs.schema)



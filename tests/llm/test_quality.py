import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from usagelake.llm import quality
from usagelake.llm.hashing import word_hashes


def texts(n, seed=1):
    rng = random.Random(seed)
    rows, marks = [], []
    for i in range(n):
        words = [rng.choice(["river", "stone", "walks", "under", "bright", "the", "of", "and"]) + rng.choice(["", "", "s", "ly"]) for _ in range(rng.randint(20, 80))]
        good = i % 3 > 0
        body = " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words)
        rows.append((i, body, "xx", "yy"))
        marks.append((i, int(good), 0))
    return rows, marks


def frames(spark, rows, marks):
    return (spark.createDataFrame(rows, "doc_id long, text string, label string, score string"),
            spark.createDataFrame(marks, "doc_id long, quality int, toxic int"))


def test_held_out_accuracy(spark):
    docs, labels = frames(spark, *texts(400))
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 400
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    out = [r for r in got if r.held_out]
    assert len(out) > 50 and sum(r.predicted == int(r.doc_id % 3 > 0) for r in out) >= 0.97 * len(out)


def test_held_out_labels_are_not_learned(spark):
    rows, marks = texts(300)
    flipped = [(d, 1 - q if zlib.crc32(str(d).encode()) % 4 == 2 else q, t) for d, q, t in marks]
    a = quality.train(*frames(spark, rows, marks))
    b = quality.train(*frames(spark, rows, flipped))
    assert np.array_equal(a.linear, b.linear) and np.array_equal(a.factors, b.factors)


def test_interactions_equal_all_pairs():
    rng = np.random.default_rng(0)
    model = quality.Model(0.1, rng.normal(size=quality.DIMENSIONS), rng.normal(size=(quality.DIMENSIONS, 4)))
    ids, values = rng.choice(quality.DIMENSIONS, 9, replace=False), rng.normal(size=9)
    pairs = sum(model.factors[ids[i]] @ model.factors[ids[j]] * values[i] * values[j] for i in range(9) for j in range(i))
    want = model.bias + (model.linear[ids] * values).sum() + pairs
    assert np.isclose(model.raw(ids, values, np.zeros(9, int), 1)[0][0], want)


def test_edge_rows(spark):
    rows, marks = texts(60)
    rows += [(1000, None, None, None), (1001, "", None, None), (None, "null id", None, None), (5, rows[5][1], "a", "b"), (1002, "word " * 20000, None, None)]
    marks += [(None, 1, 0), (2, 1, 0), (2, 0, 0), (7, None, 0), (8, 5, 1)]
    docs, labels = frames(spark, rows, marks)
    got = quality.score(docs, quality.train(docs, labels)).collect()
    assert len(got) == 65 and all(0 <= r.score <= 1 for r in got)
    assert quality.score(docs, quality.train(docs, labels.limit(0))).count() == 65
    assert quality.score(docs.limit(0), quality.train(docs, labels)).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and 0 < kept.count() < 65


def plain_score(model, text):
    """The score of one text from its words, statistics and all pairs of features, one at a time."""
    data = (text or "").encode()
    words = re.findall(rb"[^\x20\x09-\x0D]+", data)
    kind = lambda b: ("upper" if 65 <= b <= 90 else "lower" if 97 <= b <= 122 or b >= 128 else "digit" if 48 <= b <= 57 else "stop" if b in b".,;:?'\"-()"
                      else "space" if b in b" \t\n\x0b\x0c\r" else "sign")
    count = Counter(map(kind, data))
    hashed = set()
    for w in words:
        h = word_hashes(w, np.array([0]), np.array([len(w)]))[0]
        hashed.add(int(h >> np.uint64(40)) % quality.BUCKETS)
    stats = [0.0] * len(quality.STATISTICS)
    if words:
        letters, shown, n = max(1, count["upper"] + count["lower"]), max(1, len(data) - count["space"]), len(words)
        lines = [x for x in data.split(b"\n") if x.strip()]
        times = Counter(words)
        stats = [count["upper"] / letters, count["digit"] / shown, min(1, 4 * count["stop"] / shown), min(1, 3 * count["sign"] / shown), len(times) / n, max(times.values()) / n,
                 sum(a == b for a, b in zip(words, words[1:])) / (n - 1) if n > 1 else 0, min(1, sum(map(len, words)) / n / 24), min(1, n / max(1, len(lines)) / 60),
                 1 - len(set(lines)) / max(1, len(lines)), min(1, max(map(len, words)) / 80)]
    stats.append(min(1, math.log1p(len(data)) / 12))
    x = {h: 1 / math.sqrt(max(1, len(hashed))) for h in hashed}
    for i, s in enumerate(stats):
        x[quality.BUCKETS + quality.BINS * i + min(int(s * quality.BINS), quality.BINS - 1)] = 0.5
    raw = model.bias + sum(model.linear[i] * v for i, v in x.items())
    raw += sum(float(model.factors[i] @ model.factors[j]) * x[i] * x[j] for i, j in itertools.combinations(x, 2))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, raw))))


def test_scores_equal_plain_version(spark, monkeypatch):
    monkeypatch.setattr(quality, "PART", 2_000)
    rows, marks = texts(80)
    rows += [(1000, None, None, None), (1001, "", None, None), (1002, "Eins zwei\nzwei zwei\n\nEins zwei\n" * 30, None, None), (1003, "É 漢字 12,5 %$# " * 9, None, None)]
    docs, labels = frames(spark, rows, marks)
    model = quality.train(docs, labels)
    for r in quality.score(docs, model).collect():
        text = next(t for d, t, *_ in rows if d == r.doc_id)
        assert math.isclose(r.score, plain_score(model, text), rel_tol=1e-9, abs_tol=1e-12), r.doc_id

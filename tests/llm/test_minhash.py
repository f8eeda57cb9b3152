import random
import re
from collections import Counter

import numpy as np

from usagelake.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall(text or "")
    k = min(k, len(w))
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if w else Counter()


def brute(docs, similarity=0.8):
    ids = [d for d, _ in docs if d is not None]
    sets = [shingles(t) for d, t in docs if d is not None]
    root = {d: d for d in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            union = sum((sets[i] | sets[j]).values())
            if (not union) or sum((sets[i] & sets[j]).values()) >= similarity * union:
                a, b = sorted((find(ids[i]), find(ids[j])))
                root[b] = a
    return sorted((d, find(d)) for d in ids)


def corpus():
    rng = random.Random(5)
    text = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    docs = [(i, " ".join(text(rng.choice([1, 3, 4, 5, 9, 50, 300])))) for i in range(40)]
    base = text(200)
    for i in range(60):  # a chain and a crowd of near copies
        v = list(base)
        for _ in range(rng.choice([0, 1, 2, 3])):
            v[rng.randrange(200)] = f"n{rng.randrange(99)}"
        docs.append((100 + i, " ".join(v)))
    walk = text(150)
    for i in range(12):
        walk = list(walk)
        walk[i * 12] = f"step{i}"
        docs.append((300 + i, " ".join(walk)))
    docs += [(400, "same " * 40), (401, "same " * 45), (402, "same " * 60), (403, "same  \n" * 40)]
    docs += [(410, None), (411, ""), (412, " \t"), (413, docs[3][1]), (414, docs[3][1])]
    return docs


def test_classes_equal_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, id int, class_id string")
    got = minhash.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)
    assert all(r.kept == (r.doc_id == r.class_id) for r in got)


def test_edge_rows(spark):
    schema = "doc_id long, text string"
    assert minhash.near_duplicates(spark.createDataFrame([], schema)).count() == 0
    got = minhash.near_duplicates(spark.createDataFrame([(None, "a b"), (None, "a b"), (1, "a b"), (1, "a b")], schema)).collect()
    assert sorted((str(r.doc_id), r.class_id, r.kept) for r in got) == [("1", 1, True)] * 2 + [("None", None, False)] * 2


def test_stage_keeps_one_of_each(spark):
    docs = spark.createDataFrame([(5, "one two three", "a"), (3, "one  two three", "b"), (9, "other", "c"), (None, "x", "d"), (9, "other", "e")],
                                 "doc_id long, text string, source string")
    kept = minhash.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "9", "None"]


def test_signature_is_unbiased():
    rng = np.random.default_rng(0)
    errors = []
    for _ in range(60):
        keys = rng.integers(1, 2**63, 150, dtype=np.uint64)
        a, b = rng.integers(1, 9, 150), rng.integers(1, 9, 150)
        zero = np.zeros(150, int)
        same = (minhash.signatures(keys, a, zero, 1, 125) == minhash.signatures(keys, b, zero, 1, 125)).mean()
        errors.append(same - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.02


def test_stage_keeps_unlike_rows_of_one_id(spark):
    docs = spark.createDataFrame([(1, "one two three"), (9, "one  two three"), (9, "other text"), (9, "third text"), (None, "copy of none"), (None, "copy  of none"),
                                  (None, "one two  three"), (None, "alone"), (7, "again"), (7, "again")], "doc_id long, text string")
    kept = [(r.doc_id, " ".join(r.text.split())) for r in minhash.keep_one_of_each(docs).collect()]
    want = [(1, "one two three"), (9, "other text"), (9, "third text"), (None, "copy of none"), (None, "alone"), (7, "again")]
    assert sorted(map(str, kept)) == sorted(map(str, want))


def test_many_blocks_and_crowds_equal_brute_force(spark, monkeypatch):
    docs = corpus()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    monkeypatch.setattr(minhash, "BLOCK_TEXTS", 5)
    got = minhash.near_duplicates(df).collect()  # groups of up to 32 blocks
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)
    monkeypatch.setattr(minhash, "MOST_BLOCKS", 2)
    got = minhash.near_duplicates(df).collect()  # leaders, then blocks within buckets
    assert sorted((r.doc_id, r.class_id) for r in got) == brute(docs)


def test_joining_links_are_a_spanning_forest_of_all_links():
    rng = np.random.default_rng(3)
    for n, most in ((60, 40), (300, 30_000)):
        base = rng.integers(1, 2**63, 2 * most, dtype=np.uint64)
        sets = [np.unique(np.r_[base[: most // 2 + 1], rng.choice(base, rng.integers(1, most // 8))]) for _ in range(n)]
        for side in (np.zeros(n, int), rng.integers(0, 2, n)):
            want = {}
            for i in range(n):
                for j in range(i):
                    both = len(np.intersect1d(sets[i], sets[j]))
                    if n == 300 and j > 3:
                        break  # the large case is held against a part only
                    want[i, j] = both >= 0.9 * (len(sets[i]) + len(sets[j]) - both) and (side[i] != side[j] or not side.any())
            found = minhash.joining_links(sets, side, 0.9)
            root = list(range(n))

            def find(x, root=root):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in found:
                assert find(a) != find(b)
                root[find(a)] = find(b)
            assert all(find(i) == find(j) for (i, j), linked in want.items() if linked)
            if n == 60:
                assert all(want[max(p), min(p)] for p in found)

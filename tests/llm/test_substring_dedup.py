import hashlib
import random
import re
from collections import Counter

from usagelake.llm import substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window=35):
    split = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in split for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, split, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def run(spark, docs):
    df = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, at string, row int")
    return sorted((tuple(r) for r in substring_dedup.digest(df).collect()), key=str)


def test_equals_brute_force(spark):
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(300)] + ["É", "a b", "x,y"]
    text = lambda n: rng.choices(vocab, k=n)
    shared = [text(n) for n in (34, 35, 36, 50, 120)]
    docs = []
    for i in range(60):
        parts = []
        for _ in range(rng.randint(0, 4)):
            parts += text(rng.randint(0, 60))
            s = rng.choice(shared)
            cut = rng.randint(0, 20)
            parts += s[cut:] if rng.random() < 0.5 else s[: len(s) - cut]
        docs.append((i, rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts)))
    near = text(400)
    for i in range(20):  # copies with one word changed
        v = list(near)
        v[rng.randrange(400)] = f"new{i}"
        docs.append((100 + i, " ".join(v)))
    docs += [(200, None), (201, ""), (202, " \n "), (203, "one " * 3000), (204, "a b " * 17 + "a"), (205, "a b " * 18)]
    docs += [(206, docs[3][1]), (206, docs[3][1]), (None, docs[4][1]), (None, docs[4][1])]
    assert run(spark, docs) == brute(docs)


def test_empty_and_unique(spark):
    assert run(spark, []) == []
    docs = [(i, " ".join(f"{i}-{j}" for j in range(100))) for i in range(5)]
    assert run(spark, docs) == brute(docs)


def test_spans_and_kept(spark):
    block = " ".join(f"b{i}" for i in range(40))
    df = spark.createDataFrame([(1, "start " + block + " end"), (2, block)], "doc_id long, text string")
    rows = {r.doc_id: r for r in substring_dedup.remove_duplicates(df).collect()}
    assert rows[1].kept == "start end" and [tuple(s) for s in rows[1].spans] == [(1, 41)]
    assert rows[2].kept == "" and [tuple(s) for s in rows[2].spans] == [(0, 40)]

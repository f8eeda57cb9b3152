import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from usagelake.llm import periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plant(doc_id, words):
    n, h = len(words), zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


def brute_runs(w):
    """All runs, from every stretch of words equal to those q words on."""
    found = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(12, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def texts():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(200)] + ["é", "a,b"]
    out = []
    for _ in range(60):
        parts = []
        for _ in range(rng.randint(1, 5)):
            unit = rng.choices(vocab if rng.random() < 0.6 else vocab[:2], k=rng.choice([1, 2, 3, 4, 5, 7, 8, 15, 16, 17, 31, 40, 64]))
            parts += rng.choices(vocab, k=rng.randint(0, 30)) + (unit * rng.randint(1, 8))[: rng.randint(1, 250)]
        out.append(rng.choice([" ", "\n", "\t ", "\x0b"]).join(parts))
    out += [" ".join(rng.choices("ab", k=n)) for n in (11, 12, 13, 40, 200, 300)]
    out += [" ".join(["x"] * n) for n in (11, 12, 24, 333)]
    a, b = "a", "b"
    for _ in range(9):
        a, b = a + b, a
    out += [" ".join(a)]  # Fibonacci words: runs inside runs
    t = "a"
    for _ in range(8):
        t += t.translate(str.maketrans("ab", "ba"))
    return out + [" ".join(t), "", "  \n", "one"]


def test_solve_equals_brute_force(monkeypatch):
    """Also with tiles far smaller than the texts, so that runs are stitched from several."""
    for core, span, dense in ((1 << 15, 16, 8), (32, 4, 1), (16, 1, 2), (64, 2, 8)):
        monkeypatch.setattr(periodic_runs, "CORE", core)
        monkeypatch.setattr(periodic_runs, "SPAN", span)
        monkeypatch.setattr(periodic_runs, "DENSE", dense)
        words = [t.encode().split() for t in texts()]
        text, q, s, e = periodic_runs._fragments(words)
        for i, w in enumerate(words):
            at = text == i
            _, qs, ss, es = periodic_runs._joined(np.zeros(int(at.sum()), dtype=int), q[at], s[at], e[at])  if at.any() else ((),) * 4
            found = {}
            for a, b, c in zip(qs, ss, es):
                if c - b >= max(12, 2 * a):
                    found[b, c] = min(int(a), found.get((b, c), 1 << 40))
            assert sorted((int(b), int(c - b), a) for (b, c), a in found.items()) == brute_runs(w), (core, i)


def expected(rows):
    out = []
    for doc_id, text in rows:
        w = plant(doc_id, WORD.findall(text or ""))
        runs = brute_runs(w)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        out.append((doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(brute_collapsed(w, runs))))
    return sorted(out, key=str)


def result(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, words int, fragments string").repartition(3)
    return sorted((tuple(r) for r in periodic_runs.digest(periodic_runs.planted(df)).collect()), key=str)


def test_query_rows(spark):
    rng = random.Random(4)
    rows = [(i, t) for i, t in enumerate(texts())]
    rows += [(1000 + i, " ".join(rng.choices([f"v{j}" for j in range(500)], k=rng.randint(0, 400)))) for i in range(80)]
    rows += [(None, None), (None, "a b " * 20), (3, "a b " * 20), (3, "a b " * 20), (-5, " lead"), (1003, None)]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 5
    assert result(spark, rows) == expected(rows)


@pytest.mark.parametrize("core", [64, 1 << 15])
def test_stitched_over_tiles(spark, core, monkeypatch):
    monkeypatch.setattr(periodic_runs, "CORE", core)
    rows = [(1, " ".join(f"w{i % 70}" for i in range(900))), (2, "x y " * 450), (3, " ".join(f"{i}" for i in range(500)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    # The tasks' own process has the usual tiles; stitching is held against small ones here.
    found = {}
    for i, (_, text) in enumerate(rows):
        t, q, s, e = periodic_runs._fragments([text.encode().split()])
        found[i] = list(zip(q.tolist(), s.tolist(), e.tolist()))
    scan = spark.createDataFrame([(i, f) for i, f in found.items()], "row long, fragments array<struct<q:long,s:long,e:long>>")
    got = {r.of: [tuple(x) for x in r.runs] for r in periodic_runs._stitched(scan).collect()}
    assert got == {i: r for i, (_, text) in enumerate(rows) if (r := brute_runs(text.split()))}
    out = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert [tuple(r) for r in out[1].runs] == [(0, 900, 70)] and out[1].collapsed == " ".join(f"w{i}" for i in range(70))
    assert out[2].collapsed == "x y" and out[3].runs == [] and out[3].collapsed == rows[2][1]


def test_empty_table(spark):
    assert result(spark, []) == []


def test_a_very_long_text(spark):
    unit = [f"w{i}" for i in range(50_000)]
    text = " ".join(unit * 4 + ["tail"] + ["z"] * 100_000)
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in periodic_runs.collapse(df).collect()}
    assert [tuple(r) for r in out[1].runs] == [(0, 200_000, 50_000), (200_001, 100_000, 1)]
    assert out[1].collapsed == " ".join([*unit, "tail", "z"]) and out[2].n_words == 0

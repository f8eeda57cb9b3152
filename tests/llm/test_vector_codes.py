import hashlib
import math
import random

import numpy as np
import pytest

from usagelake.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


def brute(rows, entries=256, rounds=4):
    kept = [(i, l, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, l in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    if not kept:
        return []
    size = -(-max(len(v) for _, _, v in kept) // 4) * 4
    kept = [(i, l, v + [0] * (size - len(v))) for i, l, v in kept]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = size // 4
    cut = lambda v, p: v[p * width : (p + 1) * width]
    books = [[cut(v, p) for _, _, v in kept[:entries]] for p in range(4)]

    def near(part, book):
        return min((sum((a - b) ** 2 for a, b in zip(part, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(4):
            groups = {}
            for _, _, v in kept:
                groups.setdefault(near(cut(v, p), books[p])[1], []).append(cut(v, p))
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    found, by_label = [], {}
    for i, label, v in kept:
        best = [near(cut(v, p), books[p]) for p in range(4)]
        error = sum(d for d, _ in best)
        by_label[label] = by_label.get(label, 0) + error
        found.append((i, "".join(f"{k:02x}" for _, k in best), error, label))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted(((i, c, e, by_label[l], sha) for i, c, e, l in found), key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=str)


def vectors(n, size, seed, near=0.0):
    rng = np.random.default_rng(seed)
    return (rng.normal(size=(n, size)) * 0.2).round(2 if near else 6).astype(np.float32).tolist()


def test_equals_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, v, rng.choice([None, 1, 2, 3])) for i, v in enumerate(vectors(330, 16, 1))]
    rows += [(400 + i, rows[5][1], 1) for i in range(200)]  # a hot vector
    rows += [(700 + i, [0.25] * 4 + v[4:], None) for i, v in enumerate(vectors(50, 16, 3, near=1))]  # a common first part
    rows += [(None, rows[7][1], 2), (5, rows[5][1], 2), (5, rows[5][1], 2), (6, rows[9][1], None)]
    rows += [(800, None, 1), (801, [None] * 16, 1), (802, [float("nan")] * 16, 1), (803, [float("inf")] + [0.0] * 15, 1), (-3, [float("-inf")] * 16, 2)]
    assert run(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None, None)],
    [(1, [], 1), (2, [], None)],
    [(i, v, 1) for i, v in enumerate(vectors(9, 8, 4))],
    [(1, [0.5, -0.5, 0.1], 1), (2, [0.25] * 7, 1), (3, [], 2), (4, [-0.0001] * 8, None)],
])
def test_small_tables(spark, rows):
    assert run(spark, rows) == brute(rows)


def test_the_walk_equals_all_distances(monkeypatch):
    rng = np.random.default_rng(5)
    parts = rng.integers(-3, 4, size=(3000, 6))
    parts = parts[np.lexsort(parts.T[::-1])]
    entries = rng.integers(-4, 5, size=(20, 6))
    every = ((parts[:, None] - entries[None]) ** 2).sum(axis=2)
    for cells in (1, 20, 700, 1 << 20):  # from one leaf to all leaves at a time
        monkeypatch.setattr(vector_codes, "CELLS", cells)
        found, error = vector_codes.nearest(parts, entries)
        assert (found == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()


def test_huge_components_have_a_bound(spark):
    rows = [(1, [1e30, -1e30, 3e38, 0.0], 1), (2, [0.0] * 4, 1)]
    got = run(spark, rows)
    assert [r[:3] for r in got] == [(1, "00000000", 0), (2, "01010100", 0)]


def test_decode(spark):
    df = spark.createDataFrame([(i, v, 1, 0, "") for i, v in enumerate(vectors(300, 8, 6))], SCHEMA)
    books = vector_codes.train(df)
    codes = vector_codes.encode(df, books)
    back = vector_codes.decode(codes, books).join(codes, "vec_id").join(vector_codes.integers(df).select("vec_id", "v"), "vec_id")
    for r in back.collect():
        assert sum((a - round(b * 1024)) ** 2 for a, b in zip(r.v, r.embedding)) == r.error
    odd = spark.createDataFrame([(1, None), (2, "zz"), (3, "")], "vec_id long, code string")
    assert [r.embedding for r in vector_codes.decode(odd, books).collect()] == [None] * 3

import numpy as np

from usagelake.llm import embedding_dedup


def brute(rows, least=0.9):
    good = [(i, np.array(v, float) / np.abs(np.array(v, float)).max()) for i, v in rows if i is not None and v is not None and len(v) and all(x is not None for x in v) and np.isfinite(np.array(v, float)).all() and any(v)]
    links, root = {i: set() for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, x) in enumerate(good):
        for j, y in good[:n]:
            if len(x) == len(y) and (x @ y) / np.sqrt((x @ x) * (y @ y)) >= least:
                links[i].add(j)
                links[j].add(i)
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(links[i]), find(i), find(i) == i) for i in links}


def rows():
    rng = np.random.default_rng(3)
    out = [rng.normal(size=16) for _ in range(300)]
    for center in rng.normal(size=(12, 16)):
        out += [center + rng.normal(size=16) * 0.25 for _ in range(12)]
    out += [out[5]] * 30 + [out[6] * 3]
    out = [(i, [float(x) for x in v]) for i, v in enumerate(out)]
    bad = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0] * 8, [2.0] * 8, [1e-200] * 16, [1e300] * 16]
    return out + [(1000 + i, v) for i, v in enumerate(bad)]


def run(spark, data, **options):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in data], "vec_id long, embedding array<double>, label int, id string")
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df, **options).collect()}


def test_one_leaf_equals_brute_force(spark):
    assert run(spark, rows()) == brute(rows())


def test_forest_recall(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 40)
    want, got = brute(rows()), run(spark, rows(), leaf=40)
    assert set(want) == set(got) and all(got[i][0] <= want[i][0] for i in want)
    assert sum(v[0] for v in got.values()) >= 0.95 * sum(v[0] for v in want.values())


def test_forest_recall_at_depth():
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    forest = embedding_dedup.Forest(unit(rng.normal(size=(20_000, 64))), 52_000_000)
    assert forest.depth == 17
    x = unit(rng.normal(size=(1_000, 64)))
    side = rng.normal(size=x.shape)
    y = 0.9 * x + np.sqrt(1 - 0.81) * unit(side - (side * x).sum(axis=1, keepdims=True) * x)
    found = set()
    for (_, i, a), (_, j, b) in zip(forest.leaves(x), forest.leaves(y), strict=True):
        found |= {k for k, _ in set(zip(i.tolist(), a.tolist(), strict=True)) & set(zip(j.tolist(), b.tolist(), strict=True))}
    assert len(found) >= 998


def test_links_next_to_the_bound(spark):
    angle = np.arccos(0.9) + np.linspace(-1e-3, 1e-3, 101)
    data = [(0, [1.0] + [0.0] * 63)] + [(i + 1, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62) for i, a in enumerate(angle)]
    assert run(spark, data) == brute(data)


def test_edge_rows(spark):
    assert run(spark, []) == {}
    df = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0])], "vec_id long, embedding array<double>")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.link(df).collect())
    assert got == [("4", 1, 4, True), ("4", 1, 4, True), ("None", 0, None, False)]

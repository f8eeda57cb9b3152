import hashlib
import re

from usagelake.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(low)


def brute(docs, items, window=10):
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            iw = words(item)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit |= set(range(p, p + n))
                        ids.add(str(item_id))
        digest = hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()
        out.append((doc_id, len(w), len(hit), len(ids), digest, bool(hit)))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id long, text string, pairs string")
    b = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, w string")
    return sorted((tuple(r) for r in decontaminate.digest(d, b).collect()), key=str)


def test_equals_brute_force(spark):
    import random

    rng = random.Random(1)
    vocab = [f"w{i}" for i in range(12)] + ["É", "é", "a1"]
    items = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 2, 4, 7, 9, 10, 11, 25])))) for i in range(12)]
    items += [(20, None), (21, ""), (22, "..."), (23, items[3][1])]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 9, 10, 30, 200])))) for i in range(30)]
    long_items = [t for _, t in items if t and len(t.split()) > 9]
    docs += [(100 + i, "X, " + t.upper() + "! " + long_items[0]) for i, t in enumerate(long_items)]
    docs += [(200, None), (201, ""), (202, "the " * 400), (202, "same id"), (202, "the " * 400)]
    assert run(spark, docs, items) == brute(docs, items)


def test_only_long_items_and_repeats(spark):
    item = " ".join(f"q{i}" for i in range(30))
    docs = [(1, item), (2, " ".join(item.split()[3:13])), (3, " ".join(item.split()[3:12])), (4, "pre " + item + " mid " + item)]
    docs.append((5, "x " * 5000 + " ".join(item.split()[5:16])))
    assert run(spark, docs, [(7, item)]) == brute(docs, [(7, item)])


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a b c")]) == []
    assert run(spark, [(1, "a b c")], []) == brute([(1, "a b c")], [])


def test_stage_keeps_clean_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k", "en"), (2, "nothing here", "en"), (None, "null id", "fr")],
                                 "doc_id long, text string, lang string")
    items = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.text for r in kept.collect()) == ["nothing here", "null id"]


def test_stage_judges_rows_of_one_id_apart(spark):
    bad = "a b c d e f g h i j k"
    docs = spark.createDataFrame([(None, bad), (None, "clean without id"), (None, None), (1, bad), (1, "clean of one"), (2, bad), (2, bad), (3, "clean"), (3, "clean")],
                                 "doc_id long, text string")
    items = spark.createDataFrame([(1, "A b c d e f g h i j")], "item_id long, text string")
    kept = decontaminate.remove_contaminated(docs, items).collect()
    assert sorted(map(str, (tuple(r) for r in kept))) == sorted(map(str, [(None, "clean without id"), (None, None), (1, "clean of one"), (3, "clean"), (3, "clean")]))


def test_a_gram_of_all_items_and_documents(spark):
    """A common run of five words multiplies nothing: each document's windows meet distinct windows, however many items have the run."""
    common = "all items have these five".split()
    items = [(i, " ".join([f"a{i}", f"b{i}", *common, *(f"{c}{i}" for c in "defghij")])) for i in range(300)]
    items += [(300 + i, " ".join([*common, "and", "one", "more", "window", "too"])) for i in range(50)]  # one window of 50 items
    docs = [(i, " ".join([f"x{i}", *common, f"y{i}", "z"] * 3)) for i in range(200)] + [(900, items[7][1]), (901, "so " + items[310][1])]
    got = {r[0]: r[2:4] for r in run(spark, docs, items)}
    assert all(got[i] == (0, 0) for i in range(200)) and got[900] == (14, 1) and got[901] == (10, 50)

import numpy as np

from usagelake.llm import minhash, substring_dedup
from usagelake.llm.hashing import Runs, run_hashes, split_words, word_hashes


def thue_morse(n, letters="ab"):
    t = letters[0]
    while len(t) < n:
        t += t.translate(str.maketrans(letters[0] + letters[1], letters[1] + letters[0]))
    return t


A = thue_morse(1024)
B = A.translate(str.maketrans("ab", "ba"))


def hashes(text, seed=0):
    data = text.encode()
    return word_hashes(data, *split_words(data), seed=seed)


def test_words_that_clash_in_any_polynomial():
    for seed in (0, 1):
        a, b = hashes(f"{A} {B}", seed)
        assert a != b
    # The same with words in place of letters.
    x, y = (hashes(" ".join("one" if c == "a" else "two" for c in t)) for t in (A, B))
    whole = np.zeros(1, np.int64), np.full(1, 1024)
    assert run_hashes(x, *whole)[0] != run_hashes(y, *whole)[0]


def test_equal_runs_have_equal_hashes_and_others_do_not():
    words = hashes(" ".join("abcab"[i % 5] + "xyz"[i % 3] for i in range(300)))
    runs = Runs(words)
    for n in (1, 2, 3, 5, 18, 35, 52, 128):
        starts = np.arange(300 - n + 1)
        h = runs.hashes(starts, starts + n)
        sequences = [words[s : s + n].tobytes() for s in starts]
        assert len(set(h.tolist())) == len(set(sequences))
        assert all(h[i] == h[sequences.index(s)] for i, s in enumerate(sequences))
    assert len(runs.hashes(np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def test_no_clash_among_many_words():
    text = " ".join(f"{i:x}" for i in range(200_000))
    assert len(set(hashes(text).tolist())) == len(set(hashes(text, 1).tolist())) == 200_000
    assert not set(hashes(text).tolist()) & set(hashes(text, 1).tolist())


def test_operators_keep_such_texts_apart(spark):
    one = " ".join([A] + [f"p{i}" for i in range(40)])
    two = " ".join([B] + [f"q{i}" for i in range(40)])
    rows = [(1, " ".join([A] * 41)), (2, " ".join([B] * 41)), (3, one), (4, two)]
    df = spark.createDataFrame([(3, " ".join(A if c == "a" else B for c in A[:41])), (4, " ".join(B if c == "a" else A for c in A[:41]))], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in substring_dedup.digest(df).collect()} == {3: 0, 4: 0}
    classes = {r.doc_id: r.class_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert classes == {1: 1, 2: 2, 3: 3, 4: 4}
    copies = [(5, one), (6, one.replace(" ", "\n"))]
    classes = {r.doc_id: (r.text_id, r.class_id) for r in minhash.near_duplicates(spark.createDataFrame(copies, "doc_id long, text string")).collect()}
    assert classes == {5: (5, 5), 6: (5, 5)}

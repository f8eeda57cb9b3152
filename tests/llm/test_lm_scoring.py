import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from usagelake.llm import lm_scoring
from usagelake.llm.lm_scoring import Lattice

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def all_segmentations(word, table):
    """Sum of the products over every segmentation, by plain recursion."""
    if not word:
        return 1.0
    return sum(p * all_segmentations(word[len(x) :], table) for x, p in table.items() if word.startswith(x))


def test_recursion_equals_all_segmentations():
    rng = np.random.default_rng(1)
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba", b" ab", b"\xc3", b"\xa9", b"\xc3\xa9"]
    p = rng.dirichlet(np.ones(len(pieces)))
    lattice, table = Lattice(pieces, np.log(p)), dict(zip(pieces, p, strict=True))
    tested = [b"a", b"ab", b"abab", b"baab", "éa".encode(), b"", b"ababababab", b"aba"]
    assert np.allclose(lattice.log_probabilities(tested), [math.log(all_segmentations(b" " + w, table)) for w in tested])
    counts = rng.integers(1, 5, len(tested)).astype(float)
    step = 1e-6
    for i in (3, 6, 10):  # expected uses are the slope of the weighted log probability
        up, down = np.log(p), np.log(p)
        up[i] += step
        down[i] -= step
        slope = (Lattice(pieces, up).log_probabilities(tested) - Lattice(pieces, down).log_probabilities(tested)) @ counts / (2 * step)
        assert np.isclose(lattice.expected_uses(tested, counts)[i], slope, atol=1e-5)


def corpus():
    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["the", "of", "Éa", "shine", "und", "x,y", "river***"], k=rng.randint(1, 80)))) for i in range(150)]
    return docs + [(500, None), (501, ""), (None, "the null id"), (7, docs[7][1]), (502, "w" * 5000), (503, "UPPER upper\n\tthe\x0bthe")]


@pytest.fixture(scope="module")
def scored(spark):
    df = spark.createDataFrame([(*d, "x") for d in corpus()], "doc_id long, text string, word string")
    return lm_scoring.score(df).collect()


def test_base_equals_brute_force(scored):
    docs = corpus()
    out = lambda d: d is not None and zlib.crc32(str(d).encode()) % 7 == 2
    count = Counter(w for d, t in docs if not out(d) for w in [*words(t), None])
    n, v = sum(count.values()), len(count)
    want = Counter((d, out(d), len(words(t)) + 1, sum(count[w] > 0 for w in [*words(t), None]), n,
                    round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in [*words(t), None]), 6)) for d, t in docs)
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in scored)
    assert got == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in scored)


def test_rare_words_by_join_give_the_same(spark, scored, monkeypatch):
    monkeypatch.setattr(lm_scoring, "HOT", 3)
    df = spark.createDataFrame(corpus(), "doc_id long, text string")
    again = lm_scoring.score(df).collect()
    key = lambda r: (str(r.doc_id), r.n_tokens, r.n_known, round(r.base_score, 6), round(r.score, 4))
    assert sorted(map(key, again)) == sorted(map(key, scored))


def test_probabilities_sum_to_one_over_short_texts():
    lattice = lm_scoring.starting_lattice()
    assert np.isclose(np.exp(lattice.weights).sum(), 1)


def test_empty_table(spark):
    assert lm_scoring.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0

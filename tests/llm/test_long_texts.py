"""Texts and words of a megabyte through every operator on texts, and through the stages."""

import random

import pytest

from usagelake.llm import decontaminate, lm_scoring, minhash, quality, secret_scan, substring_dedup

rng = random.Random(3)
WORDS = [f"{rng.choice(['river', 'stone', 'walks', 'the', 'of'])}{rng.randrange(9000)}" for _ in range(120_000)]
LONG = " ".join(WORDS)
SOLID = "x" * 1_000_000


@pytest.fixture(scope="module")
def docs(spark):
    changed = list(WORDS)
    changed[60_000] = "new"
    rows = [(1, LONG), (2, " ".join(changed)), (3, SOLID), (4, SOLID + "y"), (5, "short"), (6, None), (7, "")]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_decontamination(spark, docs):
    items = spark.createDataFrame([(1, " ".join(WORDS[100_000:100_020])), (2, SOLID)], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.digest(docs, items).collect()}
    assert got == {1: (120_000, 20, 1), 2: (120_000, 20, 1), 3: (1, 1, 1), 4: (1, 0, 0), 5: (1, 0, 0), 6: (0, 0, 0), 7: (0, 0, 0)}
    assert {r.doc_id for r in decontaminate.remove_contaminated(docs, items).collect()} == {4, 5, 6, 7}


def test_substrings(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.digest(docs).collect()}
    assert got == {1: (120_000, 119_999), 2: (120_000, 119_999), 3: (1, 0), 4: (1, 0), 5: (1, 0), 6: (0, 0), 7: (0, 0)}


def test_near_duplicates(docs):
    assert {r.doc_id: r.class_id for r in minhash.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6}
    kept = minhash.keep_one_of_each(docs).collect()
    assert {r.doc_id for r in kept} == {1, 3, 4, 5, 6} and {len(r.text or "") for r in kept} == {len(LONG), 1_000_000, 1_000_001, 5, 0}


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    got = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert len(got) == 7 and all(0 <= x <= 1 for x in got.values()) and got[6] == got[7]
    assert quality.keep_good(docs, labels, 0.0).count() == 7


def test_secrets(spark):
    token = "".join(rng.choices(secret_scan.ALPHABETS["base64"], k=40))
    text = LONG + f' token = "{token}" ' + "0123456789abcdef" * 60_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    row = secret_scan.digest(df).first()
    assert (row.n_assign, row.n_access, row.n_hex) == (1, 0, 1)
    assert token not in secret_scan.redact(df).first().text


def test_scores(spark, docs):
    got = {r.doc_id: r for r in lm_scoring.score(docs.filter("doc_id in (1, 5, 6)").unionByName(spark.createDataFrame([(8, "z" * 200_000)], "doc_id long, text string"))).collect()}
    assert got[1].n_tokens == 120_001 and got[8].n_tokens == 2 and got[1].score < got[5].score < 0

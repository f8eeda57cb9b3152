"""The chain of stages on a small fixture, against plain versions of each stage's rule."""

import os
import random

import corpus_pipeline
import pytest
from usagelake.llm import sentencepiece

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    base = str(tmp_path_factory.mktemp("sf"))
    text = lambda n: " ".join(rng.choice(["river", "stone", "walks", "under", "the", "of", "and", "light"]) + rng.choice(["", "s", "ly", "er"]) for _ in range(n)) + "."
    docs, labels = [], []
    for i in range(120):
        good = i % 3 > 0
        body = text(60)
        docs.append((i, body if good else " ".join(w.upper() + "!!" for w in body.split())))
        labels.append((i, int(good), 0))
    item = text(20)
    docs += [(200, docs[1][1]), (201, docs[1][1].replace(".", " end.")), (202, text(30) + " " + item + " " + text(30)), (203, text(40) + ' token = "0123456789abcdef0123" ' + text(10))]
    docs = [(d, t, "en", "s", len(t)) for d, t in docs]
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{base}/benchmark.parquet")
    return base


def test_chain(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, [sorted(r.doc_id for r in docs.collect())]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = os.path.join(folder, name)
        stage(spark, docs, folder).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == columns, name
        seen.append(sorted(r.doc_id for r in docs.collect()))
    good = [i for i in range(120) if i % 3 > 0]
    assert seen[1] == [*good, 200, 201, 202, 203]
    assert seen[2] == [*good, 202, 203]
    assert seen[3] == seen[4] == [*good, 203]
    last = {r.doc_id: r for r in docs.collect()}
    assert "[SECRET]" in last[203].text and "0123456789abcdef" not in last[203].text and last[203].n_chars == len(last[203].text)
    encoded = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r.doc_id: r.decoded for r in sentencepiece.decode(encoded).collect()} == {k: r.text for k, r in last.items()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "encode"]


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder).count() == 81

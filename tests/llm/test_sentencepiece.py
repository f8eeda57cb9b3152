import hashlib
import random
import sys

import pyarrow as pa
import pytest
import sentencepiece as library

from usagelake.llm import sentencepiece


@pytest.fixture(scope="module")
def vocabulary():
    with open(sentencepiece.MODEL, "rb") as file:
        return sentencepiece.Vocabulary(file.read())


def brute(v, text):
    """Viterbi over the whole text, without units."""
    if not text:
        return []
    s = "▁" + text.replace(" ", "▁")
    table = {v.pieces[i]: (v.scores[i], i) for i in v.plain}
    best = [(0.0, 0, 0)]
    for end in range(1, len(s) + 1):
        paths = [(best[end - 1][0] - 1e9, 1, -end)]
        for at in range(max(0, end - v.longest), end):
            if s[at:end] in table:
                score, i = table[s[at:end]]
                paths.append((best[at][0] + score, end - at, i))
        best.append(max(paths))
    out, end = [], len(s)
    while end:
        _, n, i = best[end]
        out.append([i] if i >= 0 else [int(v.bytes[b]) for b in s[end - 1].encode()])
        end -= n
    return [i for part in out[::-1] for i in part]


TEXTS = ["Hello world", "  two  spaces ", "line\nbreak\ttab\r\n", "é ñ ß 😀 漢字 ֍", "the " * 500, "x" * 3000, "<unk> <s> </s> <0x41>", "", None,
         "!!??***", "onthsh_thereof.and,or", "İ ǅ  nbsp ﻿"]


def test_equals_brute_force_and_round_trips(spark, vocabulary):
    rng = random.Random(4)
    texts = TEXTS + ["".join(rng.choices("aetho nsr\n.,ÉéЖ中😀", k=rng.randint(1, 200))) for _ in range(60)]
    docs = [(i, t, "x") for i, t in enumerate(texts)] + [(None, "null id", "x"), (3, TEXTS[3], "x")]
    got = sentencepiece.digest(spark.createDataFrame(docs, "doc_id long, text string, ids string").repartition(3)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(d[0]) for d in docs)
    text_of = {d[0]: d[1] for d in docs}
    for r in got:
        text = text_of[r.doc_id]
        assert r.ids == brute(vocabulary, text) and r.n_pieces == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_decodes_like_the_library(spark):
    reader = library.SentencePieceProcessor(model_file=sentencepiece.MODEL)
    texts = [t for t in TEXTS if t]
    ids = [reader.encode(t) for t in texts]
    df = spark.createDataFrame(list(zip(range(len(ids)), ids, strict=True)), "n int, ids array<int>")
    assert {r.n: r.decoded for r in sentencepiece.decode(df).collect()} == dict(enumerate(texts))


def test_many_portions_and_empty_table(spark, monkeypatch, vocabulary):
    docs = spark.createDataFrame([(i, f"word{i % 7} and x{i}") for i in range(300)], "doc_id long, text string")
    monkeypatch.setattr(sentencepiece, "PORTION", 100)
    docs = docs.repartition(7)
    assert sentencepiece.encode(docs).count() == 300
    assert sentencepiece.encode(docs.limit(0)).count() == 0
    assert sentencepiece.decode(spark.createDataFrame([(None,)], "ids array<int>")).first().decoded is None


def test_very_long_units(spark, vocabulary):
    texts = ["a" * 100_000, "=" * 30_000 + "漢" + "=" * 30_000, " " * 70_000, "ab" * 700 + "😀" + "ab" * 700]
    got = {r.doc_id: r.decoded for r in sentencepiece.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), decoded=True).collect()}
    assert got == dict(enumerate(texts))
    one = sentencepiece.encode(spark.createDataFrame([(1, texts[3])], "doc_id long, text string")).first()
    assert one.ids == brute(vocabulary, texts[3])


def test_pieces_left_out_are_beaten(vocabulary):
    score = {vocabulary.pieces[i]: vocabulary.scores[i] for i in vocabulary.plain}
    useful = set(vocabulary.useful)
    assert all(i in useful for i in vocabulary.plain if len(vocabulary.pieces[i]) == 1)
    def best(p):  # over sequences of shorter pieces
        reached = [0.0] + [None] * len(p)
        for end in range(1, len(p) + 1):
            paths = [reached[at] + score[p[at:end]] for at in range(end) if end - at < len(p) and reached[at] is not None and p[at:end] in score]
            reached[end] = max(paths, default=None)
        return reached[-1]

    for i in vocabulary.plain:
        split = best(vocabulary.pieces[i])
        assert (i in useful) == (split is None or split <= vocabulary.scores[i])


def test_units_are_cut_alike_in_steps_of_any_size(vocabulary, monkeypatch):
    rng = random.Random(7)
    texts = TEXTS + [" a  ▁b▁ ▁", "a" * 900] + ["".join(rng.choices("aetho nsr\n.,ÉéЖ中😀▁", k=rng.randint(0, 300))) for _ in range(100)]

    def cut(text):
        s, out = " " + text, []
        for i, c in enumerate(s):
            near = [vocabulary.known[ord(x.replace(" ", "▁"))] for x in s[max(i - 1, 0) : i + 1]]
            if not i or (c == " " and s[i - 1] != " ") or not vocabulary.together[near[0], near[1]]:
                out.append("")
            out[-1] += c.replace(" ", "▁")
        return out

    want = [cut(t) if t else [] for t in texts]
    for step in (1, 7, 1 << 18):
        monkeypatch.setattr(sentencepiece, "STEP", step)
        units, n = vocabulary.units(texts)
        assert n.tolist() == [len(w) for w in want] and units.to_pylist() == [u for w in want for u in w]


def test_words_are_not_looked_up_one_by_one(vocabulary, monkeypatch):
    """Calls of Python do not grow with the number of distinct words."""
    monkeypatch.setattr(sentencepiece, "_read", lambda name: vocabulary)

    def calls(words):
        made = []
        texts = [" ".join(f"the{i * words + k}" for k in range(words)) for i in range(10)]
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(10)), "text": texts})
        sys.setprofile(lambda frame, event, what: made.append(event))
        try:
            rows = sum(b.num_rows for b in sentencepiece._portions("")(iter([batch])))
        finally:
            sys.setprofile(None)
        assert rows > 10
        return len(made)

    assert calls(5000) < calls(100) + 3000

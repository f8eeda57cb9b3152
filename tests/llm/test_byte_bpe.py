import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from usagelake.llm import byte_bpe
from usagelake.llm.byte_bpe import Vocabulary, encode_texts, merge_long, merge_rows

DATA = open(byte_bpe.rank_file(), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, DATA.splitlines())}
LIBRARY = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzäßéñ"
    word = lambda: "".join(rng.choices(letters, k=rng.randint(1, 14)))
    out = [" ".join(word() for _ in range(rng.randint(1, 60))) for _ in range(80)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x7F), rng.randint(0x80, 0x2FFF), rng.randint(0x1F300, 0x1F6FF)])) for _ in range(300)) for _ in range(40)]
    out += ["", " ", "\n\n  \n x", "  a  b\t\t\nc   ", "don't we'll I'VE 'sx", "<|endoftext|>", "\x00\x1c\x1d\x85\xa0x", "日本語のテキスト。", "1234567 12 3½"]
    out += ["a" * n for n in (127, 128, 129, 130, 257, 5000)] + ["ab" * 300, "=" * 700, " " * 900, "xyz" * 99 + "x"]
    out += ["".join(rng.choices(letters, k=n)) for n in (128, 129, 400, 4000)]
    return out


def test_equals_the_library():
    vocabulary = Vocabulary(DATA)
    all_texts = texts()
    flat, at = encode_texts(all_texts, vocabulary, regex.compile(public_tokenizers.PATTERN))
    for i, text in enumerate(all_texts):
        ids = flat[at[i] : at[i + 1]].tolist()
        assert ids == LIBRARY.encode_ordinary(text), text[:50]
        assert byte_bpe.decode_ids(ids, vocabulary) == text.encode()


def plain(row, vocabulary):
    """One merge at a time."""
    row = list(row)
    while len(row) > 1:
        ranks = [vocabulary.ids.get(vocabulary.tokens[a] + vocabulary.tokens[b], 1 << 40) for a, b in zip(row, row[1:])]
        low = min(ranks)
        if low == 1 << 40:
            break
        i = ranks.index(low)
        row[i : i + 2] = [low]
    return row


@pytest.mark.parametrize("seed", range(4))
def test_merges_of_odd_rank_files(seed):
    """Ranks in random order: a merge can then make a pair of a smaller rank, which batches of merges mustn't overtake."""
    rng = random.Random(seed)
    tokens = {bytes([i]) for i in range(256)}
    while len(tokens) < 256 + 60:
        tokens.add(bytes(rng.choices(b"ab", k=rng.randint(2, 6))))
    tokens = sorted(tokens)
    rng.shuffle(tokens)
    vocabulary = Vocabulary(b"\n".join(base64.b64encode(t) + b" %d" % i for i, t in enumerate(tokens)))
    for n in [*range(1, 12), 40, 200, 300]:
        rows = np.array([[vocabulary.ids[bytes([rng.choice(b"ab")])] for _ in range(n)] for _ in range(20)], dtype=np.uint32)
        padded = np.concatenate([rows, np.full((20, 3), byte_bpe.NONE)], axis=1)
        merged = merge_rows(padded, vocabulary)
        for row, got in zip(rows, merged):
            want = plain(row.tolist(), vocabulary)
            assert got[got != byte_bpe.NONE].tolist() == want == merge_long(row, vocabulary).tolist()


def test_query_rows(spark):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, None), (3, None), (3, "twice"), (3, "twice")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, ids string, n_tokens int").repartition(3)
    got = sorted((tuple(r) for r in byte_bpe.digest(df).collect()), key=str)
    want = []
    for doc_id, text in rows:
        ids = LIBRARY.encode_ordinary(text or "")
        want.append((doc_id, len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)


def test_round_trip_and_foreign_ids(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts())] + [(None, None)], "doc_id long, text string")
    back = byte_bpe.decode(byte_bpe.encode(df)).collect()
    assert {(r.doc_id, bytes(r.data)) for r in back} == {(i, t.encode()) for i, t in enumerate(texts())} | {(None, b"")}
    odd = spark.createDataFrame([(1, [-1, None, 99999999, RANKS[b"a"]]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: bytes(r.data) for r in byte_bpe.decode(odd).collect()} == {1: b"a", 2: b"", 3: b""}


def test_empty_table_and_a_very_long_text(spark):
    assert byte_bpe.digest(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh", k=30_000)) + " " + "z" * 1_000_000 + " tail"
    row = byte_bpe.digest(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert row.decoded_sha256 == hashlib.sha256(long.encode()).hexdigest()
    vocabulary = Vocabulary(DATA)
    flat, _ = encode_texts([long], vocabulary, regex.compile(public_tokenizers.PATTERN))
    assert row.n_tokens == len(flat) and flat.tolist() == LIBRARY.encode_ordinary(long)


def test_a_rank_file_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        Vocabulary(base64.b64encode(b"a") + b" 0")

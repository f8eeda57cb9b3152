import hashlib
import random
import re
import time

from usagelake.llm import secret_scan

RULES = [
    ("assign", re.compile(secret_scan.ASSIGN), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    found = [(m.start(), k, m.end(), kind) for k, (kind, rule, good) in enumerate(RULES) for m in rule.finditer(text or "") if good(m)]
    return [f"{kind}:{a}:{b}" for a, _, b, kind in sorted(found)]


def corpus():
    rng = random.Random(2)
    hexa = lambda n: "".join(rng.choices("0123456789abcdef", k=n))
    b64 = lambda n: "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", k=n))
    texts = [
        f'é😀 token = "{hexa(40)}" and token="{hexa(12)}"', f"PASSWORD: short, password: secret = {b64(20)}", f"Api_Key='{b64(30)}'apikey:{b64(9)}",
        f"AKIA{'A1' * 8} AKIA12 AKIAAKIA{'Z' * 10}x", hexa(31) + " " + hexa(32) + "g" + hexa(64), f"passwd=={b64(10)}== secret\n=\n{b64(20)}",
        None, "", "token token token =", "ütoken=abcdefgh", "Token : abc.def_ghi-jkl=/+", f"{hexa(33)}", "token = " * 2000 + hexa(40),
    ]
    texts += [f"see {b64(rng.randint(24, 60))} here" for _ in range(150)]
    texts += [f"file {'ab1-' * rng.randint(6, 12)}end{i} and /usr/local/share/lib{i}/python3/site-packages/aaaa" for i in range(150)]
    return list(enumerate(texts))


def rows(spark, docs):
    df = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, spans string")
    return {r.doc_id: r for r in secret_scan.digest(df).collect()}


def test_base_rules_equal_brute_force(spark):
    docs = corpus()
    got = rows(spark, docs)
    assert len(got) == len(docs)
    for doc_id, text in docs:
        want, r = base(text), got[doc_id]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (text, r.spans, want)
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")]
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == want


def test_battery_finds_random_tokens_only(spark):
    docs = corpus()
    got = rows(spark, docs)
    random_ones = [got[i].spans for i in range(13, 163)]
    paths = [got[i].spans for i in range(163, 313)]
    assert sum("random" in s for s in random_ones) > 80
    assert sum("random" in s for s in paths) < 10


def test_copies_of_a_token_move_no_threshold(spark):
    rng = random.Random(6)
    signs, parts = secret_scan.ALPHABETS["base64"], ["Usr", "local", "share", "lib12", "python3", "Site", "pack", "Main", "v2", "test"]
    drawn = lambda: "".join(rng.choices(signs, k=40))
    tokens = [t for t in (drawn() for _ in range(1500)) if re.search("[0-9].*[0-9]", t)][:1000]
    plain = ["/".join(["Lib1"] + rng.choices(parts, k=12))[:40] for _ in range(1000)]
    tests = secret_scan.token_tests(spark.createDataFrame([(drawn(),) for _ in range(400)], "s string")).collect()
    texts = [f"see {t} here" for t in tokens + plain]
    alone = rows(spark, list(enumerate(texts)))
    want = [alone[i].spans for i in range(len(texts))]
    assert sum("random" in s for s in want[: len(tokens)]) >= 0.95 * len(tokens)
    assert sum("random" in s for s in want[len(tokens) :]) <= 50
    for p in (0.3, 0.6):
        near = min((r for r in tests if r.encoding == "base64"), key=lambda r: abs(r.p - p))
        got = rows(spark, list(enumerate(texts + [f"{near.s} " * 100] * 20)))
        assert sum(got[i].spans != s for i, s in enumerate(want)) <= 10, p


def test_random_tokens_without_two_digits_are_tested(spark):
    rng = random.Random(9)
    signs = secret_scan.ALPHABETS["base64"]
    drawn = ["".join(rng.choices(signs, k=24)) for _ in range(1500)]
    plain = ["/".join(rng.choices(["Usr", "local", "share", "Library", "python", "Site", "packages", "Main"], k=8))[:24] for _ in range(300)]
    got = rows(spark, list(enumerate(f"see {t} here" for t in drawn + plain)))
    few = [i for i, t in enumerate(drawn) if not re.search("[0-9].*[0-9]", t)]
    many = [i for i in range(len(drawn)) if i not in set(few)]
    share = lambda which: sum("random" in got[i].spans for i in which) / len(which)
    assert len(few) > 80 and share(few) > 0.75 and abs(share(few) - share(many)) < 0.15
    wrong = sum("random" in got[i].spans for i in range(len(drawn), len(got)))
    assert wrong <= secret_scan.FALSE_DISCOVERY * sum("random" in r.spans for r in got.values())


def test_few_random_tokens_among_many_paths_are_found(spark):
    rng = random.Random(31)
    found = wrong = 0
    for _ in range(4):
        drawn = ["".join(rng.choices(secret_scan.ALPHABETS["base64"], k=40)) for _ in range(5)]
        plain = ["/".join(rng.choices(["Usr", "local", "share", "Library", "python3", "Site", "packages", "Main", "v2"], k=12))[:40] for _ in range(300)]
        got = rows(spark, list(enumerate(f"see {t} here" for t in drawn + plain)))
        found += sum("random" in got[i].spans for i in range(5))
        wrong += sum("random" in got[i].spans for i in range(5, 305))
    assert found >= 18 and wrong <= 12


def test_many_hits_in_a_text_take_linear_time(spark):
    text = " ".join(f"token={i:08d}" for i in range(20_000))
    began = time.perf_counter()
    got = rows(spark, [(1, text)])[1]
    assert got.n_assign == 20_000 and time.perf_counter() - began < 60
    assert got.base_sha256 == hashlib.sha256(",".join(base(text)).encode()).hexdigest()


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([(1, 'a token = "abcdefghij" b', 5, 6, 7)], "doc_id long, text string, _spans int, _row int, key int")
    got = secret_scan.redact(df)
    assert got.columns == df.columns and tuple(got.first()) == (1, 'a [SECRET]" b', 5, 6, 7)


def test_redaction(spark):
    docs = spark.createDataFrame([(1, 'a token = "abcdefghij" b', 99, "en"), (2, "clean", 5, "fr"), (None, None, None, None)],
                                 "doc_id long, text string, n_chars long, spans string")
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert out[1].text == 'a [SECRET]" b' and out[1].n_chars == len(out[1].text)
    assert tuple(out[2]) == (2, "clean", 5, "fr") and tuple(out[None]) == (None,) * 4


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert secret_scan.digest(df).count() == 0
    assert secret_scan.redact(df).count() == 0


def test_one_more_token_makes_no_jump(spark):
    """What is found of a stratum doesn't change with its twentieth random token, nor much with any other."""
    rng = random.Random(41)
    drawn = ["".join(rng.choices(secret_scan.ALPHABETS["base64"], k=40)) for _ in range(30)]
    plain = ["/".join(rng.choices(["Usr", "local", "share", "Library", "python3", "Site", "packages", "Main", "v2"], k=12))[:40] for _ in range(200)]
    before = None
    for n in (1, 3, 19, 20, 21, 30):
        got = rows(spark, list(enumerate(f"see {t} here" for t in drawn[:n] + plain)))
        found = {t for i, t in enumerate(drawn[:n] + plain) if "random" in got[i].spans}
        assert not found & set(plain) and (n < 3 or len(found) >= 0.8 * n)
        assert before is None or len(before - found) == 0, n
        before = found


def test_paths_alone_are_not_found(spark):
    """No random token at all: of 3,000 tokens of words and numbers hardly any is found, whatever their lengths."""
    rng = random.Random(43)
    words = "the of river user local share lib python site pack Main test data config index page view File name time Order value".split()
    plain = [rng.choice(["/", "_", "-"]).join(rng.choices(words, k=20))[: rng.randint(20, 70)] for _ in range(3000)]
    got = rows(spark, list(enumerate(f"see {t} here" for t in plain)))
    assert sum("random" in r.spans for r in got.values()) <= 3


def test_a_run_count_that_fits_too_well_saves_no_word(spark):
    """A p-value of 1 in one test hides no small one in another."""
    word = "abababababababababababababababab"
    row = secret_scan.token_tests(spark.createDataFrame([(word,), ("ThThThThThThThThThThThTh",)], "s string")).collect()
    assert all(r.p < 1e-3 and r.q == 1.0 for r in row)

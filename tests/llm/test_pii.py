import datetime
import hashlib
import random
import re

import pytest
from usagelake.llm import pii


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def iban_ok(text):
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


KEY = "test key"


def run(spark, texts, key=KEY):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, pii_kinds string")
    return [(r.text, r.pii_kinds) for r in sorted(pii.pseudonymise(df, key).collect(), key=lambda r: r.doc_id)]


def card(rng, n=16):
    body = "".join(rng.choices("0123456789", k=n - 1))
    return next(body + c for c in "0123456789" if luhn(body + c))


def test_formats_stay_valid_and_linked(spark):
    rng = random.Random(9)
    ip = lambda: ".".join(str(rng.randrange(256)) for _ in range(4))
    day = lambda f: (datetime.date(1900, 1, 1) + datetime.timedelta(rng.randrange(73049))).strftime(f)
    makers = {
        "card": [card(rng, rng.choice([13, 15, 16, 19])) for _ in range(20)] + ["4111 1111 1111 1111", "4111-1111-1111-1111"],
        "ip": [ip() for _ in range(20)] + ["0.0.0.0", "255.255.255.255"],
        "ssn": [f"{rng.choice([1, 123, 665, 667, 899]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}" for _ in range(20)],
        "date": [day("%Y-%m-%d") for _ in range(15)] + [day("%d/%m/%Y") for _ in range(15)] + [day("%d.%m.%Y") for _ in range(15)] + ["12/25/2020", "02/29/2024"],
        "phone": ["+1 (017) 555-7713", "(212) 555-0100", "212-555-0199", "+442071838750", "+49 030 1234 5678"],
        "email": ["und.34@mail7.example.com", "A.b+c_1@x.org", "a@b.co.uk", "o-k@sub-domain.example.net"],
        "iban": ["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"],
    }
    values = [(k, v) for k, vs in makers.items() for v in vs]
    got = run(spark, [f"see {v}, or ({v}) é" for _, v in values])
    seen = {}
    for (kind, old), (text, kinds) in zip(values, got, strict=True):
        m = re.fullmatch(r"see (.*), or \((.*)\) é", text)
        assert m and m[1] == m[2] and kinds == [kind, kind], (kind, old, text, kinds)
        new = m[1]
        shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
        assert kind == "ip" or shape(new) == shape(old), (old, new)
        if kind == "card":
            assert luhn(re.sub("[^0-9]", "", new))
        if kind == "ip":
            assert all(0 <= int(x) <= 255 and str(int(x)) == x for x in new.split(".")) and new.count(".") == 3
        if kind == "iban":
            assert iban_ok(new) and new[:2] == old[:2]
        if kind == "date":
            f = "%Y-%m-%d" if "-" in new else "%d.%m.%Y" if "." in new else "%m/%d/%Y" if int(old[3:5]) > 12 else "%d/%m/%Y"
            datetime.datetime.strptime(new, f)
        assert seen.setdefault((kind, new), old) == old
    assert sum(old != new for (_, new), old in seen.items()) >= len(seen) - 3
    assert run(spark, ["und.34@mail7.example.com"], "other")[0] != run(spark, ["und.34@mail7.example.com"])[0]


def test_invalid_values_and_other_text_stay(spark):
    texts = ["4111111111111112", "256.1.1.1", "000-12-3456", "2023-02-30", "1.2.3.4.5", "abc1234567890123456", "no digits", "", None, "v1.2.3", "x" * 5000 + "1", "12:30:45"]
    assert run(spark, texts) == [(t, []) for t in texts]


def test_permutations_are_bijections(spark):
    from pyspark.sql import functions as F

    df = spark.range(600).select(pii.permute_number(F.col("id"), 25, 24, "t", "k", lambda x: x < 590).alias("n"),
                                 pii.permute_text(F.lpad(F.col("id").cast("string"), 3, "0"), "t", "k").alias("t"), "id")
    rows = df.collect()
    assert sorted(r.n for r in rows if r.id < 590) == list(range(590))
    assert len({r.t for r in rows}) == 600


def test_rows(spark):
    df = spark.createDataFrame([(None, "a 97.51.17.173"), (1, None), (1, None)], "doc_id long, text string")
    got = pii.digest(df, KEY).collect()
    assert len(got) == 3 and sorted(r.n_pii for r in got) == [0, 0, 1] and "97.51.17.173" not in str(got)
    assert pii.digest(df.limit(0), KEY).count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymise(df, "")


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("mail a@b.org", 1, 2, 3, "k")], "text string, _found int, _new int, row int, `pii_kinds` string")
    got = pii.pseudonymise(df, KEY)
    assert got.columns == ["text", "_found", "_new", "row", "pii_kinds"]
    assert tuple(got.first())[1:] == (1, 2, 3, ["email"])


def test_texts_keep_their_format_and_are_permuted(spark):
    from pyspark.sql import functions as F

    rows = ["abc", "x1", "Zz9-a.b", "7", "", "hello.World_22", "0123456789"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    got = [r.p for r in df.select(pii.permute_text(F.col("t"), "local", KEY).alias("p")).collect()]
    # Equal texts are equal, classes of symbols stay, and an inverse exists: all texts of a small format are hit once.
    assert all([bool(re.match("[0-9]", a)), bool(re.match("[a-z]", a))] == [bool(re.match("[0-9]", b)), bool(re.match("[a-z]", b))] for x, y in zip(rows, got, strict=True) for a, b in zip(x, y, strict=True))
    small = spark.range(676).select(F.concat(F.chr(97 + F.floor(F.col("id") / 26).cast("long")), F.chr(97 + F.col("id") % 26)).alias("t"))
    assert small.select(pii.permute_text(F.col("t"), "local", KEY).alias("p")).distinct().count() == 676


def number(*parts):
    return int(hashlib.sha256("|".join(parts).encode()).hexdigest()[:7], 16)


def plain_number(value, a, b, kind, valid):
    """The network once, and again until the value is a valid one."""
    while True:
        for r in range(8):
            high, low = divmod(value, b)
            value = (high + number(KEY, kind, str(r), str(low))) % a * b + low if r % 2 == 0 else high * b + (low + number(KEY, kind, str(r), str(high))) % b
        if valid(value):
            return value


def plain_text(text, kind):
    def moved(part, other, r):
        out = ""
        for i, c in enumerate(part, 1):
            low, n = next(((x, n) for x, n in (("0", 10), ("A", 26), ("a", 26)) if x <= c < chr(ord(x) + n)), (c, 1))
            out += chr(ord(low) + (ord(c) - ord(low) + number(KEY, kind, str(r), str(i), other)) % n)
        return out

    for r in range(8):
        half = len(text) // 2
        left, right = text[:half], text[half:]
        text = moved(left, right, r) + right if r % 2 == 0 else left + moved(right, left, r)
    return text


FIRST, USUAL, FAR = 693_595, 73_049, 3_652_059 - 73_049


def plain_day(day, kind="date", also=lambda d: True):
    at = day.toordinal() - 1
    back = lambda x: datetime.date.fromordinal(x + 1)
    if FIRST <= at < FIRST + USUAL:
        return back(FIRST + plain_number(at - FIRST, 271, 270, kind, lambda x: x < USUAL and also(back(x + FIRST))))
    real = lambda x: x if x < FIRST else x + USUAL
    return back(real(plain_number(at if at < FIRST else at - USUAL, 1892, 1892, f"far-{kind}", lambda x: x < FAR and also(back(real(x))))))


def test_equals_a_plain_network(spark):
    rng = random.Random(6)
    texts, want = [], []
    for _ in range(12):
        d = datetime.date.fromordinal(rng.randint(1, 3_652_059))
        texts.append(f"on {d:%d.%m.}{d.year:04} and {d.year:04}{d:-%m-%d}")
        new = plain_day(d)
        want.append(f"on {new:%d.%m.}{new.year:04} and {new.year:04}{new:-%m-%d}")
        ip = rng.randrange(1 << 32)
        dotted = lambda x: ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
        texts.append(dotted(ip))
        want.append(dotted(plain_number(ip, 65536, 65536, "ip", lambda x: True)))
        local, name = (rng.choice(["Joe.Doe", "x", "a_b9"]), rng.choice(["mail7.example", "x-y"]))
        texts.append(f"{local}@{name}.org")
        want.append(f"{plain_text(local, 'local')}@{plain_text(name, 'domain')}.org")
        texts.append("+1 555-0123-4567"[: rng.randint(15, 16)])
        want.append("+1" + plain_text(texts[-1][2:], "phone"))
    us = datetime.date(2150, 2, 27)
    texts.append(f"{us:%m/%d/%Y}")
    want.append(f"{plain_day(us, 'us-date', lambda d: d.day > 12):%m/%d/%Y}")
    assert [t for t, _ in run(spark, texts)] == want


def test_all_valid_dates_go(spark):
    texts = ["born 2150-01-02 and 1890-05-06", "0001-01-01", "9999-12-31", "31.12.1899", "01.01.2100", "0000-01-01", "2023-02-29"]
    got = run(spark, texts)
    assert [k for _, k in got] == [["date", "date"], ["date"], ["date"], ["date"], ["date"], [], []]
    assert all(a != b for a, (b, _) in zip(texts[:5], got[:5]))


def test_a_megabyte_of_each_formats_signs(spark):
    n = 1 << 20
    units = ["a@", "ab.", "a@ab.", "x", "9", "9.", "1-", "1/", "+", "(", "+1", "DE89", " 1234", "1234 ", "(12)", "000-", "a-", "%", "@", "2020-01-01", "1.1.1.1", "a@b.co ", "4111 1111 1111 1111 "]
    texts = [(u * (n // len(u) + 1))[:n] for u in units[:3]] + [(u * (n // 8 // len(u) + 1))[: n // 8] for u in units[3:]]
    texts += ["a@" + "ab." * 3000, "a@" + "ab." * 125 + "org", "a@" + "ab." * 126 + "org", "a@" + "ab." * 127 + "org"]
    got = run(spark, texts)
    assert all(len(t) == len(new) or "ip" in kinds for t, (new, kinds) in zip(texts, got))
    assert [k for _, k in got[-3:]] == [["email"]] * 3 and got[-1][0].endswith(".org") and not got[-2][0].startswith("a@ab.")

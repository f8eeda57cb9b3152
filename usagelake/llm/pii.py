"""Format-preserving pseudonyms for personal data, in DataFrame functions only.

E-mail and IP addresses, payment cards (Luhn), IBANs (modulo 97), social-security numbers, telephone numbers and
dates are found by one pattern, validated, and replaced by a keyed permutation of their own format: a Feistel network
whose rounds add a hash of one half to the other, symbol by symbol within the symbol's class, or on the
value's ordinal where not every string of the format is valid (walking the cycle until it is). Check
digits are computed anew. So a pseudonym is valid, different values have different pseudonyms, and equal values
stay linked across documents. What fails validation stays.

Whoever knows the key can invert the pseudonyms, so there is no key by default: the caller brings one and keeps it secret.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
#: Steps of a walk along a cycle: enough that a value out of range remains with a chance below 1e-9.
WALK = 24
#: All dates of the years 1 to 9999, by days since the first one; those of 1900 to 2099 stay among themselves, as do the others.
FIRST_DAY, ALL_DAYS = "0001-01-01", 3_652_059
USUAL_FROM, USUAL_DAYS = 693_595, 73_049
#: Most labels of a domain: what is longer than a domain can be (253 characters) ends with the label before.
LABELS = 126

#: The formats. The order is the priority of formats that begin at one place.
FORMATS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9_%+-][A-Za-z0-9._%+-]{0,63}+@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.){1,"
             + str(LABELS) + r"}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,4})?)(?![A-Za-z0-9])",
    "ip": r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9A-Za-z]|[/.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[0-9]{8,15}(?![0-9A-Za-z])",
    "card": r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2}[ -][0-9]{1,7})(?![0-9A-Za-z])",
}
#: All of them. None begins inside a word, and but for two they begin with a digit, a plus sign or a bracket.
ANY = (r"(?<![0-9A-Za-z])(?:" + FORMATS["email"] + r"|(?=[A-Z]{2}[0-9]{2})" + FORMATS["iban"] + r"|(?=[0-9+(])(?:"
       + "|".join(v for k, v in FORMATS.items() if k not in ("email", "iban")) + "))")
#: A text without a match of this, which is quickly seen, has none of the formats.
LIKELY = r"@|[0-9][0-9.() /+-]{5,}[0-9]|[A-Z]{2}[0-9]{2}[A-Z0-9 ]{11}"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used or looped over."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _number(*parts: Column) -> Column:
    """28 bits of a keyed hash."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 7), 16, 10).cast("long")


def _symbol(c: Column, shift: Column) -> Column:
    """The symbol moved within its class; what is no ASCII letter or digit stays."""
    code = F.ascii(c)
    return (F.when((code >= 48) & (code <= 57), F.chr(48 + (code - 48 + shift) % 10))
            .when((code >= 65) & (code <= 90), F.chr(65 + (code - 65 + shift) % 26))
            .when((code >= 97) & (code <= 122), F.chr(97 + (code - 97 + shift) % 26)).otherwise(c))


def permute_text(text: Column, kind: str, key: str) -> Column:
    """Feistel network over the two halves of a text, a bijection among texts with equal classes of symbols."""
    def shifted(part: Column, other: Column, number: Column) -> Column:
        moved = F.transform(F.sequence(F.lit(1), F.length(part)), lambda i: _symbol(
            F.substring(part, i, F.lit(1)), _number(F.lit(key), F.lit(kind), number.cast("string"), i.cast("string"), other)))
        return F.when(F.length(part) > 0, F.array_join(moved, "")).otherwise("")

    def step(t: Column, number: Column) -> Column:
        half = F.floor(F.length(t) / 2).cast("int")
        left, right = F.substring(t, F.lit(1), half), F.substring(t, half + 1, F.length(t))
        return F.when(number % 2 == 0, F.concat(shifted(left, right, number), right)).otherwise(F.concat(left, shifted(right, left, number)))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), text, step)


def permute_number(value: Column, a: int, b: int, kind: str, key: str, valid=None) -> Column:
    """Feistel network over value // b and value % b, a bijection on 0 .. a*b-1; walks until ``valid`` holds."""

    def step(x: Column, number: Column) -> Column:
        high, low = F.floor(x / b).cast("long"), x % b
        tag = (F.lit(key), F.lit(kind), number.cast("string"))
        return F.when(number % 2 == 0, (high + _number(*tag, low.cast("string"))) % a * b + low).otherwise(
            high * b + (low + _number(*tag, high.cast("string"))) % b)

    once = lambda x: F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), x, step)
    if valid is None:
        return once(value)
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), once(value), lambda x, _: F.when(valid(x), x).otherwise(once(x)))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of all digits, the last one being the check digit."""
    def total(back: Column) -> Column:
        digit = lambda i: F.substring(back, i, F.lit(1)).cast("int")
        return F.aggregate(F.sequence(F.lit(1), F.length(back)), F.lit(0), lambda a, i: a + F.when(
            i % 2 == 1, digit(i)).otherwise(2 * digit(i) - F.when(digit(i) > 4, 9).otherwise(0)))

    return _let(F.reverse(digits), total)


def _like(pattern: Column, digits: Column) -> Column:
    """``digits`` in the places of the letters and digits of ``pattern``, separators kept."""
    start = F.struct(F.lit(1).alias("at"), F.lit("").alias("out"))

    def filled(new: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            c = F.substring(pattern, i, F.lit(1))
            sign = c.rlike("[^0-9A-Za-z]")
            return F.struct(F.when(sign, acc["at"]).otherwise(acc["at"] + 1).alias("at"), F.concat(acc["out"], F.when(sign, c).otherwise(F.substring(new, acc["at"], F.lit(1)))).alias("out"))

        return F.aggregate(F.sequence(F.lit(1), F.length(pattern)), start, step, lambda acc: acc["out"])

    return _let(digits, filled)


def _card(m: Column, key: str) -> tuple[Column, Column]:
    digits = F.regexp_replace(m, "[^0-9]", "")
    body = permute_text(F.substring(digits, F.lit(1), F.length(digits) - 1), "card", key)
    checked = _let(body, lambda b: F.concat(b, ((10 - _luhn(F.concat(b, F.lit("0"))) % 10) % 10).cast("string")))
    return F.length(digits).between(13, 19) & (_luhn(digits) % 10 == 0), _like(m, checked)


def _rest97(text: Column) -> Column:
    """Remainder modulo 97 of a text of digits and capitals (A is 10)."""
    def rest(t: Column) -> Column:
        code = lambda i: F.ascii(F.substring(t, i, F.lit(1)))
        return F.aggregate(F.sequence(F.lit(1), F.length(t)), F.lit(0), lambda a, i: F.when(
            code(i) >= 65, (a * 100 + code(i) - 55) % 97).otherwise((a * 10 + code(i) - 48) % 97))

    return _let(text, rest)


def _iban(m: Column, key: str) -> tuple[Column, Column]:
    plain = F.regexp_replace(m, " ", "")
    country, body = F.substring(plain, 1, 2), F.substring(plain, F.lit(5), F.length(plain))
    made = _let(permute_text(body, "iban", key), lambda new: F.concat(
        country, F.lpad((98 - _rest97(F.concat(new, country, F.lit("00")))).cast("string"), 2, "0"), new))
    return F.length(plain).between(15, 34) & (_rest97(F.concat(body, F.substring(plain, 1, 4))) == 1), _like(m, made)


def _ip(m: Column, key: str) -> tuple[Column, Column]:
    parts = F.transform(F.split(m, r"\."), lambda x: x.cast("long"))
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a * 256 + x)
    out = _let(permute_number(value, 65_536, 65_536, "ip", key), lambda new: F.concat_ws(
        ".", *[(F.floor(new / 256**i).cast("long") % 256).cast("string") for i in (3, 2, 1, 0)]))
    return F.forall(parts, lambda x: x <= 255), out


def _ssn(m: Column, key: str) -> tuple[Column, Column]:
    area, group, serial = (F.substring(m, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    # Areas 1 to 899 without 666, groups 1 to 99, serials 1 to 9999, as one number.
    value = ((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1) * 9_999 + serial - 1
    def written(new: Column) -> Column:
        place = F.floor(new / (99 * 9_999)).cast("long")
        parts = ((place + F.when(place >= 665, 2).otherwise(1), 3), (F.floor(new / 9_999).cast("long") % 99 + 1, 2), (new % 9_999 + 1, 4))
        return F.concat_ws("-", *[F.lpad(x.cast("string"), n, "0") for x, n in parts])

    return (area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)), _let(permute_number(value, 898 * 99, 9_999, "ssn", key), written)


def _date(m: Column, key: str) -> tuple[Column, Column]:
    first, sign = F.lit(FIRST_DAY).cast("date"), F.substring(m, 3, 1)
    iso = m.rlike("^[0-9]{4}-")
    year = F.when(iso, F.substring(m, 1, 4)).otherwise(F.substring(m, 7, 4))
    a, b = F.when(iso, F.substring(m, 9, 2)).otherwise(F.substring(m, 1, 2)), F.when(iso, F.substring(m, 6, 2)).otherwise(F.substring(m, 4, 2))
    there = lambda day, month: F.when(year != "0000", F.try_to_timestamp(F.concat_ws("-", year, month, day), F.lit("yyyy-MM-dd")).cast("date"))
    by_day, by_month = there(a, b), there(b, a)
    ordinal = lambda d: F.datediff(d, first).cast("long")
    day_of = lambda x: F.date_add(first, x.cast("int"))
    far_back = lambda x: F.when(x < USUAL_FROM, x).otherwise(x + USUAL_DAYS)  # noqa: E731  # the other dates without a gap

    def moved(day: Column, kind: str, also) -> Column:
        def of(x: Column) -> Column:
            usual = permute_number(x - USUAL_FROM, 271, 270, kind, key, lambda y: (y < USUAL_DAYS) & also(day_of(F.least(y, F.lit(USUAL_DAYS)) + USUAL_FROM)))
            others, far = ALL_DAYS - USUAL_DAYS, F.when(x < USUAL_FROM, x).otherwise(x - USUAL_DAYS)
            odd = permute_number(far, 1_892, 1_892, f"far-{kind}", key, lambda y: (y < others) & also(day_of(far_back(F.least(y, F.lit(others - 1))))))
            return F.when(x.between(USUAL_FROM, USUAL_FROM + USUAL_DAYS - 1), usual + USUAL_FROM).otherwise(far_back(odd))

        return day_of(_let(ordinal(day), of))

    new = moved(by_day, "date", lambda d: F.lit(True))
    # Written month first, and so that it can be read no other way.
    us = moved(by_month, "us-date", lambda d: F.dayofmonth(d) > 12)
    text = F.when(by_day.isNull(), F.date_format(us, "MM/dd/yyyy")).when(iso, F.date_format(new, "yyyy-MM-dd")).when(
        sign == "/", F.date_format(new, "dd/MM/yyyy")).otherwise(F.date_format(new, "dd.MM.yyyy"))
    return by_day.isNotNull() | (sign == "/") & by_month.isNotNull(), text


def _phone(m: Column, key: str) -> tuple[Column, Column]:
    prefix = F.when(m.rlike(r"^\+[0-9]{8,}"), F.substring(m, 1, 2)).otherwise(F.regexp_extract(m, r"^\+[0-9]{1,3}", 0))
    rest = F.substring(m, F.length(prefix) + 1, F.length(m))
    digits = F.length(F.regexp_replace(m, "[^0-9]", ""))
    return digits.between(8, 15), F.concat(prefix, permute_text(rest, "phone", key))


def _email(m: Column, key: str) -> tuple[Column, Column]:
    local, domain = F.substring_index(m, "@", 1), F.substring_index(m, "@", -1)
    top = F.substring_index(domain, ".", -1)
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.lit(True), F.concat(permute_text(local, "local", key), F.lit("@"), permute_text(name, "domain", key), F.lit("."), top)


MAKERS = {"email": _email, "iban": _iban, "ip": _ip, "ssn": _ssn, "date": _date, "phone": _phone, "card": _card}


def _pseudonym(m: Column, key: str) -> Column:
    """(kind, new text) of one match; kind is null and the text stays where it isn't valid."""
    kind, new = F.lit(None).cast("string"), m
    for name in reversed(FORMATS):
        valid, text = MAKERS[name](m, key)
        # The pattern without what stands around it: the match is cut out of its text.
        shape = m.rlike("^(?:" + FORMATS[name] + ")$")
        kind = F.when(shape & valid, F.lit(name)).otherwise(kind)
        new = F.when(shape & valid, text).otherwise(new)
    return F.struct(kind.alias("kind"), new.alias("new"))


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with the personal data in ``text`` replaced and a column ``pii_kinds``, the kinds replaced, in order.

    All other columns and all other text stay, a column ``n_chars`` too, whatever their names; of a column ``pii_kinds`` that is there
    already the new one takes the place. Null texts stay null with no kinds, as texts without personal data; an
    empty table gives no rows; repeated rows and null ids are treated alike. Texts of any length are searched whole, a domain up to ``LABELS`` labels. Equal values have equal pseudonyms everywhere under one key.
    """
    if not key:
        raise ValueError("pseudonyms need a key")
    has = F.coalesce(F.col("text").rlike(LIKELY), F.lit(False))
    found = F.when(has, F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    # One column holds the row, so no name of it can clash.
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), found.alias("found"))
    out = out.select("row", "found", F.transform("found", lambda m: _pseudonym(m, key)).alias("new"))
    gaps = F.split("row.text", ANY, -1)
    joined = F.array_join(F.zip_with(gaps, "new", lambda g, n: F.concat(g, F.coalesce(n["new"], F.lit("")))), "")
    text = F.when(F.size("found") > 0, joined).otherwise(F.col("row.text"))
    kinds = F.filter(F.transform("new", lambda n: n["kind"]), lambda k: k.isNotNull())
    rest = [text.alias(c) if c == "text" else F.col("row")[c].alias(c) for c in docs.columns if c != "pii_kinds"]
    return out.select(*rest, kinds.alias("pii_kinds"))


def digest(docs: DataFrame, key: str) -> DataFrame:
    """Each document's new text, how many values of each kind were replaced, and of all."""
    out = pseudonymise(docs.select("doc_id", "text"), key)
    counts = [F.size(F.filter("pii_kinds", _is(k))).cast("long").alias(f"n_{k}") for k in FORMATS]
    return out.select("doc_id", *counts, F.size("pii_kinds").cast("long").alias("n_pii"), "text")


def _is(kind: str):
    return lambda k: k == kind

"""Secret scans: fixed rules, and a battery of randomness tests on long tokens, in DataFrame functions only.

A token is a run of 20 or more letters, digits and base64 signs; every such run is tested. Its
encoding is the narrowest alphabet that holds it (hexadecimal, base32, small letters with digits,
base64). Three tests ask whether it looks drawn at random from that alphabet: chi-squared uniformity
of the symbols, runs above and below the middle of the alphabet, and serial correlation of neighbours. The smallest of their
p-values counts, taken for the smallest of three (Sidak), so one test that fails isn't made up for by another that fits too well.

A random token has an evenly spread p-value. Words, paths and numbers have small ones, the smaller the longer they are: ``NULLS`` says how often
one of a length looks as random by chance (q). False discoveries are controlled by the step-up rule of Benjamini and Hochberg on q in each stratum of
encoding and length, with the number of tokens that aren't random taken as all but twice those above a p-value of 0.5. One rule serves any number
of tokens: five random ones of 40 signs among 300 paths are as good as found one by one. The counts behind it are a small
histogram over the whole input, in which a token counts once however often it occurs: the p-values of copies are one draw, not many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from usagelake.llm.shared import stored

#: The base rules. Group 2 of an assignment is its value.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")
#: The shortest value, key and hexadecimal run that count.
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 8, 16, 32

TOKEN = r"[A-Za-z0-9+/_-]{20,}={0,2}"
FALSE_DISCOVERY = 0.05
#: Below this p-value nothing is found.
LEAST_P = 0.02
#: Bins of a stratum's histogram: tenths of a decimal power of q, up to so many.
STEPS, BINS = 10, 200
#: How often what isn't random has a p-value above p at a length of n: exp(a + b n + (c + d n) log(1 - p)). Fitted for n from 20 to 56 on digits (hex), on
#: joined common words with numbers in small letters (base36), and on such words in any letters with the usual separators (base64); 6,000 of each length.
NULLS = {"hex": (1.211, -0.0653, -10.07, 0.674), "base36": (0.854, -0.0547, -1.157, 0.149), "base64": (3.20, -0.219, -7.21, 0.600)}
#: The fit that an encoding takes.
NULL_OF = {"hex": "hex", "HEX": "hex", "base32": "base36", "base36": "base36", "base64": "base64", "base64url": "base64"}
#: Alphabets by name, narrowest first; each symbol's place is its value.
ALPHABETS = {
    "hex": "0123456789abcdef",
    "HEX": "0123456789ABCDEF",
    "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567",
    "base36": "0123456789abcdefghijklmnopqrstuvwxyz",
    "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/",
    "base64url": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_",
}

#: Matches of a text that are placed together.
BLOCK = 128
SPAN = "array<struct<start:int,end:int,s:string>>"


def _spans(text: Column, pattern: str, prefilter: str) -> Column:
    """All matches with their code points: leftmost, non-overlapping. ``prefilter`` holds wherever there is a useful match."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    lengths = F.transform(F.split(text, pattern, -1), lambda x: F.length(x))
    pairs = F.arrays_zip(F.transform(found, lambda x: F.length(x)).alias("m"), lengths.alias("gap"), found.alias("s"))
    none = F.array().cast(SPAN)
    state = "struct<at:int,out:array<array<struct<start:int,end:int,s:string>>>>"

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["m"], F.lit(0))
        one = F.struct(begin.alias("start"), end.alias("end"), x["s"].alias("s"))
        return F.struct(end.alias("at"), F.when(x["m"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(one))).alias("out"))

    def block(acc: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return _let(inner, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")).cast(state))

    def spans(every: Column) -> Column:
        # In blocks, so that no long array is copied for each of its elements.
        parts = F.transform(F.sequence(F.lit(0), F.floor(F.size(every) / BLOCK).cast("int")), lambda i: F.slice(every, i * BLOCK + 1, BLOCK))
        return F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(state), block, lambda acc: F.flatten(acc["out"]))

    return F.when(text.rlike(prefilter), _let(pairs, spans)).otherwise(none)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _normal_two_sided(z: Column) -> Column:
    """Probability that a standard normal is at least as far from 0 (a rational approximation, good to 1e-7)."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1.0 / (1.0 + 0.3275911 * x)
    series = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    return F.least(F.lit(1.0), series * F.exp(-x * x))


def token_tests(tokens: DataFrame) -> DataFrame:
    """``tokens(s)`` with its encoding, length the p-values ``p_uniform``, ``p_runs``, ``p_serial`` and ``p``, and ``q``."""
    body = F.regexp_replace("s", "=+$", "")
    kind = F.lit("base64url")
    for name in reversed(ALPHABETS):
        sign = ALPHABETS[name].replace("-", r"\-")
        kind = F.when(body.rlike(f"^[{sign}]+$"), F.lit(name)).otherwise(kind)
    out = tokens.withColumns({"body": body, "encoding": kind})
    signs, size = F.lit(ALPHABETS["base64url"]), F.lit(64)
    for name, alphabet in ALPHABETS.items():
        signs = F.when(F.col("encoding") == name, F.lit(alphabet)).otherwise(signs)
        size = F.when(F.col("encoding") == name, F.lit(len(alphabet))).otherwise(size)
    out = out.withColumns({"signs": signs, "k": size.cast("double")})
    symbols = F.filter(F.split("body", ""), lambda c: c != "")
    out = out.withColumn("x", F.transform(symbols, lambda c: F.call_function("locate", c, F.col("signs")).cast("double")))
    out = out.withColumns({
        "n": F.size("x").cast("double"),
        "mean": F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / F.size("x"),
        "up": F.transform("x", lambda v: v > (F.col("k") + 1) / 2),
        "squares": F.aggregate(F.array_distinct("x"), F.lit(0.0), lambda a, v: a + F.pow(F.size(F.filter("x", lambda w: w == v)).cast("double"), F.lit(2.0))),
    })
    later = F.slice("up", 2, F.size("up"))
    out = out.withColumns({
        "n1": F.size(F.filter("up", lambda u: u)).cast("double"),
        "changes": F.size(F.filter(F.transform(later, lambda u, i: u != F.get("up", i)), lambda d: d)).cast("double"),
        "spread": F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("mean")) * (v - F.col("mean"))),
        "lagged": F.aggregate(F.transform(F.slice("x", 2, F.size("x")), lambda v, i: (v - F.col("mean")) * (F.get("x", i) - F.col("mean"))), F.lit(0.0), lambda a, v: a + v),
    })
    free = F.col("k") - 1
    chi = F.greatest(F.lit(0.0), F.col("k") / F.col("n") * F.col("squares") - F.col("n"))
    cube = F.pow(chi / free, F.lit(1 / 3))
    z = (cube - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))  # Wilson-Hilferty
    upper = F.when(z > 0, _normal_two_sided(z) / 2).otherwise(1 - _normal_two_sided(z) / 2)
    n1, n = F.col("n1"), F.col("n")
    expected = 2 * n1 * (n - n1) / n
    variance = expected * (expected - 1) / (n - 1)
    runs = F.when(variance > 0, _normal_two_sided((F.col("changes") - expected) / F.sqrt(variance))).otherwise(0.0)
    serial = F.when(F.col("spread") > 0, _normal_two_sided((F.col("lagged") / F.col("spread") + 1 / n) * F.sqrt(n))).otherwise(0.0)
    out = out.withColumns({"p_uniform": upper, "p_runs": runs, "p_serial": serial})
    p = 1 - F.pow(1 - F.least("p_uniform", "p_runs", "p_serial"), F.lit(3.0))
    out = out.withColumn("p", F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    power = F.lit(0.0)
    for name, fit in NULL_OF.items():
        a, b, c, d = NULLS[fit]
        power = F.when(F.col("encoding") == name, a + b * n + (c + d * n) * F.log(F.greatest(1 - F.col("p"), F.lit(1e-12)))).otherwise(power)
    q = F.when(F.col("p") < LEAST_P, 1.0).otherwise(F.exp(F.least(F.lit(0.0), power)))
    return out.select(*tokens.columns, "encoding", n.cast("int").alias("length"), "p_uniform", "p_runs", "p_serial", "p", q.alias("q"))


def _thresholds(tested: DataFrame) -> DataFrame:
    """For each stratum in which anything is found the least bin that is."""
    distinct = tested.select("stratum", "bin", "upper", "s").distinct()
    bins = distinct.groupBy("stratum", "bin").agg(F.count("*").alias("n"), F.count_if("upper").alias("upper"))
    above = Window.partitionBy("stratum").orderBy(F.col("bin").desc()).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("stratum")
    bins = bins.withColumns({"kept": F.sum("n").over(above), "all": F.sum("n").over(everything), "random": 2 * F.sum("upper").over(everything)})
    wrong = F.greatest(F.col("all") - F.col("random"), F.lit(1)) * F.pow(F.lit(10.0), -F.col("bin") / F.lit(float(STEPS)))
    return bins.filter((F.col("bin") > 0) & (wrong <= FALSE_DISCOVERY * F.col("kept"))).groupBy("stratum").agg(F.min("bin").alias("least"))


def _found(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    assign = _spans(text, ASSIGN, r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]")
    access = _spans(text, ACCESS, ACCESS)
    # A longer run that starts a match is the same run, so short ones need not be listed.
    hexes = _spans(text, HEX.replace("+", "{%d,}" % LEAST_HEX), HEX.replace("+", "{%d,}" % LEAST_HEX))
    tokens = _spans(text, TOKEN, TOKEN)
    return docs.select(
        F.monotonically_increasing_id().alias("row_no"), "doc_id",
        F.filter(assign, lambda x: F.length(F.regexp_extract(x["s"], ASSIGN, 2)) >= LEAST_VALUE).alias("assign"),
        F.filter(access, lambda x: F.length(x["s"]) >= LEAST_ACCESS).alias("access"), hexes.alias("hex"),
        tokens.alias("tokens"))


def find_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id and ``spans``, all spans (start, kind_no, kind, end).

    Spans are sorted by start, then kind: assign (the whole match, from its keyword to the end of its value),
    access, hex, and random for tokens that the tests choose and no base span touches. Positions count code points from 0, end
    exclusive. Null and empty texts have no spans; an empty table gives no rows; repeated rows are each returned; a null doc_id
    stays; other columns are ignored. Texts of any length are searched whole, in time that grows with them.
    """
    found = stored(_found(docs), "secrets-found")
    base = F.concat(*[F.col(kind) for kind in KINDS[:3]])
    tokens = found.select("row_no", F.explode_outer("tokens").alias("t"), base.alias("base")).filter("t is not null")
    free = ~F.exists("base", lambda b: (b["start"] < F.col("t.end")) & (F.col("t.start") < b["end"]))
    tokens = tokens.select("row_no", "t.start", "t.end", "t.s", free.alias("free"))
    tested = token_tests(tokens)
    length = F.least(F.floor(F.log2(F.col("length").cast("double")) * 2), F.lit(20))
    tested = stored(tested.select("row_no", "start", "end", "free", "s", F.concat_ws(":", "encoding", length.cast("string")).alias("stratum"), (F.col("p") > 0.5).alias("upper"),
                                  F.least(F.floor(-F.log10("q") * STEPS), F.lit(BINS)).cast("int").alias("bin")), "secrets-tested")
    chosen = tested.join(F.broadcast(_thresholds(tested)), "stratum").filter("free and bin >= least")
    chosen = chosen.groupBy("row_no").agg(F.collect_list(F.struct("start", "end")).alias("random"))
    out = found.join(chosen.hint("merge"), "row_no", "left")
    every = F.concat(*[F.transform(F.coalesce(kind, F.array().cast("array<struct<start:int,end:int>>")) if kind == "random" else F.col(kind), _named(i, kind))
                       for i, kind in enumerate(KINDS)])
    return out.select("doc_id", F.array_sort(every).alias("spans"))


def _named(number: int, kind: str):
    return lambda x: F.struct(x["start"].alias("start"), F.lit(number).alias("kind_no"), F.lit(kind).alias("kind"), x["end"].alias("end"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest(docs: DataFrame) -> DataFrame:
    """``find_secrets`` as counts of the base kinds, a digest of the base spans, and all spans as text."""

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")

    return find_secrets(docs).select(
        "doc_id", *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(_joined(F.filter("spans", lambda x: x["kind_no"] < 3)).cast("binary"), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The rows of ``docs`` with every secret span of ``text`` replaced by ``mark`` (touching spans by one mark).

    ``n_chars``, where present, follows the text; rows without a secret and all other columns stay as they
    are, whatever their names. Rows of one doc_id with different texts are matched by id and text; rows that repeat are each returned, null ids
    and texts stay, an empty table gives no rows.
    """
    # One column holds the row, so no name of it can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    spans = find_secrets(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).filter(F.size("spans") > 0)
    spans = spans.dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("key"), "spans")
    text = F.col("row.text")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        gap = F.when(x["start"] > acc["at"], F.substring(text, acc["at"] + 1, x["start"] - acc["at"])).otherwise("")
        new = (x["start"] >= acc["at"]) & ((x["start"] > acc["at"]) | (F.size(acc["out"]) == 0))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], F.array(gap, F.when(new, F.lit(mark)).otherwise(""))).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(text, acc["at"] + 1, F.length(text))))
    hit = F.col("spans").isNotNull()
    out = keyed.join(spans.hint("merge"), "key", "left").select("row", "spans", F.when(hit, clean).otherwise(text).alias("new"))
    follows = F.when(hit, F.length("new")).otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None
    return out.select(*[F.col("new").alias(c) if c == "text" else follows.alias(c) if c == "n_chars" else F.col("row")[c].alias(c) for c in docs.columns])

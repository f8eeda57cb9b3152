"""Benchmark decontamination by winnowing, in DataFrame functions only.

Every k-gram of words is hashed; of each sliding window of hashes the smallest are kept as
fingerprints. Two texts that share ``window`` consecutive words share a whole window of hashes, so they
keep the same k-gram of it: joining the fingerprints of documents and benchmark finds every shared
span. A k-gram meets each k-gram of the benchmark once, however many items have it. Around a hit the whole windows of the document
meet the distinct windows of the benchmark by a hash and are compared word by word, so a collision can't mark a word; the items of a
window are looked up last, for distinct windows of a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from usagelake.llm.shared import broadcast_if_small, lower_ascii, stored

#: A document word is in an occurrence of a window of so many consecutive item words.
WINDOW = 10
#: Words in a k-gram; with WINDOW - K + 1 hashes in a winnowing window each shared span has a fingerprint.
K = 5
#: The fingerprints of a benchmark are broadcast up to so many rows (about 30 bytes each).
BROADCAST_FINGERPRINTS = 1_000_000
#: The distinct windows of a benchmark are broadcast up to so many (about 150 bytes each).
BROADCAST_WINDOWS = 500_000


def words(text: Column) -> Column:
    """Words of the text, A-Z lower-cased: runs of a-z, 0-9 and everything beyond ASCII. Null has none."""
    return F.array_remove(F.split(lower_ascii(text), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _grams(tokens: Column, n: Column, k: int) -> Column:
    def one(i: Column) -> Column:
        return F.xxhash64(*[F.get(tokens, i + j) for j in range(k)])

    return F.when(n >= k, F.transform(F.sequence(F.lit(0), n - k), one)).otherwise(F.array().cast("array<bigint>"))


def _entry(kind: int, before: int, length: int, context: bool):
    """One fingerprint of a text: what it is, where, and for documents the words that its windows span."""

    def made(h: Column, p: Column) -> Column:
        words_near = [F.slice("w", F.greatest(p - before, F.lit(0)) + 1, length + F.least(p, F.lit(before))).alias("near")]
        return F.struct(F.lit(kind).alias("kind"), h.alias("h"), p.alias("p"), *(words_near if context else []))

    return made


def _fingerprints(df: DataFrame, keep: list[str], lengths: list[int], window: int, k: int, context: bool) -> DataFrame:
    """``keep`` and array ``fps`` of (kind, h, p): winnowed k-grams, and all n-grams of each short length n.

    A text is winnowed when it has a whole window. Ties keep every smallest hash of a window. To be read
    with ``explode_outer``: for a plain explode the optimizer infers a filter on the array and pushes it
    down, which would compute all of this again for each element.
    """
    span = window - k + 1
    none = F.array().cast("array<bigint>")
    out = df.withColumn("_g", F.when(F.col("n_words") >= window, _grams(F.col("w"), F.col("n_words"), k)).otherwise(none))
    out = out.withColumn("_m", F.when(F.size("_g") >= span, F.transform(
        F.sequence(F.lit(0), F.size("_g") - span),
        lambda i: F.least(*[F.get("_g", i + j) for j in range(span)]) if span > 1 else F.get("_g", i),
    )).otherwise(none))
    entry = _entry(0, span - 1, window, context)

    def chosen(x: Column, p: Column) -> Column:
        best = [F.get("_m", p - j) for j in range(span)]
        return F.when(x == (F.greatest(*best) if span > 1 else best[0]), entry(x, p))

    parts = [F.array_compact(F.transform("_g", chosen))]
    for n in lengths:
        parts.append(F.transform(_grams(F.col("w"), F.col("n_words"), n), _entry(n, 0, n, context)))
    return out.select(*keep, F.concat(*parts).alias("fps"))


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K) -> DataFrame:
    """One row for each row of ``docs(doc_id, text)``: doc_id, n_words, hits, items.

    ``hits`` holds the positions of the words (from 0, ascending) in any occurrence of a window of a row
    of ``benchmark(item_id, text)``; ``items`` the ids with such a window, as sorted distinct strings. A window
    is ``window`` consecutive words of an item, or all of a shorter one. Null and empty texts have no
    words and no windows; an empty table on either side gives no hits; rows that repeat are each judged; a null
    item_id marks words but isn't listed; other columns are ignored. Texts of any length are judged whole: a task holds the words and k-grams of one.

    A document is read once: each fingerprint carries the words around it that its windows span, so that a
    hit is extended and checked word by word without going back to the text.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n_words", F.size("w")).filter(
        "n_words > 0")
    items = stored(items, "items")
    lengths = sorted(r[0] for r in items.filter(F.col("n_words") < window).select("n_words").distinct().collect())
    item_fps = _fingerprints(items, ["n_words"], lengths, window, k, context=False).select("n_words", F.explode_outer("fps").alias("f"))
    grams = item_fps.filter((F.col("f.kind") == 0) & (F.col("n_words") >= window) | (F.col("f.kind") == F.col("n_words")))
    grams = stored(grams.select("f.kind", "f.h").distinct().withColumn("met", F.lit(True)), "item-fingerprints")
    n = F.least(F.lit(window), F.col("n_words"))
    cut = F.transform(F.sequence(F.lit(1), F.col("n_words") - n + 1), lambda at: F.slice("w", at, n))
    parts = stored(items.select(F.col("item_id").cast("string").alias("item"), F.explode(cut).alias("ws")).distinct(), "item-windows")
    windows = parts.groupBy("ws").agg(F.count("*").alias("times")).select("ws", _hash(F.col("ws")).alias("wh"))

    read = docs.select("doc_id", words(F.col("text")).alias("w")).withColumns(
        {"n_words": F.size("w"), "row_no": F.monotonically_increasing_id()})
    marked = _fingerprints(read, ["row_no", "doc_id", "n_words"], lengths, window, k, context=True)
    # One more entry for each row keeps its word count when no fingerprint of it is found.
    # Its hash is the row's number, so that these entries are spread where the join shuffles.
    none = F.array(F.struct(F.lit(-1).alias("kind"), F.col("row_no").alias("h"), F.lit(-1).alias("p"),
                            F.array().cast("array<string>").alias("near")))
    marked = marked.select("row_no", "doc_id", "n_words", F.explode_outer(F.concat(none, "fps")).alias("f")).select(
        "row_no", "doc_id", "n_words", "f.*")
    found = marked.join(broadcast_if_small(grams, BROADCAST_FINGERPRINTS), ["kind", "h"], "left").filter("kind = -1 or met")
    found = stored(found.drop("h", "met"), "found")

    # The windows that hold the k-gram: from so many words before it, of so many words.
    length, ahead = F.when(F.col("kind") == 0, window).otherwise(F.col("kind")), F.least(F.when(F.col("kind") == 0, window - k).otherwise(0), "p")
    around = F.filter(F.transform(F.sequence(F.lit(0), ahead), lambda i: F.struct((F.col("p") - ahead + i).alias("at"), F.slice("near", i + 1, length).alias("ws"))),
                      lambda x: F.size(x["ws"]) == length)
    near = found.filter("kind >= 0").select("row_no", F.explode(around).alias("x")).select("row_no", "x.*").distinct()
    hits = near.withColumn("wh", _hash(F.col("ws"))).join(broadcast_if_small(windows, BROADCAST_WINDOWS), ["wh", "ws"]).select("row_no", "at", "ws")
    hits = stored(hits, "hits")
    listed = hits.select("row_no", "ws").distinct().join(parts, "ws").filter("item is not null").groupBy(F.col("row_no").alias("_row")).agg(F.array_sort(F.collect_set("item")).alias("items"))
    marks = hits.groupBy(F.col("row_no").alias("_at")).agg(F.collect_set(F.struct("at", F.size("ws").alias("n"))).alias("starts"))
    rows = found.filter("kind = -1").select("row_no", "doc_id", "n_words")
    rows = rows.join(marks, F.col("row_no") == F.col("_at"), "left").join(listed, F.col("row_no") == F.col("_row"), "left")
    spans = F.flatten(F.transform(F.coalesce("starts", F.array().cast("array<struct<at:int,n:int>>")), lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1)))
    return rows.select("doc_id", "n_words", F.array_sort(F.array_distinct(spans)).alias("hits"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def _hash(words_: Column) -> Column:
    return F.xxhash64(words_)


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those in which a window of a benchmark item occurs; all columns stay.

    Each row is judged by its own text: rows are matched by id and text, so clean rows that share their doc_id, null
    included, with a contaminated one stay. Texts of any length are judged whole. Null and empty texts stay, rows that repeat are each judged, whatever the names of other columns; an
    empty table gives no rows.
    """
    # One column holds the row, so no name of it can clash.
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("key"))
    hits = find_hits(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), benchmark)
    bad = hits.filter(F.size("hits") > 0).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(bad.hint("merge"), "key", "left_anti").select("row.*")


def digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``find_hits`` as counts, a digest of the item ids and a flag."""
    return find_hits(docs, benchmark).select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("hits").cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("hits") > 0).alias("contaminated"),
    )

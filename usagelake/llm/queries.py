"""The registered queries of the operators: thin readers of the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from usagelake.llm import byte_bpe, decontaminate, embedding_dedup, html_extract, lm_scoring, minhash, periodic_runs, pii, quality, secret_scan, sentencepiece, substring_dedup, vector_codes


#: The session's setting that holds the secret key of pseudonyms. Without it a key is used that only serves for test tables.
PII_KEY = "spark.usagelake.pii.key"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scoring.score(_table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digest(_table(spark, sf_dir, "documents"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(_table(spark, sf_dir, "documents"), spark.conf.get(PII_KEY, "key of the test tables"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.digest(_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.link(_table(spark, sf_dir, "embeddings"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(_table(spark, sf_dir, "documents"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(_table(spark, sf_dir, "embeddings"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.digest(_table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(periodic_runs.planted(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: v for k, v in globals().items() if k.startswith("op") and callable(v)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_WORDS = (
    "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

OP3_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
iw AS (SELECT item_id, least(10, len(w)) AS n, list_slice(w, s, s + least(10, len(w)) - 1) AS win
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS s FROM i WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, p, n, list_slice(w, p, p + n - 1) AS win
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, p, dw.n, item_id FROM dw JOIN iw ON dw.win = iw.win AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS pos FROM m) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
      string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM m GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON d.doc_id = h.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP6_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, p, list_slice(w, p, p + 34) AS win
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35)),
dup AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS pos FROM g JOIN dup USING (win)),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS pos FROM d),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed,
         string_agg(word, ' ' ORDER BY words.pos) FILTER (gone.pos IS NULL) AS kept
         FROM words LEFT JOIN gone ON words.doc_id = gone.doc_id AND words.pos = gone.pos GROUP BY words.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""


def _round(k: int) -> str:
    """Assigns the parts to the entries b{k} and averages them to b{k + 1}."""
    return f"""
n{k} AS (SELECT vec_id, p, any_value(part) AS part, arg_min(e, d * 256 + e) AS e, min(d) AS d
  FROM (SELECT vec_id, parts.p, part, e, CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(part, entry)]) AS BIGINT) AS d
        FROM parts JOIN b{k} ON parts.p = b{k}.p) GROUP BY vec_id, p),
m{k} AS (SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY i) AS entry
  FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS c
        FROM (SELECT p, e, unnest(part) AS x, unnest(range(1, len(part) + 1)) AS i FROM n{k}) GROUP BY p, e, i) GROUP BY p, e),
b{k + 1} AS (SELECT b{k}.p, b{k}.e, coalesce(m{k}.entry, b{k}.entry) AS entry FROM b{k} LEFT JOIN m{k} ON b{k}.p = m{k}.p AND b{k}.e = m{k}.e),"""


OP11_SQL = f"""
WITH kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
parts AS (SELECT vec_id, p, list_slice(v, 1 + p * len(v) // 4, (p + 1) * len(v) // 4) AS part FROM kept, range(4) AS r(p)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM kept),
b0 AS (SELECT p, e, part AS entry FROM parts JOIN first USING (vec_id) WHERE e < 256),{"".join(_round(k) for k in range(5))}
codes AS (SELECT vec_id, string_agg(lower(right('0' || to_hex(e), 2)), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM n4 GROUP BY vec_id),
books AS (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM b4)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM codes JOIN kept USING (vec_id), books
"""


OP7_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
good AS (SELECT * FROM v WHERE e IS NOT NULL AND len([x for x in e if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in e if x <> 0]) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id, vec_id AS r FROM v UNION SELECT reach.vec_id, p.b FROM reach JOIN p ON p.a = reach.r),
c AS (SELECT vec_id, min(r) AS component_id FROM reach GROUP BY 1), n AS (SELECT a AS vec_id, count(*) AS n FROM p GROUP BY 1)
SELECT v.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, v.vec_id = component_id AS kept FROM v JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

OP10_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT w, min(doc_id) AS id FROM d GROUP BY 1),
s AS (SELECT id, sh, count(*) AS c FROM (SELECT id, list_slice(w, p, p + least(5, len(w)) - 1) AS sh
  FROM (SELECT id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM t WHERE len(w) > 0)) GROUP BY ALL),
n AS (SELECT id, sum(c) AS n FROM s GROUP BY 1),
o AS (SELECT a.id AS a, b.id AS b, sum(least(a.c, b.c)) AS o FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE o >= 0.8 * (x.n + y.n - o)),
p AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT id, id AS r FROM t UNION SELECT reach.id, p.b FROM reach JOIN p ON p.a = reach.r),
c AS (SELECT id, min(r) AS class_id FROM reach GROUP BY 1)
SELECT doc_id, t.id AS text_id, class_id, doc_id = class_id AS kept FROM d JOIN t USING (w) JOIN c ON c.id = t.id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontaminate": OP3_SQL, "op6_substring_dedup": OP6_SQL, "op7_embedding_dedup": OP7_SQL, "op10_minhash_near_dedup": OP10_SQL, "op11_vector_codes": OP11_SQL}

"""op12: spelling variants of all words of all documents, some of them damaged by rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .spelling import LOWER, UPPER, letter_runs, spelling_variants

#: One occurrence of so many, by the remainder of its crc32, loses a letter.
ONE_IN = 97

#: The unsigned crc32 of a list of bytes, by the rule: a byte is mixed in, then eight bits are shifted out.
CRC32 = "xor(4294967295, list_reduce(list_prepend(4294967295, flatten(list_transform({bytes}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))), lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) ELSE xor(c >> 1, 3988292384 * (c & 1)) END))"
#: UTF-8 bytes of code points under 256, above 127 only from 192.
_BYTES = "flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [CAST(unicode(x) AS BIGINT)] ELSE [195, CAST(unicode(x) AS BIGINT) - 64] END))"

SQL = f"""
WITH RECURSIVE runs AS (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents
), counted AS (
    SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL
), hashed AS (
    SELECT *, {CRC32.format(bytes=_BYTES)} AS h FROM counted
), damaged AS (
    SELECT CASE WHEN h % {ONE_IN} = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed
), words AS (
    SELECT word, CAST(sum(c) AS BIGINT) AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3
), keys AS (
    SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: substring(word, 1, i - 1) || substring(word, i + 1))))) AS k FROM words
), met AS (
    SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word
    WHERE length(a.word) <> length(b.word) OR len(list_filter(range(1, length(a.word) + 1), lambda i: substring(a.word, i, 1) <> substring(b.word, i, 1))) = 1
), near AS (
    SELECT word, count(*) AS n_near, max(m) AS best FROM met GROUP BY word
), formed AS (
    SELECT met.word, min(other) AS form, any_value(m) AS form_n FROM met JOIN near ON met.word = near.word AND m = best WHERE m >= 2 * met.n GROUP BY met.word
), chain AS (
    SELECT word, word AS node, 0 AS steps FROM words
    UNION ALL
    SELECT chain.word, form, steps + 1 FROM chain JOIN formed ON formed.word = chain.node
), roots AS (
    SELECT word, arg_max(node, steps) AS root FROM chain GROUP BY word
)
SELECT words.word, form, root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN near ON words.word = near.word LEFT JOIN formed ON words.word = formed.word JOIN roots ON words.word = roots.word
"""


def damaged(runs: DataFrame) -> DataFrame:
    """(word): each run, without the code point at h % length where ONE_IN divides h, the crc32 of doc_id:run; a null doc_id is empty text."""
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    hashed = runs.select("run", h.alias("h"))
    return hashed.select(F.expr(f"CASE WHEN h % {ONE_IN} = 0 THEN concat(left(run, CAST(h % length(run) AS INT)), substring(run, CAST(h % length(run) AS INT) + 2)) ELSE run END").alias("word"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(damaged(letter_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))

"""op4: benchmark windows of ten words found in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .decontamination import decontaminate

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

SQL = f"""
WITH docs AS (
    SELECT doc_id, {_WORDS} AS w FROM documents
), items AS (
    SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS w FROM benchmark
), windows AS (
    SELECT item_id, least(10, len(w)) AS n, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS phrase
    FROM items WHERE len(w) > 0
), sizes AS (
    SELECT DISTINCT n FROM windows
), places AS (
    SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: {{'spot': i, 'phrase': array_to_string(w[i : i + n - 1], ' ')}})) AS p FROM docs, sizes WHERE len(w) >= n
), found AS (
    SELECT doc_id, item_id, places.n, p['spot'] AS spot FROM places JOIN windows ON windows.n = places.n AND windows.phrase = p['phrase']
), hit AS (
    SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(spot, spot + n)) AS k FROM found) GROUP BY doc_id
), listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM found) GROUP BY doc_id
)
SELECT docs.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit ON docs.doc_id = hit.doc_id LEFT JOIN listed ON docs.doc_id = listed.doc_id
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10)
    c = F.col("contamination")
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), c["n_hit"].alias("n_hit"), F.size(c["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(c["items"], ","), 256).alias("items_sha256"), (c["n_hit"] > 0).alias("contaminated"),
    )

"""op13: exact duplicates of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .chunk_dedup import LOWER, UPPER, exact_duplicates

SQL = f"""
WITH texts AS (
    SELECT doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents
)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM texts WINDOW same AS (PARTITION BY t)
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))

"""op6: Brown class-based scores of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .brown_lm import score_texts


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score_texts(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 7 != 2)

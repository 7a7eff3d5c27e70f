"""op9: quality of all documents by a factorisation machine, learned from labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .quality_fm import SAMPLE, SAMPLE_BYTES, score_quality, train
from .toxicity import fit, labelled_sample


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", SAMPLE, SAMPLE_BYTES), train)
    scored = score_quality(docs, model, into="score")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(0)) % 5 == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))

"""op2: licence notices and texts in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .license_scan import scan_licenses


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    m = F.col("licenses")
    return scan_licenses(docs).select(
        "doc_id", F.size(m).cast("long").alias("n_licenses"), F.array_join(F.transform(m, lambda x: x["license"]), ",").alias("licenses"),
        F.coalesce(F.array_max(F.transform(m, lambda x: x["dice"])), F.lit(0.0)).alias("best_dice"),
    )

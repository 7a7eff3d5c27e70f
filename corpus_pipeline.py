"""A training-data pipeline over documents: each stage is one operator of plumbline.llm, and the next one's input is its written output."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm._shared import Workspace
from plumbline.llm.byte_bpe import encode_documents
from plumbline.llm.decontamination import decontaminate
from plumbline.llm.ngram_join import similarity_components
from plumbline.llm.q_byte_bpe import digests
from plumbline.llm.quality_rules import score_quality
from plumbline.llm.toxicity import fit, labelled_sample, score_toxicity, train

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules' posterior keeps."""
    return score_quality(docs.select(*COLUMNS), into="quality").filter("quality.kept").select(*COLUMNS)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under a half; the machine learns from labelled documents of this stage's own input."""
    model = fit(labelled_sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "toxic"), train)
    return score_toxicity(docs.select(*COLUMNS), model, into="toxicity").filter("toxicity < 0.5").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of shingle sets (five words, 80 per cent): the one of the smallest doc_id.

    Documents without words are kept, and so are rows without a doc_id or that repeat the one kept.
    """
    joined = similarity_components(docs, width=5, percent=80)
    kept = joined.filter("component_id = doc_id OR doc_id IS NULL").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(kept.withColumnRenamed("doc_id", "kept_id"), F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the spans of benchmark windows cut out, and their new lengths."""
    clean = decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), width=10, remove=True)
    return clean.withColumn("n_chars", F.when(F.col("contamination.n_hit") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the bytes that they decode to."""
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, finish=digests, finished="n_tokens long, ids_sha256 string, decoded_sha256 string")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte-level BPE", byte_bpe),
]

#: Toxicity's training and the merges of byte pairs are beyond SQL; tests/llm hold their operators against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    work = Workspace(spark, "corpus-pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return docs

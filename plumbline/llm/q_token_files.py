"""op10: ids of all documents written to byte-plane files in doc_id order and read back."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._shared import Workspace
from .token_files import read_token_files, write_token_files

END_ID = 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), END_ID, Workspace(spark, "token-files"))
    return read_token_files(manifest, lambda ids: (zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes()),), "ids_crc32 long")

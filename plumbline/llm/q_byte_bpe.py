"""op8: byte-level BPE ids of all documents, and the bytes they decode to, as digests."""

from __future__ import annotations

from hashlib import sha256

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import ByteBPE, encode_documents


_NAMES: list[str] = []


def digests(ids: list[list[int]], bpe: ByteBPE) -> list[pa.Array]:
    if not _NAMES:
        _NAMES.extend(map(str, range(max(bpe.token) + 1)))
    name = _NAMES.__getitem__
    return [
        pa.array([len(x) for x in ids], pa.int64()),
        pa.array([sha256(",".join(map(name, x)).encode()).hexdigest() for x in ids], pa.string()),
        pa.array([sha256(bpe.decode(x)).hexdigest() for x in ids], pa.string()),
    ]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, finish=digests, finished="n_tokens long, ids_sha256 string, decoded_sha256 string")

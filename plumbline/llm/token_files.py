"""Token-id files: bit-plane shuffled blocks, zstandard, and a chunk index.

A file holds the ids of a run of documents.  Ids are cut into blocks of a fixed
size; a block's ids are transposed into planes (plane k holds bit k, or byte k,
of every id), empty high planes are left out and each other plane is compressed
alone.  Layout:

    magic | planes of all blocks | block index | document index | footer

The block index has a block's place, its number of ids and its planes' sizes;
the document index has doc_id, a null flag and the number of ids of each
document.  The footer has both indexes' places, so that any block can be read alone.
"""

from __future__ import annotations

import struct
import uuid
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..operators.scans import running
from ._bytes import slices
from ._shared import Workspace

MAGIC = b"PLANES01"
_FOOTER = struct.Struct("<QQQQB7x")
BLOCK = 1 << 16
#: Text bytes of one file, about.
FILE_TEXT = 16 << 20


def pack_block(ids: np.ndarray, planes: str, level: int) -> list[bytes]:
    """The compressed planes of a block of unsigned 32-bit ids, lowest first."""
    pack = zstandard.ZstdCompressor(level=level).compress
    top = int(ids.max()).bit_length() if len(ids) else 0
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [pack(np.ascontiguousarray(raw[:, k]).tobytes()) for k in range((top + 7) // 8)]
    bits = np.unpackbits(raw[:, : (top + 7) // 8], axis=1, bitorder="little")[:, :top]
    return [pack(row.tobytes()) for row in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]


def unpack_block(stored: list[bytes], n: int, planes: str) -> np.ndarray:
    unpack = zstandard.ZstdDecompressor().decompress
    raw = np.zeros((n, 4), dtype=np.uint8)
    if planes == "byte":
        for k, data in enumerate(stored):
            raw[:, k] = np.frombuffer(unpack(data), np.uint8)
    elif stored:
        bits = np.stack([np.unpackbits(np.frombuffer(unpack(data), np.uint8), count=n, bitorder="little") for data in stored], axis=1)
        packed = np.packbits(bits, axis=1, bitorder="little")
        raw[:, : packed.shape[1]] = packed
    return raw.reshape(-1).view("<u4")


class Writer:
    def __init__(self, sink, planes: str = "bit", block: int = BLOCK, level: int = 3):
        self.sink, self.planes, self.block, self.level = sink, planes, block, level
        self.at, self.index, self.held, self.size = len(MAGIC), [], [], 0
        self.ids, self.counts, self.total = [], [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.counts.append(len(ids))
        self.total += len(ids)
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= self.block:
            whole = np.concatenate(self.held)
            for k in range(0, self.size - self.block + 1, self.block):
                self._put(whole[k : k + self.block])
            rest = whole[self.size - self.size % self.block :]
            self.held, self.size = [rest], len(rest)

    def _put(self, ids: np.ndarray) -> None:
        stored = pack_block(ids, self.planes, self.level)
        self.index.append((self.at, len(ids), len(stored), *map(len, stored)))
        for data in stored:
            self.sink.write(data)
            self.at += len(data)

    def close(self) -> None:
        if self.size:
            self._put(np.concatenate(self.held))
        blocks = np.array([x for row in self.index for x in row], dtype="<u8").tobytes()
        null = np.array([x is None for x in self.ids], dtype=np.uint8)
        docs = zstandard.compress(np.array([x or 0 for x in self.ids], dtype="<i8").tobytes() + null.tobytes() + np.array(self.counts, dtype="<u8").tobytes())
        self.sink.write(blocks + docs + _FOOTER.pack(self.at, len(self.index), len(docs), len(self.ids), self.planes == "bit"))


@dataclass
class Reader:
    """Reads a file through `source` (with size(), seek() and read())."""

    source: pa.NativeFile

    def __post_init__(self):
        end = self.source.size()
        self.source.seek(end - _FOOTER.size)
        at, n_blocks, docs_size, n_docs, bit = _FOOTER.unpack(self.source.read(_FOOTER.size))
        self.planes = "bit" if bit else "byte"
        self.source.seek(at)
        flat = np.frombuffer(self.source.read(end - _FOOTER.size - docs_size - at), "<u8")
        self.blocks, k = [], 0
        for _ in range(n_blocks):
            n_planes = int(flat[k + 2])
            self.blocks.append((int(flat[k]), int(flat[k + 1]), [int(x) for x in flat[k + 3 : k + 3 + n_planes]]))
            k += 3 + n_planes
        docs = zstandard.decompress(self.source.read(docs_size))
        ids = np.frombuffer(docs[: 8 * n_docs], "<i8")
        null = np.frombuffer(docs[8 * n_docs : 9 * n_docs], np.uint8)
        self.ids = [None if x else int(i) for i, x in zip(ids, null)]
        self.counts = np.frombuffer(docs[9 * n_docs :], "<u8").astype(np.int64)

    def block(self, k: int) -> np.ndarray:
        at, n, sizes = self.blocks[k]
        self.source.seek(at)
        data = self.source.read(sum(sizes))
        cuts = np.concatenate([[0], np.cumsum(sizes)]).astype(int)
        return unpack_block([data[a:b] for a, b in zip(cuts[:-1], cuts[1:])], n, self.planes)

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        held, k = np.zeros(0, np.uint32), 0
        for doc_id, n in zip(self.ids, self.counts.tolist()):
            parts = [held]
            have = len(held)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            held = np.concatenate(parts) if len(parts) > 1 else held
            yield doc_id, held[:n]
            held = held[n:]


def _byte_letters() -> dict[int, str]:
    """The character that byte-level pre-tokenizers use for each byte: itself if printable, else the next one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordEncoder(dict):
    """The tokenizer library's ids of whole texts; each word between ASCII white space is encoded once and remembered.

    For byte-level tokenizers that lower-case, drop white space, never join over it and
    keep letters apart from punctuation.  A word of Latin-1 letters is one piece that
    normalisation only lower-cases, so it goes straight to the library's model; a run of
    plain punctuation at a word's end is a piece of its own.  All else takes the library's
    whole path.
    """

    REMEMBERED = 300_000
    _END = b".,!?:;#$%&*)]}"

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.tokenize = self.library.model.tokenize
        self.letters = {chr(b): "".join(_byte_letters()[x] for x in chr(b).encode()) for b in range(256)}

    def __missing__(self, word: bytes) -> bytes:
        head = word.rstrip(self._END)
        if head and len(head) < len(word) and head[-1:].isalnum():
            out = self[head] + self[word[len(head) :]]
        else:
            text = word.decode()
            if text.isalpha() and max(text) <= "\xff":
                text = text.lower()
                ids = [t.id for t in self.tokenize(text if text.isascii() else "".join(map(self.letters.__getitem__, text)))]
            else:
                ids = self.library.encode(text, add_special_tokens=False).ids
            out = array("I", ids).tobytes()
        self[word] = out
        return out

    def encode(self, texts: Iterable[bytes], end: int) -> list[np.ndarray]:
        if len(self) > self.REMEMBERED:
            self.clear()
        last = np.array([end], dtype="<u4").tobytes()
        return [np.frombuffer(b"".join(map(self.__getitem__, t.split())) + last, "<u4") for t in texts]


_ENCODERS: dict[str, WordEncoder] = {}


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, work: Workspace, planes: str = "byte", block: int = BLOCK, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Writes documents in ascending id order (nulls first; equal ids by a hash of their texts) and returns the manifest.

    The manifest (file, path, first, n_docs, n_ids) has a row per file of about 16 MB of text;
    `first` is the number of ids in all files before it.  A file is written under a
    temporary name and then moved, so a task that runs again leaves a whole file.
    Null text counts as empty: its document has the end id alone.  An empty table gives no file.
    """
    spark = docs.sparkSession
    base = docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text"))
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    folder = work.path("token-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = WordEncoder(tokenizer)
        encoder, number = _ENCODERS[tokenizer], TaskContext.get().partitionId()
        system, root = pyarrow.fs.FileSystem.from_uri(folder)
        writer = None
        for batch in batches:
            for piece in slices(batch):
                if writer is None:
                    system.create_dir(root)
                    temporary = f"{root}/.{number:08d}-{uuid.uuid4().hex}"
                    sink = system.open_output_stream(temporary)
                    writer = Writer(sink, planes, block)
                texts = [(t or "").encode() for t in piece.column(1).to_pylist()]
                for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.encode(texts, end_id)):
                    writer.add(doc_id, ids)
        if writer is not None:
            writer.close()
            sink.close()
            system.move(temporary, f"{root}/{number:08d}.planes")
            yield pa.RecordBatch.from_pydict({"file": [number], "path": [f"{folder}/{number:08d}.planes"], "n_docs": [len(writer.ids)], "n_ids": [writer.total]})

    # equal and null ids are dealt over files by their texts
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = base.repartitionByRange(max(1, -(-size // FILE_TEXT)), *order).sortWithinPartitions(*order)
    manifest = work.write(dealt.mapInArrow(run, "file long, path string, n_docs long, n_ids long"), "manifest")
    return running(manifest, [], "file", sums={"first": F.col("n_ids")}).withColumn("first", F.col("first") - F.col("n_ids"))


def read_token_files(manifest: DataFrame, describe=None, described: str = "ids array<int>") -> DataFrame:
    """(doc_id, start, n_tokens, ...) of each document of the files, read back block by block.

    `describe` turns a document's ids into a tuple of the columns named in `described`; by default the ids themselves.
    """
    schema = f"doc_id long, start long, n_tokens long, {described}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64()] * 3 + [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in described.split(", ")]
    files = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                system, root = pyarrow.fs.FileSystem.from_uri(path)
                rows: list[tuple] = []
                with system.open_input_file(root) as source:
                    for doc_id, ids in Reader(source).documents():
                        rows.append((doc_id, start, len(ids), *(describe(ids) if describe else (ids.astype(np.int32),))))
                        start += len(ids)
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return manifest.select("path", "first").repartition(max(1, files), "path").mapInArrow(run, schema)

"""Byte-level BPE encoding and decoding with padded numpy matrices.

Pieces (matches of the split pattern) of like length stand in the rows of one
matrix.  In each round every row merges its leftmost pair of least rank; pairs
are looked up in a hashed table, and finished rows leave the matrix.  A long piece
is a matrix of one row, which merges in one round all the pairs that come next
under that rule.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from ._bytes import slices

NONE = np.uint32(0xFFFFFFFF)
#: Pieces of more bytes are a matrix each, as the rows beside them would be padded to their length.
LONG = 512
#: Pieces that a worker remembers; beyond it, it begins anew.
REMEMBERED = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class PairTable:
    """(left id, right id) -> id of the joined token; open addressing over numpy arrays."""

    def __init__(self, pairs: dict[tuple[int, int], int]):
        key = np.array([(a << 32) | b for a, b in pairs] or [0], dtype=np.uint64)[: len(pairs)]
        value = np.array(list(pairs.values()), dtype=np.uint32)
        self.bits = max(4, (2 * max(1, len(pairs)) - 1).bit_length())
        self.keys = np.full(1 << self.bits, 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
        self.values = np.full(1 << self.bits, NONE, dtype=np.uint32)
        at, left = self._slot(key), np.arange(len(key))
        while len(left):
            free = self.keys[at[left]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            self.keys[at[left[free]]] = key[left[free]]
            won = self.keys[at[left]] == key[left]
            self.values[at[left[won]]] = value[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        at = self._slot(key)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], NONE)
        open_ = np.flatnonzero((found != key) & (found != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(open_):
            at[open_] = (at[open_] + 1) & ((1 << self.bits) - 1)
            found = self.keys[at[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[at[open_[hit]]]
            open_ = open_[~hit & (found != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


class ByteBPE:
    """encode() gives the ids that the rank file's own library would; decode() the bytes of ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.uint32)
        self.token = {rank: token for token, rank in ranks.items()}
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = rank
        self.joined = PairTable(pairs)
        self.known: dict[str, tuple[int, ...]] = {}

    def _long_row(self, piece: bytes) -> tuple[int, ...]:
        """One row: each round merges its pairs of least rank from the left, up to one that makes a pair of lesser rank (which comes next)."""
        ids = self.single[np.frombuffer(piece, np.uint8)]
        rank = self.joined(ids[:-1], ids[1:])
        while len(rank) and (least := rank.min()) != NONE:
            at = np.flatnonzero(rank == least)
            run = np.concatenate([[True], at[1:] != at[:-1] + 1])  # of pairs that overlap, every other one from the left
            first = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            joined = np.full(len(at), least, dtype=np.uint32)
            touching = np.concatenate([[False], at[1:] == at[:-1] + 2])
            before, after = np.full(len(at), NONE), np.full(len(at), NONE)
            has = at > 0
            before[has] = self.joined(np.where(touching[has], least, ids[at[has] - 1]), joined[has])
            has = at + 2 < len(ids)
            after[has] = self.joined(joined[has], ids[at[has] + 2])
            lesser = np.flatnonzero(np.minimum(before, after) < least)
            at = at[: lesser[0] + 1] if len(lesser) else at
            ids[at] = least
            kept = np.ones(len(ids), dtype=bool)
            kept[at + 1] = False
            ids = ids[kept]
            rank = np.append(rank, NONE)[kept][:-1]
            at = at - np.arange(len(at))
            new = np.unique(np.concatenate([at - 1, at]))
            new = new[(new >= 0) & (new < len(rank))]
            rank[new] = self.joined(ids[new], ids[new + 1])
        return tuple(ids.tolist())

    def _in_matrix(self, pieces: Sequence[bytes], out: dict[bytes, tuple[int, ...]]) -> None:
        width = max(map(len, pieces))
        length = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(len(pieces), width)
        ids = self.single[raw]
        ids[np.arange(width) >= length[:, None]] = NONE
        row = np.arange(len(pieces))

        def look(left, right):
            got = np.full(left.shape, NONE, dtype=np.uint32)
            there = right != NONE  # padding stands at the end
            got[there] = self.joined(left[there], right[there])
            return got

        rank = look(ids[:, :-1], ids[:, 1:]) if width > 1 else np.zeros((len(pieces), 0), np.uint32)
        while len(row):
            at = rank.argmin(axis=1) if rank.shape[1] else np.zeros(len(row), np.int64)
            least = rank[np.arange(len(row)), at] if rank.shape[1] else np.full(len(row), NONE)
            going = least != NONE
            for k in np.flatnonzero(~going):
                out[pieces[row[k]]] = tuple(ids[k][ids[k] != NONE].tolist())
            ids, rank, row, at, least = ids[going], rank[going], row[going], at[going], least[going]
            if not len(row):
                break
            every = np.arange(len(row))
            ids[every, at] = least
            kept = np.arange(ids.shape[1] - 1)
            ids = np.take_along_axis(ids, kept + (kept > at[:, None]), axis=1)
            kept = np.arange(rank.shape[1] - 1)
            rank = np.take_along_axis(rank, kept + (kept >= at[:, None]), axis=1)
            if rank.shape[1]:
                some = at < rank.shape[1]
                rank[every[some], at[some]] = look(ids[every[some], at[some]], ids[every[some], at[some] + 1])
                some = at > 0
                rank[every[some], at[some] - 1] = look(ids[every[some], at[some] - 1], ids[every[some], at[some]])

    def encode_pieces(self, pieces: Iterable[bytes]) -> dict[bytes, tuple[int, ...]]:
        out: dict[bytes, tuple[int, ...]] = {}
        buckets: dict[int, list[bytes]] = {}
        for p in pieces:
            if (whole := self.ranks.get(p)) is not None:
                out[p] = (whole,)
            elif len(p) > LONG:
                out[p] = self._long_row(p)
            else:
                buckets.setdefault((len(p) + 3) // 4, []).append(p)
        for size, rows in buckets.items():
            most = max(1, (1 << 19) // (4 * size))
            for k in range(0, len(rows), most):
                self._in_matrix(rows[k : k + most], out)
        return out

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        split = [self.find(t) for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        fresh = set(chain.from_iterable(split)) - self.known.keys()
        if fresh:
            coded = self.encode_pieces(p.encode() for p in fresh)
            self.known.update((p, coded[p.encode()]) for p in fresh)
        get = self.known.__getitem__
        return [list(chain.from_iterable(map(get, s))) for s in split]

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_LOADED: dict[tuple[str, str], ByteBPE] = {}


def codec(path: str, pattern: str) -> ByteBPE:
    """The codec of a rank file; each worker builds it once."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE(read_ranks(path), pattern)
    return _LOADED[path, pattern]


def _as_ids(ids: list[list[int]], bpe: ByteBPE) -> list[pa.Array]:
    return [pa.array(ids, pa.list_(pa.int32()))]


def encode_documents(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text", finish: Callable[[list[list[int]], ByteBPE], list[pa.Array]] = _as_ids, finished: str = "ids array<int>") -> DataFrame:
    """(id, ids) of each row; `finish` may turn ids into other columns (named in `finished`) on the executors.

    Null text counts as empty and has no ids.  Rows keep their order and number; no
    column but the two is read, so others may have any name.  The rank file must be
    at `path` on every executor.
    """
    base = docs.select(docs[id_column], docs[text_column].alias("text"))
    names = [x.split()[0] for x in finished.split(", ")]
    kind = dict(base.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for piece in slices(batch):
                ids = bpe.encode([t or "" for t in piece.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([piece.column(0), *finish(ids, bpe)], names=[id_column, *names])

    return base.mapInArrow(run, f"`{id_column}` {kind}, {finished}")


def decode_documents(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """(id, bytes) of encoded rows; null ids give null."""
    base = encoded.select(encoded[id_column], encoded[ids_column])
    kind = dict(base.dtypes)[id_column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()], pa.binary())], names=[id_column, "bytes"])

    return base.mapInArrow(run, f"`{id_column}` {kind}, bytes binary")

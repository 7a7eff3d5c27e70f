"""URL filters: path rules, and exact list membership by a cascade of Bloom filters.

Level 0 encodes the listed keys.  Level 1 encodes the keys of the corpus's complete
universe that level 0 lets through wrongly, level 2 the listed keys that level 1 lets
through, and so on until no key is wrong.  The first level that refuses a key tells
whether it is listed, without a join and without the keys themselves.  Keys are
128-bit hashes, dealt to shards of about a million, each with a cascade of its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.scans import unused
from ._shared import Workspace

U64 = np.uint64
#: Keys of one shard, about; and the most bytes of cascades that are broadcast at once.
SHARD_KEYS = 1_000_000
BROADCAST_BYTES = 64 << 20
#: Bits per key of the first level (false positives 1 in 100) and of the later ones (1 in 10), with their numbers of hashes.
FIRST, LATER = (9.6, 7), (4.8, 3)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null or without `://`.  The host's A-Z are lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))


@dataclass(frozen=True)
class Rule:
    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def matched_rule(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """(name, action) of the longest rule that fits: the host or a subdomain of it, and a path that begins with the rule's; else nulls."""
    name = action = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, action = F.when(fits, F.lit(rule.name)).otherwise(name), F.when(fits, F.lit(rule.action)).otherwise(action)
    return name, action


def host_keys(host: Column) -> Column:
    """The host and every parent domain of it; none for an empty host."""
    labels = F.split(host, r"\.")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), ".")))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit("second"), key)


def _places(a: np.ndarray, b: np.ndarray, level: int, bits: int, hashes: int) -> np.ndarray:
    step = (b ^ U64((0x9E3779B97F4A7C15 * (level + 1)) & (2**64 - 1))) | U64(1)
    mixed = (a[:, None] + step[:, None] * np.arange(1, hashes + 1, dtype=np.uint64)) * U64(0xD6E8FEB86659FD93)
    return (mixed >> U64(29)) % U64(bits)  # high bits depend on all bits of a and b, so no two keys agree on every level


def _level(a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    per_key, hashes = FIRST if level == 0 else LATER
    out = np.zeros((max(64, int(per_key * len(a))) + 7) // 8, dtype=np.uint8)
    place = _places(a, b, level, len(out) * 8, hashes).ravel()
    np.bitwise_or.at(out, (place >> U64(3)).astype(np.int64), (U64(1) << (place & U64(7))).astype(np.uint8))
    return out


def _passes(bits: np.ndarray, a: np.ndarray, b: np.ndarray, level: int) -> np.ndarray:
    place = _places(a, b, level, len(bits) * 8, (FIRST if level == 0 else LATER)[1])
    return ((bits[(place >> U64(3)).astype(np.int64)] >> (place & U64(7)).astype(np.uint8)) & 1).astype(bool).all(axis=1)


def build_levels(a: np.ndarray, b: np.ndarray, listed: np.ndarray) -> list[np.ndarray]:
    """The cascade of distinct keys (a, b), exact on all of them."""
    levels: list[np.ndarray] = []
    members, others = np.flatnonzero(listed), np.flatnonzero(~listed)
    while len(members):
        level = len(levels)
        levels.append(_level(a[members], b[members], level))
        members, others = others[_passes(levels[-1], a[others], b[others], level)], members
    return levels


def is_listed(levels: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact for keys of the universe."""
    out, going = np.zeros(len(a), dtype=bool), np.arange(len(a))
    for level, bits in enumerate(levels):
        passed = _passes(bits, a[going], b[going], level)
        out[going] = passed if level % 2 == 0 else ~passed
        going = going[passed]
    return out


def build_cascades(universe: DataFrame, listed: DataFrame, key: str = "key") -> DataFrame:
    """(shard, levels) for all keys of both tables, in a written table; null keys are left out.

    `listed` keys need not be in the universe; repeated keys count once, and keys of any length by their 128 bits of hash.
    Without keys there are no shards, and nothing is listed. Other columns are not read.
    """
    work = Workspace(universe.sparkSession, "url-cascade")
    keys = universe.select(F.col(key).alias("k"), F.lit(False).alias("in_list")).unionByName(listed.select(F.col(key).alias("k"), F.lit(True).alias("in_list"))).filter("k is not null")
    a, b = _hashes(F.col("k"))
    hashed = work.write(keys.select(a.alias("a"), b.alias("b"), "in_list").groupBy("a", "b").agg(F.max("in_list").alias("in_list")), "keys")
    shards = max(1, -(-hashed.count() // SHARD_KEYS))

    def build(table: pa.Table) -> pa.Table:
        own = table.sort_by([("a", "ascending"), ("b", "ascending")])
        levels = build_levels(own.column("a").to_numpy().view(np.uint64), own.column("b").to_numpy().view(np.uint64), own.column("in_list").to_numpy())
        return pa.table({"shard": pa.array([own.column("shard")[0].as_py()], pa.int32()), "levels": pa.array([[x.tobytes() for x in levels]], pa.list_(pa.binary()))})

    dealt = hashed.withColumn("shard", F.pmod(F.xxhash64("b"), F.lit(shards)).cast("int"))
    built = work.write(dealt.groupBy("shard").applyInArrow(build, "shard int, levels array<binary>"), "cascades")
    work.drop("keys")
    return built


def any_listed(df: DataFrame, keys_column: str, cascades: DataFrame, into: str = "listed") -> DataFrame:
    """df with a boolean column `into` (which replaces one of that name): whether any of the keys in an array column is listed.

    Null or empty arrays, and null keys in them, are not; repeated rows are judged alike, an empty table stays empty.
    Cascades are broadcast in blocks of a bounded size, one at a time: between two blocks the rows are written to the
    shared folder, and the block before is given up.
    """
    work = Workspace(df.sparkSession, "url-blocks")
    sizes = cascades.select("shard", F.aggregate("levels", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("bytes")).orderBy("shard").collect()
    shards = 1 + max((r["shard"] for r in sizes), default=-1)
    blocks: list[list[int]] = []
    room = 0
    for r in sizes:
        if not blocks or r["bytes"] > room:
            blocks.append([])
            room = BROADCAST_BYTES
        blocks[-1].append(r["shard"])
        room -= r["bytes"]
    out = df.drop(into).withColumn(into, F.lit(False))
    names = out.columns
    keyed = unused(names, "keys")
    at = names.index(into)
    held = None
    for number, block in enumerate(blocks):
        if number:
            out = work.write(out, f"block-{number}")
            held.destroy()
            work.drop(f"block-{number - 1}")
        rows = cascades.filter(F.col("shard").isin(block)).collect()
        held = df.sparkSession.sparkContext.broadcast({r["shard"]: [np.frombuffer(x, np.uint8) for x in r["levels"]] for r in rows})

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = batch.column(len(names))
                flat = keys.flatten()
                a, b = (flat.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                shard = flat.field(2).to_numpy(zero_copy_only=False)
                hit = np.zeros(len(a), dtype=bool)
                for which, levels in held.value.items():
                    own = np.flatnonzero(shard == which)
                    if len(own):
                        hit[own] = is_listed(levels, a[own], b[own])
                bounds = np.concatenate([[0], np.cumsum([0 if n is None else n for n in keys.value_lengths().to_pylist()])])
                running = np.concatenate([[0], np.cumsum(hit)])
                found = (running[bounds[1:]] > running[bounds[:-1]]) | batch.column(at).to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(found) if k == at else batch.column(k) for k in range(len(names))], names=names)

        hashes = lambda x: F.struct(_hashes(x)[0].alias("a"), _hashes(x)[1].alias("b"), F.pmod(F.xxhash64(_hashes(x)[1]), F.lit(shards)).cast("int").alias("s"))
        asked = F.array_compact(F.coalesce(F.col(f"`{keys_column}`"), F.array().cast("array<string>")))
        hashed = out.withColumn(keyed, F.transform(asked, hashes))
        out = hashed.select(*(f"`{n}`" for n in names), keyed).mapInArrow(run, out.schema)
    return out

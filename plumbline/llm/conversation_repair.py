"""Repair of conversations' role structure at the least cost, by a lazily determinised weighted automaton.

The grammar of role initials is `(s?(ua)+)?`, an automaton of four states.  Reading a
conversation's rows, each state has a cost: that of the cheapest edits so far that lead
to it.  The vector of the four costs, less its smallest, is one state of the
deterministic automaton; its moves are worked out when they are first needed and kept
in a table.  Scanning a conversation is then a table lookup for each row, which adds up
the cost; a trace back from the end marks the states that tight arcs (arcs whose cost
is the difference of both ends') connect to the best end, and reading the marked arcs
from the front, the least letter first, gives the audit.

How the work is dealt out: rows that are equal in all four columns are counted first;
of each role and text the least turn is found by aggregation; rows without their texts
are sorted over ranges, so that a long conversation lies in many partitions, and each
of those gives its rows of a conversation as one string of symbols, a byte a row.  Only
these strings meet by conversation, as its audit, a letter a row, is one value anyway.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._shared import Workspace

INF = 1 << 40
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Grammar states: 0 nothing yet, 1 behind s, 2 behind u, 3 behind ua. What leads where by the initial of the role put there.
MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
ENDS = (0, 3)
#: What 0 and 1 can still become, 3 can at no more than this (a first s is deleted): dearer by more, they are on no cheapest way and are dropped, so that vectors are few.
SLACK = {0: DELETE, 1: 0}
ROLES = {2: "user", 3: "assistant"}
#: A row's symbol is a letter: role class (s, u, a, other) * 4 + fault (none, blank, duplicate, truncated) from A; lower case for the further copies of the row before.
CLASSES, NONE, BLANK, DUPLICATE, CUT = "suao", 0, 1, 2, 3
SPACE = " \t\n\x0b\x0c\r"


class Determinised:
    """The deterministic automaton as far as it was needed, and the tables of its traces."""

    def __init__(self) -> None:
        self.index: dict[tuple[int, ...], int] = {}
        self.vectors: list[tuple[int, ...]] = []
        self.table: list[list[tuple[int, int] | None]] = []
        self.backward: dict[tuple[int, int, int], int] = {}
        self.forward: dict[tuple[int, int, int, int, int], tuple[str, int]] = {}
        self.start, _ = self.state([0, INF, INF, INF])

    def state(self, costs: list[int]) -> tuple[int, int]:
        """The state of these costs after any insertions, and what was taken off all of them."""
        for _ in MOVES:  # no chain of insertions is longer
            for role in ("u", "a"):
                for p, q in MOVES[role].items():
                    costs[q] = min(costs[q], costs[p] + INSERT)
        costs = [INF if c > costs[3] + SLACK.get(q, c) else c for q, c in enumerate(costs)]
        least = min(costs)
        vector = tuple(c - least if c < INF else INF for c in costs)
        if vector not in self.index:
            self.index[vector] = len(self.vectors)
            self.vectors.append(vector)
            self.table.append([None] * 16)
        return self.index[vector], least

    @staticmethod
    def arcs(symbol: int) -> list[tuple[str, int, int, int]]:
        """(letter, from, to, cost) of the edits that use up a row."""
        kind, fault = divmod(symbol, 4)
        found = [("D", p, p, DELETE) for p in range(4)]
        if fault in (NONE, CUT):
            more = TRUNCATED * (fault == CUT)
            found += [("K", p, q, KEEP + more) for p, q in MOVES[CLASSES[kind]].items()]
            found += [("R", p, q, REROLE + more) for role in ("u", "a") for p, q in MOVES[role].items()]
        return found

    def move(self, state: int, symbol: int) -> tuple[int, int]:
        if self.table[state][symbol] is None:
            costs, v = [INF] * 4, self.vectors[state]
            for _, p, q, cost in self.arcs(symbol):
                costs[q] = min(costs[q], v[p] + cost)
            self.table[state][symbol] = self.state(costs)
        return self.table[state][symbol]

    def inserts(self, state: int, mask: int) -> int:
        """The mask with all states from which tight insertions lead into it."""
        v = self.vectors[state]
        for _ in MOVES:
            for role in ("u", "a"):
                for p, q in MOVES[role].items():
                    if mask >> q & 1 and v[p] + INSERT == v[q] < INF:
                        mask |= 1 << p
        return mask

    def behind(self, state: int, symbol: int, mask: int) -> int:
        """The marked states before a row, from those behind it."""
        key = (state, symbol, mask)
        if key not in self.backward:
            (after, off), v, found = self.move(state, symbol), self.vectors[state], 0
            for _, p, q, cost in self.arcs(symbol):
                if mask >> q & 1 and v[p] < INF and v[p] + cost == off + self.vectors[after][q]:
                    found |= 1 << p
            self.backward[key] = self.inserts(state, found)
        return self.backward[key]

    def insertion(self, state: int, mask: int, p: int) -> int | None:
        """The state that a tight insertion at p leads to, if it is marked."""
        v = self.vectors[state]
        return next((q for role in ("u", "a") for x, q in MOVES[role].items() if x == p and mask >> q & 1 and v[p] + INSERT == v[q]), None)

    def read(self, state: int, symbol: int, mask: int, next_mask: int, p: int) -> tuple[str, int]:
        """The least letters up to and with the one that uses up the row, and the state behind them."""
        key = (state, symbol, mask, next_mask, p)
        if key not in self.forward:
            (after, off), v, said, at = self.move(state, symbol), self.vectors[state], "", p
            while True:
                tight = {letter: q for letter, x, q, cost in self.arcs(symbol) if x == at and next_mask >> q & 1 and v[at] + cost == off + self.vectors[after][q]}
                inserted = self.insertion(state, mask, at)
                letter = min([*tight, *["I"] * (inserted is not None)])
                said += letter
                if letter != "I":
                    self.forward[key] = said, tight[letter]
                    break
                at = inserted
        return self.forward[key]

    def repair(self, symbols: bytes) -> tuple[int, Iterator[str]]:
        """The least cost for symbols of 0 to 15, and the audit in parts: one for each row and one behind the last."""
        path, cost, state, table = array("I", [self.start]), 0, self.start, self.table
        for x in symbols:
            state, off = table[state][x] or self.move(state, x)
            cost += off
            path.append(state)
        v = self.vectors[state]
        best = min(v[q] for q in ENDS)
        masks = bytearray(len(path))
        masks[-1] = mask = self.inserts(state, sum(1 << q for q in ENDS if v[q] == best))
        for i in range(len(symbols) - 1, -1, -1):
            masks[i] = mask = self.behind(path[i], symbols[i], mask)

        def audit() -> Iterator[str]:
            p = 0
            for i, x in enumerate(symbols):
                said, p = self.forward.get((path[i], x, masks[i], masks[i + 1], p)) or self.read(path[i], x, masks[i], masks[i + 1], p)
                yield said
            rest = ""
            while not (p in ENDS and v[p] == best):
                rest, p = rest + "I", self.insertion(state, masks[-1], p)
            yield rest

        return cost + best, audit()


def _found(batches: Iterator[pa.RecordBatch], schema: pa.Schema, most: int = 65_536) -> Iterator[pa.RecordBatch]:
    """For each (conv, pieces of (gid, symbols)) a row of counts with the audit, and rows (gid, pos, role) of what is put in its repaired place."""
    machine = Determinised()
    plain = bytes((x - 65 if x < 97 else x - 97) if 65 <= x < 81 or 97 <= x < 113 else 0 for x in range(256))
    follows = {("s", "u"), ("u", "a"), ("a", "u")}
    out: list[tuple] = []
    for batch in batches:
        for conv, pieces in zip(batch.column("conv"), batch.column("pieces")):
            letters = b"".join(piece["symbols"].as_py().encode() for piece in pieces.values)
            symbols = letters.translate(plain)
            faults = symbols.translate(bytes(x % 4 for x in range(256)))
            kinds = symbols.translate(bytes(ord(CLASSES[x // 4 % 4]) for x in range(256))).decode()
            pairs = sum(kinds.count(a + b) for a, b in follows)  # two of these never overlap within one kind
            cost, parts = machine.repair(symbols)
            begins = iter([*accumulate((len(piece["symbols"].as_py()) for piece in pieces.values), initial=0)][:-1])
            gids = (piece["gid"].as_py() for piece in pieces.values)
            conv, audit, pos, state, gid, begin = conv.as_py(), [], 0, 0, -1, next(begins)
            for i, part in enumerate(parts):
                if i == begin:
                    gid, begin = next(gids) - 1, next(begins, -1)
                gid += i < len(letters) and letters[i] < 97
                audit.append(part)
                for letter in part:
                    if letter == "D":
                        continue
                    role = CLASSES[symbols[i] // 4] if letter == "K" else "a" if state == 2 else "u"
                    state = MOVES[role][state]
                    out.append((conv, None, None, None, None, None, None, None if letter == "I" else gid, pos, None if letter == "K" else ROLES[state]))
                    pos += 1
                if len(out) >= most:
                    yield _batch(out, schema)
                    out = []
            count = [faults.count(x) for x in (BLANK, DUPLICATE, CUT)]
            out.append((conv, *count, max(0, len(symbols) - 1) - pairs, cost, "".join(audit), None, None, None))
    if out:
        yield _batch(out, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)


_COLUMNS = "blank long, duplicate long, truncated long, illegal long, cost long, audit string, gid long, pos long, new_role string"


@dataclass
class Repaired:
    """summary: (conv, gaps, blank, duplicate, truncated, illegal, cost, audit); rows: (conv, pos, role, text), pos from 0."""

    summary: DataFrame
    rows: DataFrame


def repair_conversations(rows: DataFrame) -> Repaired:
    """The cheapest repair of every conversation of rows (conv long, turn long, role, text).

    A conversation's rows are taken by turn, nulls first; rows of one turn by role and then by the SHA-256 of role and text,
    by which (role, text) are compared. A row's first fault counts: blank text, role and text seen before, no end of a
    sentence at its end. Kept rows cost 0, rows made user or assistant 2, deleted rows 3 (blank and repeated rows must be),
    inserted empty rows of a user or assistant 2, undeleted cut rows 1 more. Of the cheapest edits the audit (their initials)
    is the least in ASCII. A null role or text is one space, a null conv is a conversation of its own, null turns come
    first and count in no gap. Rows that are equal in all columns are copies, all but the first of which are repeated.
    Without rows both results are empty; further columns are not read. Texts are never gathered by conversation.
    """
    spark, work = rows.sparkSession, Workspace(rows.sparkSession, "conversations")
    filled = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    counted = filled.groupBy("conv", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    distinct = work.write(counted.withColumn("key", F.unhex(F.sha2(F.concat("role", F.lit("\0"), "text"), 256))), "distinct")
    last = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    kind = F.expr("CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END")
    fault = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), CUT).otherwise(NONE)
    light = distinct.select("conv", "turn", "role", "key", "n", (kind * 4).alias("kind"), fault.alias("fault"))
    # of each role and text the row of the least turn is the first; a row learns it by a sum over its own key
    order = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = light.groupBy("conv", "role", "key").agg(F.min(order).alias("o")).select("conv", F.col("o.turn").alias("turn"), "role", "key", F.lit(0).cast("long").alias("n"), F.lit(0).alias("kind"), F.lit(0).alias("fault"), F.lit(1).alias("first"))
    marked = light.withColumn("first", F.lit(0)).unionByName(first).groupBy("conv", "turn", "role", "key").agg(*(F.sum(c).alias(c) for c in ("n", "kind", "fault", "first")))
    symbol = lambda fault, base: F.char(F.col("kind") + fault + base)
    begin = F.when((F.col("fault") != BLANK) & (F.col("first") == 0), DUPLICATE).otherwise(F.col("fault"))
    again = F.when(F.col("fault") == BLANK, BLANK).otherwise(DUPLICATE)
    marked = marked.withColumn("symbols", F.concat(symbol(begin, 65), F.repeat(symbol(again, 97), F.least(F.col("n") - 1, F.lit(2**31 - 1)).cast("int"))))
    by = ["conv", F.col("turn").asc_nulls_first(), "role", "key"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = marked.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("gid", F.monotonically_increasing_id())
    placed = work.write(placed.select("conv", "turn", "role", "key", "symbols", "gid"), "placed")
    # a partition's rows of a conversation are one piece, and have consecutive numbers
    pieces = placed.groupBy("conv", F.shiftright("gid", 33).alias("piece")).agg(F.sort_array(F.collect_list(F.struct("gid", "symbols"))).alias("x"))
    pieces = pieces.select("conv", F.struct(F.col("x")[0]["gid"].alias("gid"), F.array_join(F.col("x")["symbols"], "").alias("symbols")).alias("piece"))
    whole = pieces.groupBy("conv").agg(F.sort_array(F.collect_list("piece")).alias("pieces"))
    kind_of = rows.schema["conv"].dataType.simpleString()
    to = f"conv {kind_of}, {_COLUMNS}"
    schema = spark.createDataFrame([], to).toArrow().schema
    found = work.write(whole.mapInArrow(lambda batches: _found(batches, schema), to), "found")
    turns = placed.select("conv", "turn").distinct().groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    summary = found.filter("audit IS NOT NULL").select("conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    same = summary["conv"].eqNullSafe(turns["conv"])
    summary = summary.join(turns, same).select(summary["conv"], "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    acts = found.filter("audit IS NULL")
    a, p, d = acts.filter("gid IS NOT NULL").alias("a"), placed.alias("p"), distinct.alias("d")
    kept = a.join(p, F.col("a.gid") == F.col("p.gid")).select("p.conv", "p.turn", "p.role", "p.key", "a.pos", "a.new_role").alias("k")
    equal = (F.col("k.key") == F.col("d.key")) & (F.col("k.role") == F.col("d.role")) & F.col("k.conv").eqNullSafe(F.col("d.conv")) & F.col("k.turn").eqNullSafe(F.col("d.turn"))
    kept = kept.join(d, equal).select("k.conv", "k.pos", F.coalesce("k.new_role", "d.role").alias("role"), "d.text")
    inserted = acts.filter("gid IS NULL").select("conv", "pos", F.col("new_role").alias("role"), F.lit("").alias("text"))
    return Repaired(summary, kept.unionByName(inserted))


def _streamed(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    from hashlib import sha256

    def rows() -> Iterator[tuple]:
        for batch in batches:
            yield from zip(batch.column("conv").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist())

    out: list[tuple] = []
    for conv, group in groupby(rows(), key=lambda r: r[0]):
        hasher, between = sha256(), ""
        for _, role, text in group:
            hasher.update(f"{between}{role}:{text}".encode())
            between = "\n"
        out.append((conv, hasher.hexdigest()))
        if len(out) >= 10_000:
            yield _batch(out, schema)
            out = []
    if out:
        yield _batch(out, schema)


def transcript_digests(rows: DataFrame) -> DataFrame:
    """(conv, sha256) of each conversation's `role:text`, newline-joined by pos, from rows (conv, pos, role, text).

    A digest is worked out in one pass over its conversation in order, which one task streams; none is held.
    """
    to = f"conv {rows.schema['conv'].dataType.simpleString()}, sha256 string"
    schema = rows.sparkSession.createDataFrame([], to).toArrow().schema
    return rows.repartition("conv").sortWithinPartitions("conv", "pos").mapInArrow(lambda batches: _streamed(batches, schema), to)

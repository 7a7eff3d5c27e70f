"""op11: all conversations, damaged by rule and repaired."""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession, functions as F

from .conversation_repair import repair_conversations, transcript_digests
from .q_spelling import CRC32

_BYTES = "list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(unicode(x) AS BIGINT))"
_FAR = 1_000_000_000


def _sql() -> str:
    """Cheapest (cost, audit, lines) for each state of the grammar, row by row."""

    def arc(state: int, cost: str, letter: str, line: str | None = None, when: str = "true") -> str:
        s = f"s{state}"
        lines = f"list_append({s}.t, {line})" if line else f"{s}.t"
        return f"{{'c': {s}.c + CASE WHEN {when} THEN {cost} ELSE {_FAR} END, 'a': {s}.a || '{letter}', 't': {lines}}}"

    def put(state: int, role: str, letter: str) -> list[str]:
        kept = arc(state, "cut", "K", "role || ':' || text", f"NOT gone AND left(role, 1) = '{letter}'")
        return [kept, *([arc(state, "2 + cut", "R", f"'{role}:' || text", "NOT gone")] if role else [])]

    def best(*options: str) -> str:
        return f"list_min([{', '.join(options)}])"

    deleted = [arc(k, "3", "D") for k in range(4)]
    insert = lambda state, role: arc(state, "2", "I", f"'{role}:'")
    rows = f"""SELECT conv_id, i, {deleted[0]} AS s0, {best(deleted[1], *put(0, "", "s"))} AS s1,
        {best(deleted[2], *(x for k in (0, 1, 3) for x in put(k, "user", "u")))} AS s2, {best(deleted[3], *put(2, "assistant", "a"))} AS s3
        FROM (SELECT faults.*, s0, s1, s2, s3 FROM paths JOIN faults ON faults.conv_id IS NOT DISTINCT FROM paths.conv_id AND faults.i = paths.i + 1)"""
    user = f"SELECT conv_id, i, s0, s1, {best('s2', *(insert(k, 'user') for k in (0, 1, 3)))} AS s2, s3 FROM ({rows})"
    none = f"{{'c': {_FAR}, 'a': '', 't': CAST([] AS VARCHAR[])}}"
    return f"""
WITH RECURSIVE hashed AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {CRC32.format(bytes=_BYTES)} % 20 AS h FROM conversations
), damaged AS (
    SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
        unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy FROM hashed WHERE h <> 0
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(role || chr(0) || text)) AS i,
        CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS k, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS is_blank FROM damaged
), repeats AS (
    SELECT *, NOT is_blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS is_dup, lag(k) OVER (PARTITION BY conv_id ORDER BY i) || k AS pair FROM ordered
), faults AS (
    SELECT *, is_blank OR is_dup AS gone, CASE WHEN is_blank OR is_dup OR regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 0 ELSE 1 END AS cut FROM repeats
), counted AS (
    SELECT conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_dup) AS duplicate, sum(cut) AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY conv_id
), paths AS (
    SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': 0, 'a': '', 't': CAST([] AS VARCHAR[])}} AS s0, {none} AS s1, {{'c': 2, 'a': 'I', 't': ['user:']}} AS s2, {{'c': 4, 'a': 'II', 't': ['user:', 'assistant:']}} AS s3 FROM counted
    UNION ALL
    SELECT conv_id, i, s0, s1, s2, {best('s3', insert(2, 'assistant'))} AS s3 FROM ({user})
), ends AS (
    SELECT counted.*, list_min([s0, s3]) AS e FROM paths JOIN counted ON paths.conv_id IS NOT DISTINCT FROM counted.conv_id AND i = n
)
SELECT every.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate,
    CAST(coalesce(truncated, 0) AS BIGINT) AS truncated, CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit,
    sha256(coalesce(array_to_string(e.t, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) every LEFT JOIN ends ON every.conv_id IS NOT DISTINCT FROM ends.conv_id
"""


SQL = _sql()


def damaged(rows: DataFrame) -> DataFrame:
    """(conv, turn, role, text): rows (conv_id, turn, role, text) by h, the crc32 of conv_id:turn, modulo 20; nulls are one space, but in conv and turn."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    h = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    hashed = rows.select(F.col("conv_id").alias("conv"), "turn", known("role").alias("role"), known("text").alias("text"), h.alias("h")).filter("h <> 0")
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    once = hashed.select("conv", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.when(F.col("h") == 3, 2).otherwise(1).alias("times"))
    return once.select("conv", "turn", "role", "text", F.explode(F.sequence(F.lit(1), "times"))).drop("col")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    every, found = rows.select("conv_id").distinct(), repair_conversations(damaged(rows))
    s, d = found.summary.alias("s"), transcript_digests(found.rows).alias("d")
    joined = every.join(s, every["conv_id"].eqNullSafe(F.col("s.conv")), "left").join(d, every["conv_id"].eqNullSafe(F.col("d.conv")), "left")
    counts = [F.coalesce(f"s.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return joined.select("conv_id", *counts, F.coalesce("s.audit", F.lit("")).alias("audit"), F.coalesce("d.sha256", F.lit(sha256().hexdigest())).alias("repaired_sha256"))

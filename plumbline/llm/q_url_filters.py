"""op5: rules, and else a block list of domains held by a Bloom filter cascade, for the urls of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .url_cascade import Rule, any_listed, build_cascades, host_keys, matched_rule, url_parts

RULES = [Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/")]
#: The block list: these names under each of these domains, subdomains included.
BLOCKED_NAMES = ["ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm"]
BLOCKED_UNDER = ["example.com", "example.net", "example.org"]

_LOW = "translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_SQL = " ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{{{r.action}|{r.name}}}'" for r in sorted(RULES, key=lambda r: -len(r.name)))

SQL = f"""
WITH cut AS (
    SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
    SELECT page_id, coalesce({_LOW}, '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM cut
), ruled AS (
    SELECT page_id, host, path, trim(CASE {_RULE_SQL} END, '{{}}') AS r FROM parts
)
SELECT page_id, host, path, split_part(r, '|', 2) AS rule,
    coalesce(split_part(r, '|', 1), CASE WHEN regexp_matches(host, '(^|\\.)({'|'.join(BLOCKED_NAMES)})\\.({'|'.join(x.replace('.', chr(92) + '.') for x in BLOCKED_UNDER)})$') THEN 'block' ELSE 'allow' END) AS verdict
FROM ruled
"""


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, path = url_parts(F.col("url"))
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", host.alias("host"), path.alias("path"))
    universe = pages.select("host").distinct().select(F.explode(host_keys(F.col("host"))).alias("key")).distinct()
    listed = spark.range(1).select(F.explode(F.array(*(F.lit(f"{n}.{d}") for n in BLOCKED_NAMES for d in BLOCKED_UNDER))).alias("key"))
    checked = any_listed(pages.withColumn("keys", host_keys(F.col("host"))), "keys", build_cascades(universe, listed))
    rule, action = matched_rule(F.col("host"), F.col("path"), RULES)
    return checked.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(action, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))

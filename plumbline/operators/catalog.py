"""Catalogue rows to records: header detection, column mapping, row mapping, unpivot, summaries."""

from __future__ import annotations

from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .. import dims
from ..functions.common import filled, lookup, strip
from ..functions.specs import parse_price, resolve_attribute
from ..functions.text import custom_name, normalize_header
from .scans import running

#: Headers that may be hit by similarity, with their targets; core columns without underscores, and the dictionary's aliases.
FUZZY_CHOICES = [(k, v, "core") for k, v in dims.CORE_COLUMNS.items() if "_" not in k] + [(k, v, "spec") for k, v in dims.ALIASES.items() if k not in dims.BY_NAME]
# The least similarity; rows that may be the header, points of a known header and of a filled cell, and of how many cells.
FUZZY_LEAST = 0.9
HEADER_WINDOW, KNOWN, FILLED, MOST_FILLED = 25, 3.0, 0.15, 12
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 "


def detect_header(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of raw rows (keys, row_index, cells array<string>), each file's header row: keys, header_row (from 1), headers.

    Among the first 25 rows: three points a known header, 0.15 a filled cell (of twelve at most); the
    first best row wins.  Without a known header, the row of most filled cells, if it has two.
    """
    known = lambda c: lookup(dims.CORE_COLUMNS, normalize_header(c)).isNotNull() | resolve_attribute(c).isNotNull()
    full = F.filter("cells", lambda c: F.coalesce(strip(c), F.lit("")) != "")
    n_known, n_full = F.size(F.filter(full, known)), F.size(full)
    scored = rows.filter(F.col("row_index") < HEADER_WINDOW).select(*keys, "row_index", "cells", n_known.alias("n_known"), n_full.alias("n_full"))
    rank = F.struct(F.when(F.col("n_known") > 0, KNOWN * F.col("n_known") + FILLED * F.least("n_full", F.lit(MOST_FILLED))).otherwise(0.0), F.col("n_full"), -F.col("row_index"))
    best = scored.groupBy(*keys).agg(F.max_by(F.struct("row_index", "cells", "n_known", "n_full"), rank).alias("b"))
    return best.filter((F.col("b.n_known") > 0) | (F.col("b.n_full") >= 2)).select(*keys, (F.col("b.row_index") + 1).alias("header_row"), F.col("b.cells").alias("headers"))


def _letter_counts(h: Column) -> Column:
    """How often each of LETTERS is in a text, and how many other characters."""
    counts = F.transform(F.array(*map(F.lit, LETTERS)), lambda c: F.length(h) - F.length(F.replace(h, c, F.lit(""))))
    return F.concat(counts, F.array(F.length(F.regexp_replace(h, f"[{LETTERS}]", ""))))


def similar_candidates(headers: DataFrame, least: float = FUZZY_LEAST) -> DataFrame:
    """(normal, choice, key) of the choices that a header (normal) can reach `least` with; those left out cannot.

    A ratio is twice the matched characters over both lengths. Matched are at most as many as the shorter has, so a header meets
    only choices of lengths near its own, by an equal join on the length; and at most as many as both have of each letter.
    """
    spark = headers.sparkSession
    choices = spark.createDataFrame([(k, key, len(key)) for k, (key, _, _) in enumerate(FUZZY_CHOICES)], "choice int, key string, size int")
    choices = choices.withColumn("key_counts", _letter_counts(F.col("key")))
    n = F.length("normal")
    longest = max(len(key) for key, _, _ in FUZZY_CHOICES)
    # the bounds are widened by one, and held exactly below
    sizes = F.sequence(F.greatest(F.lit(1), F.floor(n * (least / (2 - least))).cast("int") - 1), F.least(F.lit(longest), F.ceil(n * ((2 - least) / least)).cast("int") + 1))
    few = headers.filter((n > 0) & (n * (least / (2 - least)) <= longest + 1)).select("normal", _letter_counts(F.col("normal")).alias("counts"), F.explode(sizes).alias("size"))
    met = few.join(F.broadcast(choices), "size").filter(2 * F.least(n, F.col("size")) >= least * (n + F.col("size")) - 1e-9)  # as many rows as the dictionary has
    shared = F.aggregate(F.zip_with("counts", "key_counts", lambda x, y: F.least(x, y)), F.lit(0), lambda t, x: t + x)
    return met.filter(2 * shared >= least * (n + F.col("size")) - 1e-9).select("normal", "choice", "key")


def map_columns(headers: DataFrame, header: str = "header") -> DataFrame:
    """Distinct headers with kind (core, spec, unmapped), target, method (alias, fuzzy, custom_attribute) and confidence.

    Exact core names first, then the dictionary on the header as it stands, then the choice most
    similar by matching blocks (0.9 at least; the first of equals). Null headers are left out; an empty one is unmapped.
    """
    distinct = headers.select(F.col(header).alias("header")).filter("header is not null").distinct()
    core, spec = lookup(dims.CORE_COLUMNS, normalize_header(F.col("header"))), resolve_attribute(F.col("header"))

    def ratios(batches):
        for batch in batches:
            found = [SequenceMatcher(None, a, b).ratio() for a, b in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=["normal", "choice", "ratio"])

    exact = distinct.select("header", normalize_header(F.col("header")).alias("normal"), core.alias("core"), spec.alias("spec"))
    near = similar_candidates(exact.filter("core is null and spec is null").select("normal").distinct())
    judged = near.mapInArrow(ratios, "normal string, choice int, ratio double").filter(F.col("ratio") >= FUZZY_LEAST)
    best = judged.groupBy("normal").agg(F.max(F.struct("ratio", (-F.col("choice")).alias("rank"))).alias("best"))
    place = -F.col("best.rank")
    fuzzy = best.select("normal", *(F.element_at(F.array(*(F.lit(c[i]) for c in FUZZY_CHOICES)), place + 1).alias(name) for i, name in ((1, "fuzzy_target"), (2, "fuzzy_kind"))), F.col("best.ratio").alias("ratio"))
    joined = exact.join(fuzzy, "normal", "left")
    exactly = F.col("core").isNotNull() | F.col("spec").isNotNull()
    return joined.select(
        "header",
        F.when(F.col("core").isNotNull(), "core").when(F.col("spec").isNotNull(), "spec").otherwise(F.coalesce("fuzzy_kind", F.lit("unmapped"))).alias("kind"),
        F.coalesce("core", "spec", "fuzzy_target", custom_name(F.col("header"))).alias("target"),
        F.when(exactly, "alias").when(F.col("fuzzy_target").isNotNull(), "fuzzy").otherwise("custom_attribute").alias("method"),
        F.when(exactly, 1.0).when(F.col("fuzzy_target").isNotNull(), F.col("ratio")).otherwise(0.0).alias("confidence"),
    )


def unpivot_specs(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, position, header, value) of each filled cell, in column order."""
    cells = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(c).alias("header"), strip(F.col(c).cast("string")).alias("value")) for k, c in enumerate(columns)))
    return rows.select(*keys, F.explode(F.filter(cells, lambda x: F.coalesce(x["value"], F.lit("")) != "")).alias("c")).select(*keys, "c.position", "c.header", "c.value")


def product_name(name: Column, sku: Column, mpn: Column) -> Column:
    """The first that is filled; a row without any is rejected."""
    return F.coalesce(*(filled(strip(c)) for c in (name, sku, mpn)))


def map_rows(cells: DataFrame, column_map: DataFrame, keys: list[str]) -> DataFrame:
    """Records of catalogue cells (keys, row_number, position, header, value).

    Output: keys, row_number, the core fields (of several headers for one field the last filled one wins),
    price_value, rejected, and specifications: an array of (attribute, value, unit, confidence, status,
    source) with mapped columns before unmapped ones, each citing `row N, column 'H'`.
    """
    sent = F.broadcast(column_map.select("header", "kind", "target"))  # one row a header
    known = cells.filter(strip(F.col("value")) != "").join(sent, "header").withColumn("value", strip(F.col("value")))
    fields = sorted(set(dims.CORE_COLUMNS.values()))
    core = [F.max_by(F.when((F.col("kind") == "core") & (F.col("target") == f), F.col("value")), F.when((F.col("kind") == "core") & (F.col("target") == f), F.col("position"))).alias(f) for f in fields]
    cite = F.struct(F.lit("document").alias("type"), F.lit("src-1").alias("reference"), F.concat(F.lit("row "), F.col("row_number").cast("string"), F.lit(", column '"), F.col("header"), F.lit("'")).alias("snippet"))
    spec = F.struct(
        (F.col("kind") == "unmapped").alias("late"), "position", F.col("target").alias("attribute"), "value", F.lit(None).cast("string").alias("unit"),
        F.when(F.col("kind") == "spec", 0.95).otherwise(0.3).alias("confidence"), F.when(F.col("kind") == "spec", "extracted").otherwise("needs_review").alias("status"), cite.alias("source"),
    )
    gathered = known.groupBy(*keys, "row_number").agg(*core, F.array_sort(F.collect_list(F.when(F.col("kind") != "core", spec))).alias("s"))
    name = product_name(F.col("product_name"), F.col("sku"), F.col("mpn"))
    specs = F.transform("s", lambda x: F.struct(*(x[c].alias(c) for c in ("attribute", "value", "unit", "confidence", "status", "source"))))
    return gathered.select(*keys, "row_number", name.alias("product_name"), *(f for f in fields if f != "product_name"), parse_price(F.col("price")).alias("price_value"), name.isNull().alias("rejected"), specs.alias("specifications"))


def number_rows(rows: DataFrame, keys: list[str], position: str = "row_index") -> DataFrame:
    """Rows with a filled cell, numbered from 1 in each file."""
    full = rows.filter(F.exists("cells", lambda c: F.coalesce(strip(c), F.lit("")) != ""))
    return running(full, keys, position, sums={"row_number": F.lit(1)}).withColumn("row_number", F.col("row_number").cast("int"))


def to_cells(rows: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Cells of numbered rows under their file's headers: long rows are cut, short ones leave cells out, of equal headers the last wins."""
    joined = rows.join(headers.select(*keys, "header_row", "headers"), keys).filter(F.col("row_index") >= F.col("header_row"))
    numbered = number_rows(joined, keys)
    pairs = F.transform(F.slice("headers", F.lit(1), F.least(F.size("headers"), F.size("cells"))), lambda h, k: F.struct(h.alias("header"), k.alias("position"), F.get("cells", k).alias("value")))
    cells = numbered.select(*keys, "row_number", F.explode(pairs).alias("c")).select(*keys, "row_number", "c.*").filter("header is not null")
    last = Window.partitionBy(*keys, "row_number", "header").orderBy(F.desc("position"))
    return cells.withColumn("r", F.row_number().over(last)).filter("r = 1").drop("r")


def summarize(records: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of rows, accepted and rejected, for each file."""
    return records.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_rows"), F.count_if(~F.col("rejected")).alias("accepted_rows"), F.count_if(F.col("rejected")).alias("rejected_rows"))


def mapping_summary(column_map: DataFrame) -> DataFrame:
    """One row: total_columns, mapped_core (distinct, sorted), mapped_spec, unmapped, and details by header."""
    core = F.array_sort(F.collect_set(F.when(F.col("kind") == "core", F.col("target"))))
    listed = lambda kind: F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("header"))))
    details = F.map_from_entries(F.collect_list(F.struct("header", F.struct("target", "method", "confidence"))))
    return column_map.agg(F.count(F.lit(1)).alias("total_columns"), core.alias("mapped_core"), listed("spec").alias("mapped_spec"), listed("unmapped").alias("unmapped"), details.alias("mapping_details"))


def not_catalogs(records: DataFrame, headers: DataFrame, keys: list[str]) -> DataFrame:
    """Files of which no row was accepted, with the headers that were detected, for an error envelope."""
    accepted = records.filter(~F.col("rejected")).select(*keys).distinct()
    return headers.join(accepted, keys, "left_anti").select(*keys, F.concat(F.lit("not a product catalogue; detected headers: "), F.array_join("headers", ", ")).alias("error"))

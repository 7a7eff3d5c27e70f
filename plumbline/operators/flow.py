"""Whole flows: catalogue rows or extracted documents to scored records that the feeds take."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import WARNINGS
from ..functions.common import fill
from ..functions.units import round2
from . import catalog, feeds
from .blocks import bounded_payload, prompts
from .citations import resolve_citations
from .extract import Client, extract_records, kept
from .validate import overall_confidence, score_with_blocks, scored_specs

_text = lambda: F.lit(None).cast("string")


def build_records(mapped: DataFrame, keys: list[str], reference: Column) -> DataFrame:
    """Records of map_rows' accepted rows, in the form that the feeds take, citing one document `reference`.

    A price exists if its value could be read or a currency is given; a category that is given is certain.
    """
    accepted = mapped.filter(~F.col("rejected"))
    price = F.struct(F.col("price_value").alias("value"), F.col("currency").alias("currency"))
    return accepted.select(
        *keys, "row_number", _text().alias("product_id"), "product_name", "brand", F.coalesce("description", F.lit("")).alias("description"),
        F.struct(F.coalesce("category", F.lit("")).alias("predicted"), F.when(F.col("category").isNotNull(), 1.0).otherwise(0.0).alias("confidence")).alias("category"),
        F.struct("sku", "gtin", "mpn").alias("identifiers"), F.array().cast("array<string>").alias("images"),
        F.when(F.col("price_value").isNotNull() | F.col("currency").isNotNull(), price).alias("price"), "availability",
        F.array(F.struct(F.lit("src-1").alias("id"), F.lit("document").alias("type"), reference.alias("reference"))).alias("sources"),
        F.lit(None).cast("timestamp").alias("extracted_at"), "specifications",
    )


def row_warnings(mapped: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, row_number, warning) of rows without a name and of prices that cannot be read; row_number is their order."""
    row = F.col("row_number").cast("string")
    nameless, unread = fill(WARNINGS["no_name"], row=row), fill(WARNINGS["no_price"], row=row, price=F.col("price"))
    found = F.when(F.col("rejected"), nameless).when(F.col("price").isNotNull() & F.col("price_value").isNull(), unread)
    return mapped.select(*keys, "row_number", found.alias("warning")).filter("warning is not null")


def mapped_catalogs(rows: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mapped, column map, headers) of raw catalogue rows (keys, row_index, cells): header row, columns, rows."""
    headers = catalog.detect_header(rows, keys)
    cells = catalog.to_cells(rows, headers, keys)
    columns = catalog.map_columns(cells)
    return catalog.map_rows(cells, columns, keys), columns, headers


def catalog_records(rows: DataFrame, keys: list[str], reference: Column, keep: Callable[[DataFrame], DataFrame] = kept) -> tuple[DataFrame, DataFrame]:
    """(records, warnings) of raw catalogue rows (keys, row_index, cells): header row, columns, rows, checks and scores.

    Records go into feeds.map_to_all as they are.  Rows of files without a header row give nothing. Mapped rows are written
    once, by `keep`, and both results are read from there.
    """
    mapped = keep(mapped_catalogs(rows, keys)[0])
    records = build_records(mapped, keys, reference).withColumn("specifications", scored_specs(F.col("specifications")))
    return records.withColumn("overall_confidence", overall_confidence(F.col("specifications"))), row_warnings(mapped, keys)


def catalog_envelopes(rows: DataFrame, keys: list[str], reference: Column, keep: Callable[[DataFrame], DataFrame] = kept) -> tuple[DataFrame, DataFrame]:
    """(heads, items) of catalogue files, for feeds.write_objects: what an upload of each is answered with.

    heads: keys, error, header_row, total_rows, accepted_rows, rejected_rows, row_warnings, column_mapping; a file none of whose rows
    is accepted has its detected headers in `error`. items: keys, row_number, and the record with its three feeds.
    """
    whole, columns, headers = mapped_catalogs(rows, keys)
    mapped = keep(whole)
    records = build_records(mapped, keys, reference).withColumn("specifications", scored_specs(F.col("specifications")))
    records = records.withColumn("overall_confidence", overall_confidence(F.col("specifications")))
    warned = row_warnings(mapped, keys).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("row_number", "warning"))), lambda w: w["warning"]).alias("row_warnings"))
    named = headers.select(*keys, F.explode("headers").alias("header")).filter("header is not null").distinct().join(columns, "header")
    mapping = named.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("header", F.struct("target", "method", "confidence"))))).alias("column_mapping"))
    heads = headers.join(catalog.summarize(mapped, keys), keys, "left").join(warned, keys, "left").join(mapping, keys, "left").join(catalog.not_catalogs(mapped, headers, keys), keys, "left")
    count = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return heads.select(*keys, "error", "header_row", *map(count, ("total_rows", "accepted_rows", "rejected_rows")), F.coalesce("row_warnings", F.array().cast("array<string>")).alias("row_warnings"), "column_mapping"), feeds.map_to_all(records)


def document_records(extracted: DataFrame, blocks: DataFrame, files: DataFrame, extracted_at: Column | None = None) -> DataFrame:
    """Records of extracted documents: doc_id, the fields that extracted has, specifications, sources, overall_confidence, extracted_at.

    extracted: doc_id, product_name, specifications (attribute, value, unit, status, reference), and more fields, which stay.
    blocks: doc_id, block_id, pos, text, table, section, page.  files: doc_id, type, reference, one row a document; it is the
    first source.  Specifications are scored against the blocks that they cite, the mean is taken, and block ids become
    sources.  Failed extractions (no name) give no record; a record without specifications has confidence 0.0, one whose
    document is not in files has only the sources that it cites, in order, or none.  extracted_at is the time of the query by default.
    """
    named = extracted.filter("product_name is not null")
    kinds = files.select("doc_id", F.col("type").alias("source_type"))
    flat = named.select("doc_id", F.posexplode("specifications").alias("pos", "s")).join(kinds, "doc_id", "left")
    flat = flat.select("doc_id", "pos", "s.attribute", "s.value", "s.unit", "s.status", "source_type", "s.reference")
    scored = score_with_blocks(flat, blocks).select("doc_id", "pos", "attribute", "value", "unit", F.col("new_status").alias("status"), "confidence", "reference")
    origin = files.select("doc_id", F.lit(0).alias("pos"), F.lit("src-1").alias("id"), "type", "reference", F.lit(None).cast("int").alias("page"))
    cited, sources = resolve_citations(scored, blocks, origin)

    in_order = lambda fields: F.transform(F.array_sort(F.collect_list(F.struct("pos", *fields))), lambda x: F.struct(*(x[f] for f in fields)))
    cite = F.struct(F.col("source_type").alias("type"), F.col("reference").alias("reference"), F.col("snippet").alias("snippet")).alias("source")
    placed = cited.join(kinds, "doc_id", "left").withColumn("source", F.when(F.col("reference").isNotNull(), cite))
    scores = F.transform(F.array_sort(F.collect_list(F.struct("pos", "before"))), lambda x: x["before"])
    mean = round2(F.aggregate(scores, F.lit(0.0), lambda a, x: a + x) / F.size(scores))
    # the mean is of the scores, before what citations take away
    before = scored.select("doc_id", "pos", F.col("confidence").alias("before"))
    means = before.groupBy("doc_id").agg(mean.alias("overall_confidence"))
    specs = placed.groupBy("doc_id").agg(in_order(["attribute", "value", "unit", "status", "confidence", "reference", "snippet", "source"]).alias("specifications"))
    listed = sources.groupBy("doc_id").agg(in_order(["id", "type", "reference", "page"]).alias("sources"))
    more = [c for c in named.columns if c not in ("doc_id", "specifications", "sources", "overall_confidence", "extracted_at", "attempts", "error")]
    records = named.select("doc_id", *more).join(specs, "doc_id", "left").join(listed, "doc_id", "left").join(means, "doc_id", "left")
    filled = {c: F.coalesce(c, F.array()) for c in ("specifications", "sources")} | {"overall_confidence": F.coalesce("overall_confidence", F.lit(0.0))}
    return records.withColumns(filled | {"extracted_at": F.current_timestamp() if extracted_at is None else extracted_at})


def extract_documents(blocks: DataFrame, files: DataFrame, make_client: Callable[[], Client], instructions: str, schema_json: str, extracted_at: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, failures) of documents: prompts of their bounded blocks, answers held against the constraints, scores, citations.

    blocks (doc_id, block_id, pos, type, text, table, section, page), files (doc_id, type, reference). Records go into
    feeds.map_to_all as they are; failures are (doc_id, attempts, error). A document without blocks has no prompt and is in neither.
    """
    told = blocks.join(files.select("doc_id", F.col("reference").alias("source")), "doc_id", "left").withColumn("source", F.coalesce("source", F.lit("")))
    asked = prompts(bounded_payload(told), instructions, schema_json)
    extracted = kept(extract_records(asked, make_client))
    failures = extracted.filter("product_name is null").select("doc_id", "attempts", "error")
    return document_records(extracted, blocks, files, extracted_at), failures

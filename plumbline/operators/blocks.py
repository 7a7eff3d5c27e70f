"""Document blocks: running sections, ids, bounded payloads, raw text, prompts, page layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..dims import BY_NAME
from ..functions.text import block_id, render_block
from .scans import running, unused


def running_section(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """items (doc, pos, type, text) with section: the last heading so far, itself included."""
    return running(items, [doc], "pos", lasts={"section": F.when(F.col("type") == "heading", F.col("text"))})


def with_block_ids(items: DataFrame, doc: str = "doc_id") -> DataFrame:
    """items with block_id: their number from 0 in each document, by pos."""
    return running(items, [doc], "pos", sums={"block_id": F.lit(1)}).withColumn("block_id", block_id(F.col("block_id") - 1))


def bounded_payload(blocks: DataFrame, most_blocks: int = 200, most_chars: int = 100_000, doc: str = "doc_id") -> DataFrame:
    """The blocks of each document's longest prefix within both bounds, with `chars` so far and `truncated`.

    A block without text counts as, and gets, its table's rows (a column `table` of arrays of cells, if there is one),
    cells joined by ' | ' and rows by newline; one without either is empty and counts as a block.
    """
    text = F.col("text")
    if "table" in blocks.columns:
        rows = F.transform("table", lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | "))
        text = F.coalesce(text, F.array_join(rows, "\n"))
    blocks = blocks.withColumn("text", F.coalesce(text, F.lit("")))
    n = unused(blocks.columns, "n")
    counted = running(blocks, [doc], "pos", sums={"chars": F.length("text"), n: F.lit(1)})
    kept = counted.filter((F.col(n) <= most_blocks) & (F.col("chars") <= most_chars))
    totals = blocks.groupBy(F.col(doc).alias("whole_doc")).agg(F.count(F.lit(1)).alias("whole_n"), F.sum(F.length("text")).alias("whole_chars"))
    joined = kept.join(totals, kept[doc].eqNullSafe(totals["whole_doc"]))
    return joined.withColumn("truncated", (F.col("whole_n") > most_blocks) | (F.col("whole_chars") > most_chars)).drop(n, "whole_doc", "whole_n", "whole_chars")


def raw_text(blocks: DataFrame, doc: str = "doc_id", separator: str = "\n\n") -> DataFrame:
    """Each document's block texts in order, joined."""
    return blocks.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda b: b["text"]), separator).alias("raw_text"), F.count(F.lit(1)).alias("n_blocks"))


def prompts(blocks: DataFrame, instructions: str, schema_json: str, doc: str = "doc_id", source: str = "source") -> DataFrame:
    """(doc, prompt): instructions with the canonical attribute names, the schema, the source and its rendered blocks."""
    lines = blocks.withColumn("line", render_block(F.struct("block_id", "type", "text", "table", "page", "section"))).filter("line is not null")
    grouped = lines.groupBy(doc, source).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda b: b["line"]), "\n\n").alias("body"))
    head = f"{instructions.format(canonical_names=', '.join(sorted(BY_NAME)))}\nTarget JSON schema:\n{schema_json}\n\nSource: "
    return grouped.select(doc, F.concat(F.lit(head), F.col(source), F.lit("\nContent blocks:\n"), F.col("body"), F.lit("\n")).alias("prompt"))


def outside_boxes(objects: DataFrame, boxes: DataFrame) -> DataFrame:
    """Page objects (doc_id, page, x0, x1, top, bottom) whose midpoint is in no box of their page (x0 <= x < x1, top <= y < bottom).

    A page's boxes are few, so they travel as one array to its objects rather than in pairs.
    """
    held = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct("x0", "x1", "top", "bottom")).alias("boxes"))
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("top") + F.col("bottom")) / 2
    inside = F.exists(F.coalesce("boxes", F.array()), lambda b: (b["x0"] <= x) & (x < b["x1"]) & (b["top"] <= y) & (y < b["bottom"]))
    return objects.join(held, ["doc_id", "page"], "left").filter(~inside).drop("boxes")

"""Choosing the items of two ingested files to compare, and labels for display."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def choose_items(items: DataFrame, picks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chosen, candidates) of items (pair, side, item, ...) by picks (pair, left_item, right_item).

    A pair with a missing pick and a side of several items is ambiguous: all its items are candidates.
    Else each side's picked item is chosen, the first where none is named.
    """
    sides = items.groupBy("pair", "side").agg(F.count(F.lit(1)).alias("n")).groupBy("pair").agg(F.max("n").alias("most"))
    state = sides.join(picks, "pair", "left").withColumn("ambiguous", (F.col("left_item").isNull() | F.col("right_item").isNull()) & (F.col("most") > 1))
    joined = items.join(state, "pair")
    pick = F.coalesce(F.when(F.col("side") == "left", F.col("left_item")).otherwise(F.col("right_item")), F.lit(0))
    return joined.filter(~F.col("ambiguous") & (F.col("item") == pick)).select(*items.columns), joined.filter("ambiguous").select(*items.columns)


def with_source_labels(specs: DataFrame, sources: DataFrame) -> DataFrame:
    """specs (doc_id, reference, status, ...) with source_label (the source's reference, else the id itself) and has_citation.

    A citation counts where its source is there and the spec needs no review.
    """
    known = sources.select("doc_id", F.col("id").alias("reference"), F.col("reference").alias("label"))
    joined = specs.join(known, ["doc_id", "reference"], "left")
    cited = F.col("label").isNotNull() & (F.col("status") != "needs_review")
    return joined.select(*specs.columns, F.coalesce("label", "reference").alias("source_label"), cited.alias("has_citation"))


def with_status(specs: Column, status: Column) -> Column:
    """The specifications of one status."""
    return F.filter(specs, lambda s: s["status"] == status)


def percent(confidence: Column) -> Column:
    return F.round(confidence * 100).cast("int")

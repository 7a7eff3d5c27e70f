"""Citations: block ids of specs become sources of their document, with snippets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.text import block_text, snippet


def resolve_citations(specs: DataFrame, blocks: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(specs, sources) with real source ids.

    specs: doc_id, pos, attribute, value, status, confidence, reference.  blocks: doc_id, block_id, pos, text,
    table, section, page.  sources: doc_id, pos, id, type, reference, page.  A reference to a source, or none, stays.  One to
    a missing block makes needs_review and at most 0.3.  Each cited block becomes one source, numbered
    in order of first citation past taken ids.  Sources that nothing cites go, unless no block was cited.
    """
    known = sources.select("doc_id", F.col("id").alias("reference"), F.lit(True).alias("is_source"))
    first = blocks.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "block_id").orderBy("pos"))).filter("r = 1")
    first = first.select("doc_id", F.col("block_id").alias("reference"), F.when(F.col("table").isNotNull(), F.array_join(F.filter(F.flatten("table"), lambda c: F.coalesce(c, F.lit("")) != ""), " | ")).otherwise(block_text(F.col("text"), F.col("table"))).alias("cited"), "section", "page", F.lit(True).alias("is_block"))
    joined = specs.join(known, ["doc_id", "reference"], "left").join(first, ["doc_id", "reference"], "left")
    new = F.col("reference").isNotNull() & F.col("is_source").isNull()
    cited = joined.filter(new & F.col("is_block")).groupBy("doc_id", "reference").agg(F.min("pos").alias("first_pos"), F.first("page").alias("page"))
    cited = cited.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("first_pos")))
    taken = sources.groupBy("doc_id").agg(F.collect_set("id").alias("taken"), F.min_by(F.struct("type", "reference"), "pos").alias("origin"))
    minted = cited.join(taken, "doc_id", "left").withColumn("taken", F.coalesce("taken", F.array().cast("array<string>")))
    free = F.filter(F.transform(F.sequence(F.lit(1), F.col("k") + F.size("taken")), lambda n: F.concat(F.lit("src-"), n.cast("string"))), lambda x: ~F.array_contains(F.col("taken"), x))
    minted = minted.select("doc_id", F.col("reference").alias("block"), F.get(free, F.col("k") - 1).alias("id"), "k", "origin", "page")
    out = joined.join(minted.select("doc_id", F.col("block").alias("reference"), F.col("id").alias("new_id")), ["doc_id", "reference"], "left")
    lost = new & F.col("is_block").isNull()
    resolved = out.select(
        *(c for c in specs.columns if c not in ("reference", "status", "confidence")),
        F.when(lost, "needs_review").otherwise(F.col("status")).alias("status"), F.when(lost, F.least("confidence", F.lit(0.3))).otherwise(F.col("confidence")).alias("confidence"),
        F.coalesce("new_id", "reference").alias("reference"), F.when(F.col("new_id").isNotNull(), snippet(F.col("cited"), F.col("section"), F.col("value"))).alias("snippet"),
    )
    used = resolved.select("doc_id", F.col("reference").alias("id")).filter("id is not null").distinct()
    changed = minted.select("doc_id").distinct().withColumn("changed", F.lit(True))
    kept = sources.join(changed, "doc_id", "left").join(used.withColumn("used", F.lit(True)), ["doc_id", "id"], "left").filter("changed is null or used").select("doc_id", "pos", "id", "type", "reference", "page")
    fresh = minted.select("doc_id", (F.lit(1_000_000) + F.col("k")).alias("pos"), "id", F.col("origin.type").alias("type"), F.col("origin.reference").alias("reference"), "page")
    return resolved, kept.unionByName(fresh)

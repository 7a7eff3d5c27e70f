"""Checks and scores over nested records, map-side, and against cited blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.specs import check_spec, grounded, reviewed_status, score_spec
from ..functions.text import block_text
from ..functions.units import round2


def scored_specs(specs: Column) -> Column:
    """An array of specifications with outcome, reason, and new confidence and status; no shuffle.

    A second run begins from the first one's status, so it is not idempotent.
    """

    def one(s: Column) -> Column:
        check = check_spec(s["attribute"], s["value"], s["unit"])
        return F.transform(
            F.array(check),
            lambda c: F.struct(
                s["attribute"].alias("attribute"), s["value"].alias("value"), s["unit"].alias("unit"), score_spec(s["status"], s["source"]["type"], c["outcome"]).alias("confidence"),
                reviewed_status(s["status"], s["attribute"], c["outcome"]).alias("status"), s["source"].alias("source"), c["outcome"].alias("outcome"), c["reason"].alias("reason"),
            ),
        )[0]

    return F.transform(specs, one)


def overall_confidence(specs: Column) -> Column:
    """The mean confidence to two places, 0.0 without specifications."""
    total = F.aggregate(specs, F.lit(0.0), lambda a, s: a + s["confidence"])
    return F.when(F.size(specs) > 0, round2(total / F.size(specs))).otherwise(0.0)


def score_with_blocks(specs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Flat specs (doc_id, pos, attribute, value, unit, status, source_type, reference) scored with groundedness.

    A cited block (doc_id, block_id, pos, text, table) that is missing or does not hold the value is a
    penalty; of blocks with one id the first counts; specs that cite nothing get none.
    """
    first = blocks.groupBy("doc_id", F.col("block_id").alias("reference")).agg(F.min_by(block_text(F.col("text"), F.col("table")), "pos").alias("cited"))
    joined = specs.join(first, ["doc_id", "reference"], "left")
    ungrounded = F.col("reference").isNotNull() & (F.col("cited").isNull() | ~grounded(F.col("value"), F.col("cited")))
    checked = joined.withColumn("check", check_spec(F.col("attribute"), F.col("value"), F.col("unit"))).withColumn("ungrounded", F.coalesce(ungrounded, F.lit(False)))
    return checked.select(
        *specs.columns, F.col("check.outcome").alias("outcome"), F.col("check.reason").alias("reason"), "ungrounded",
        score_spec(F.col("status"), F.col("source_type"), F.col("check.outcome"), F.col("ungrounded")).alias("confidence"),
        reviewed_status(F.col("status"), F.col("attribute"), F.col("check.outcome"), F.col("ungrounded")).alias("new_status"),
    )

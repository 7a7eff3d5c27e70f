"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ._shared import Workspace


def connected_components(links: DataFrame, work: Workspace, name: str) -> DataFrame:
    """(node, label) of every node that a link (a, b) of longs touches; label is the component's smallest node.

    Each round is two joins with a per-node minimum (combined before the shuffle) and is written to the shared folder.
    Nothing is gathered on the driver but the number of rows and a checksum, which stop it when a round changes nothing.
    Without links there are no rows; a link of a node with itself, or one given twice, changes nothing.
    """
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    before, k = None, 0
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        edges = work.write(small, f"{name}-round-{k}")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if k > 1:
            work.drop(f"{name}-round-{k - 2}")
        if tuple(now) == before:
            break
        before, k = tuple(now), k + 1
    both = edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("label")))
    labels = work.write(both.groupBy("node").agg(F.min("label").alias("label")), name)
    work.drop(*(f"{name}-round-{x}" for x in range(max(0, k - 1), k + 1)))
    return labels

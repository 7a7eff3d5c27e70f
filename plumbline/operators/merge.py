"""Merging records of one product from several sources, conflicts, comparison and resolution.

Flat tables: sources (product, record_ord, pos, id, type, reference), specs (product,
record_ord, pos, attribute, value, unit, confidence, status, reference).  A product's rows
meet by its key only; nothing is gathered beyond an attribute's values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.units import comparable, round2
from ..sources.tables import kept


def renumber_sources(sources: DataFrame) -> DataFrame:
    """sources with new_id: src-1, src-2, ... over all of a product's records in order."""
    order = Window.partitionBy("product").orderBy("record_ord", "pos")
    return sources.withColumn("new_id", F.concat(F.lit("src-"), F.row_number().over(order).cast("string")))


def pool_specs(specs: DataFrame, renumbered: DataFrame) -> DataFrame:
    """All specs with their citations rewritten to new ids; other references stay."""
    ids = renumbered.select("product", "record_ord", F.col("id").alias("reference"), "new_id")
    return specs.join(ids, ["product", "record_ord", "reference"], "left").withColumn("reference", F.coalesce("new_id", "reference")).drop("new_id").select(*specs.columns)


def conflicts(specs: DataFrame) -> DataFrame:
    """(product, attribute, n_values, n_specs, values, sources) where comparable values differ.  sources leaves uncited specs out.

    The least and the greatest key of each attribute are aggregated before the shuffle; values are gathered only where
    those two differ, so an attribute on which any number of specs agree costs a row a task.
    """
    return _conflicts(specs.withColumn("key", comparable(F.col("value"), F.col("unit"))))


def _conflicts(specs: DataFrame) -> DataFrame:
    """conflicts of specs that have their comparable values as `key`."""
    keyed = specs.select("product", "attribute", "key", "record_ord", "pos", "value", "reference")
    ends = keyed.groupBy("product", "attribute").agg(F.min("key").alias("low"), F.max("key").alias("high")).filter("low <> high").select("product", "attribute")
    told = keyed.join(ends, ["product", "attribute"], "left_semi").groupBy("product", "attribute").agg(F.array_sort(F.collect_list(F.struct("record_ord", "pos", "value", "reference", "key"))).alias("s"))
    part = lambda f: F.transform("s", lambda x: x[f])
    return told.select("product", "attribute", F.size(F.array_distinct(part("key"))).cast("long").alias("n_values"), F.size("s").cast("long").alias("n_specs"), part("value").alias("values"), F.array_compact(part("reference")).alias("sources"))


def flag_conflicts(specs: DataFrame, found: DataFrame) -> DataFrame:
    """specs with `conflicting`, and needs_review where it is true; confidences stay."""
    flags = found.select("product", "attribute", F.lit(True).alias("conflicting"))
    joined = specs.join(flags, ["product", "attribute"], "left").withColumn("conflicting", F.coalesce("conflicting", F.lit(False)))
    return joined.withColumn("status", F.when(F.col("conflicting"), "needs_review").otherwise(F.col("status")))


def merged_confidence(specs: DataFrame, base: DataFrame | None = None) -> DataFrame:
    """(product, overall_confidence, n_specs): the mean of a product's confidences to two places, as Python's round() gives them.

    Confidences are summed as decimals of 12 places, so the sum does not depend on the order of rows. base
    (product, overall_confidence): its products without specifications keep the value that they have there.
    """
    exact = F.sum(F.col("confidence").cast("decimal(20,12)")).cast("double")
    means = specs.groupBy("product").agg(round2(exact / F.count("confidence")).alias("overall_confidence"), F.count(F.lit(1)).alias("n_specs"))
    if base is None:
        return means
    known = base.select("product", F.col("overall_confidence").alias("own"))
    joined = known.join(means, "product", "full_outer")
    return joined.select("product", F.coalesce("overall_confidence", "own").alias("overall_confidence"), F.coalesce("n_specs", F.lit(0)).cast("long").alias("n_specs"))


def compare_grid(left: DataFrame, right: DataFrame, found: DataFrame) -> DataFrame:
    """(product, attribute, left_values, right_values, verdict) over the attributes of both sides and of conflicts."""
    values = lambda df, name: df.groupBy("product", "attribute").agg(F.array_sort(F.collect_list("value")).alias(name))
    flags = found.select("product", "attribute", F.lit(True).alias("flag")).distinct()
    grid = values(left, "left_values").join(values(right, "right_values"), ["product", "attribute"], "full_outer").join(flags, ["product", "attribute"], "full_outer")
    some = F.coalesce(F.size("left_values"), F.lit(0)) + F.coalesce(F.size("right_values"), F.lit(0)) > 0
    return grid.select("product", "attribute", "left_values", "right_values", F.when(F.col("flag"), "CONFLICT").when(some, "AGREEMENT / VERIFIED").otherwise("UNVERIFIED").alias("verdict"))


def resolve(specs: DataFrame, decisions: DataFrame, accepted: float = 0.97) -> DataFrame:
    """specs after decisions (product, attribute, winner: the number from 0 of the spec within the attribute): losers go, the winner is extracted at `accepted`."""
    order = Window.partitionBy("product", "attribute").orderBy("record_ord", "pos")
    ranked = specs.withColumn("rank", F.row_number().over(order) - 1).join(decisions, ["product", "attribute"], "left")
    kept = ranked.filter("winner is null or rank = winner")
    won = F.col("winner").isNotNull()
    return kept.withColumn("confidence", F.when(won, accepted).otherwise(F.col("confidence"))).withColumn("status", F.when(won, "extracted").otherwise(F.col("status"))).select(*specs.columns)


#: Fields that a merged record has from one record as they are.
SCALARS = ["product_id", "product_name", "brand", "description", "category", "identifiers", "images", "price", "availability", "extracted_at"]


def _empty(name: str) -> Column:
    c, no = F.col(name), lambda x: F.coalesce(x, F.lit("")) == ""
    if name == "category":
        return no(c["predicted"])
    if name == "identifiers":
        return no(c["sku"]) & no(c["gtin"]) & no(c["mpn"])
    if name == "images":
        return F.coalesce(F.size(c), F.lit(0)) < 1
    if name == "price":
        return c["value"].isNull()
    return c.isNull() if name == "extracted_at" else no(c)


def _given(fill: bool) -> list[Column]:
    """For each scalar, struct(value, record_ord) of the record that gives it."""
    order = lambda f: F.when(~_empty(f), F.col("record_ord")) if fill else F.col("record_ord")
    return [F.min_by(F.struct(F.col(f).alias("value"), F.col("record_ord").alias("record_ord")), order(f)).alias(f) for f in SCALARS]


def merge_records(records: DataFrame, fill: bool = False) -> DataFrame:
    """One record a product of records (product, record_ord, and the fields that feeds take), with conflicts and provenance.

    The record of the smallest record_ord is the base: scalar fields are its own, empty ones too; with fill, a field that is
    null or empty in it is the first record's that has it. `provenance` has the record_ord that gave each scalar (null: none
    did). Sources of all records are numbered anew in order, citations follow them, and all specifications are pooled;
    where an attribute's comparable values differ, `conflicts` has (attribute, values, sources), in the order in which
    attributes come first, and its specifications need review. overall_confidence is the mean of all specifications to two
    places, the base's own without any. Records of one product and record_ord must not repeat; null arrays are empty; a
    null product is a product. `records` is read once for each part of the result, so what costs much to work out is to be
    written first; the pooled specifications are, to the shared folder. The result's arrays hold what the product's records hold: they meet by product, and
    nothing else does.
    """
    records = records.withColumn("product", F.struct("product"))  # never null, so null products meet
    specs = records.select("product", "record_ord", F.posexplode("specifications").alias("pos", "s"))
    flat = specs.select("product", "record_ord", "pos", "s.attribute", "s.value", "s.unit", "s.confidence", "s.status", F.col("s.source.reference").alias("reference"), F.col("s.source").alias("source"))
    sources = records.select("product", "record_ord", F.posexplode("sources").alias("pos", "x")).select("product", "record_ord", "pos", "x.id", "x.type", F.col("x.reference").alias("reference"))
    renumbered = renumber_sources(sources)
    pooled = kept(pool_specs(flat, renumbered).withColumn("key", comparable(F.col("value"), F.col("unit"))), "pooled")
    found = _conflicts(pooled)
    flagged = flag_conflicts(pooled, found)
    cited = F.when(F.col("source").isNotNull(), F.struct(F.col("source.type").alias("type"), F.col("reference").alias("reference"), F.col("source.snippet").alias("snippet")))
    spec = F.struct("record_ord", "pos", F.struct("attribute", "value", "unit", "confidence", "status", cited.alias("source")).alias("spec"))
    listed = lambda column, name, field: F.transform(F.array_sort(F.collect_list(column)), lambda x: x[field]).alias(name)
    first = F.min(F.struct("record_ord", "pos")).alias("place")
    conflict = F.struct("place", F.struct("attribute", "values", "sources").alias("conflict"))
    places = flagged.filter("conflicting").groupBy("product", "attribute").agg(first)
    by_product = [
        records.groupBy("product").agg(*_given(fill), F.min_by("overall_confidence", "record_ord").alias("own_confidence"), F.count(F.lit(1)).alias("n_records")),
        flagged.groupBy("product").agg(listed(spec, "specifications", "spec")),
        renumbered.groupBy("product").agg(listed(F.struct("record_ord", "pos", F.struct(F.col("new_id").alias("id"), "type", "reference").alias("source")), "sources", "source")),
        found.join(places, ["product", "attribute"]).groupBy("product").agg(listed(conflict, "conflicts", "conflict")),
        merged_confidence(pooled),
    ]
    base, *others = by_product
    joined = base
    for k, other in enumerate(others):
        other = other.withColumnRenamed("product", f"product_{k}")
        joined = joined.join(other, F.col("product").eqNullSafe(F.col(f"product_{k}")), "left").drop(f"product_{k}")
    empty = lambda name: F.coalesce(name, F.array()).alias(name)
    given = F.struct(*(F.col(f"{f}.record_ord").alias(f) for f in SCALARS)).alias("provenance")
    return joined.select(
        "product.product", "n_records", *(F.col(f"{f}.value").alias(f) for f in SCALARS), empty("specifications"), empty("sources"), empty("conflicts"), given,
        F.coalesce("overall_confidence", "own_confidence").alias("overall_confidence"),
    )


def resolve_records(merged: DataFrame, decisions: DataFrame, accepted: float = 0.97) -> DataFrame:
    """merge_records' rows after decisions (product, attribute, winner: the number from 0 of the spec within its attribute).

    The winner is extracted at `accepted`, the attribute's others and its conflict go, and overall_confidence is taken anew.
    A product's decisions are one map; of two for one attribute the larger number counts; a decision on an
    attribute without a conflict changes nothing, nor does a winner that is not there. Feeds of the result
    are feeds.map_to_all's, which is a projection, so only products that have decisions need to be mapped again.
    """
    each = decisions.groupBy(F.col("product").alias("decided"), "attribute").agg(F.max("winner").alias("winner"))
    held = each.groupBy("decided").agg(F.map_from_entries(F.collect_list(F.struct("attribute", "winner"))).alias("winners"))
    joined = merged.join(held, F.col("product").eqNullSafe(F.col("decided")), "left").drop("decided")
    return apply_winners(joined, accepted).drop("winners")


def apply_winners(joined: DataFrame, accepted: float = 0.97) -> DataFrame:
    """merged records with a map `winners` (attribute, winner), resolved by it; a projection."""
    open_ = F.transform("conflicts", lambda c: c["attribute"])
    of = lambda a: F.filter("specifications", lambda s: s["attribute"] == a)
    valid = F.map_filter(F.coalesce("winners", F.create_map().cast("map<string,int>")), lambda a, w: F.array_contains(open_, a) & (w >= 0) & (w < F.size(of(a))))
    counted = F.aggregate(
        "specifications",
        F.struct(F.array().cast(joined.schema["specifications"].dataType).alias("kept"), F.create_map().cast("map<string,int>").alias("seen")),
        lambda acc, s: _place(acc, s, F.col("valid"), accepted),
        lambda acc: acc["kept"],
    )
    left = joined.withColumn("valid", valid).withColumn("specifications", counted)
    still = F.filter("conflicts", lambda c: ~F.array_contains(F.map_keys("valid"), c["attribute"]))
    total = F.aggregate("specifications", F.lit(0).cast("decimal(20,12)"), lambda a, s: (a + s["confidence"].cast("decimal(20,12)")).cast("decimal(20,12)"))
    mean = F.when(F.size("specifications") > 0, round2(total.cast("double") / F.size("specifications"))).otherwise(F.col("overall_confidence"))
    return left.withColumn("conflicts", still).withColumn("overall_confidence", mean).drop("valid")


def _place(acc: Column, s: Column, valid: Column, accepted: float) -> Column:
    """One step: the specification is kept as it is, kept as the winner, or left out."""
    winner, number = F.element_at(valid, s["attribute"]), F.coalesce(F.element_at(acc["seen"], s["attribute"]), F.lit(0))
    won = s.withField("confidence", F.lit(accepted)).withField("status", F.lit("extracted"))
    kept = F.when(winner.isNull(), F.array_append(acc["kept"], s)).when(winner == number, F.array_append(acc["kept"], won)).otherwise(acc["kept"])
    seen = F.when(winner.isNull(), acc["seen"]).otherwise(F.map_concat(F.map_filter(acc["seen"], lambda k, v: k != s["attribute"]), F.create_map(s["attribute"], number + 1)))
    return F.struct(kept.alias("kept"), seen.alias("seen"))

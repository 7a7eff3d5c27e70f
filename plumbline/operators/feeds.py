"""Three feeds of product records, as structs, and their rule-based issues; projections only.

Records have product_id, product_name, brand, description, category struct(predicted, confidence),
identifiers struct(sku, gtin, mpn), images array, price struct(value, currency), availability,
sources array of struct(type, reference), overall_confidence, extracted_at and specifications.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..dims import AVAILABILITY, AVAILABILITY_IRI, ISSUES
from ..functions.common import fill, filled, let, lookup
from ..functions.specs import confidence_bucket, expects_unit, is_known_currency, match_availability, normalize_currency, resolve_attribute
from ..functions.text import iso8601
from ..functions.units import normalized_value
from .scans import running, unused

CONTEXT = "https://schema.org/"
CLASSIFICATION_NOTE = "class_code and feature_code are unset: no licensed classification table is at hand. Category, features, values and units are ready to be joined with one."
_none = lambda kind="string": F.lit(None).cast(kind)


def _issues(*checks: Column) -> Column:
    return F.array_compact(F.array(*checks))


def schema_org(r: DataFrame) -> Column:
    """The Product document; values are value_num or value_str, and absent parts are null."""

    def property_(s: Column) -> Column:
        def of(n: Column) -> Column:
            unit = F.coalesce(filled(s["unit"]), F.upper(n["unit"]))
            text = F.concat(F.lit("confidence="), F.format_string("%.2f", s["confidence"]), F.lit(", status="), s["status"])
            cited = F.when(F.coalesce(s["source"]["snippet"], F.lit("")) != "", F.concat(F.lit(", source snippet: "), F.substring(s["source"]["snippet"], 1, 120))).otherwise("")
            value_str = F.when(n["number"].isNull(), s["value"])
            return F.struct(s["attribute"].alias("name"), n["number"].alias("value_num"), value_str.alias("value_str"), unit.alias("unitText"), s["status"].alias("extractionStatus"), F.concat(text, cited).alias("description"))

        return let(normalized_value(resolve_attribute(s["attribute"]), s["value"], s["unit"]), of)

    currency = normalize_currency(F.col("price.currency"))
    has_price = F.col("price.value").isNotNull()
    offer = F.struct(F.lit("Offer").alias("@type"), F.col("price.value").alias("price"), F.when(has_price, currency).alias("priceCurrency"), lookup(AVAILABILITY_IRI, match_availability(F.col("availability"))).alias("availability"))
    return F.struct(
        F.lit(CONTEXT).alias("@context"), F.lit("Product").alias("@type"), F.col("product_name").alias("name"), filled(F.col("brand")).alias("brand"), filled(F.col("description")).alias("description"),
        filled(F.col("identifiers.sku")).alias("sku"), filled(F.col("identifiers.gtin")).alias("gtin"), filled(F.col("identifiers.mpn")).alias("mpn"), filled(F.col("category.predicted")).alias("category"),
        F.when(F.size("images") > 0, F.col("images")).alias("image"), F.when(F.col("price").isNotNull() | F.col("availability").isNotNull(), offer).alias("offers"),
        F.when(F.size("specifications") > 0, F.transform("specifications", property_)).alias("additionalProperty"), iso8601(F.col("extracted_at")).alias("dateModified"),
    )


def schema_org_issues(d: Column) -> Column:
    offer = d["offers"]
    code = offer["priceCurrency"]
    props = F.transform(F.filter(F.coalesce(d["additionalProperty"], F.array()), lambda p: (F.coalesce(p["name"], F.lit("")) == "") | (p["value_num"].isNull() & p["value_str"].isNull())), lambda p: F.lit(ISSUES["property"]))
    return F.concat(_issues(
        F.when(F.coalesce(d["name"], F.lit("")) == "", ISSUES["name"]),
        F.when(d["image"].isNull(), ISSUES["image"]),
        F.when(offer.isNull(), ISSUES["offers"]),
        F.when(offer["price"].isNotNull() & code.isNull(), ISSUES["price_currency"]),
        F.when(code.isNotNull() & ~is_known_currency(code), fill(ISSUES["known_currency"], code=code)),
        F.when(d["sku"].isNull() & d["gtin"].isNull() & d["mpn"].isNull(), ISSUES["identifier"]),
    ), props)


def google_item(r: DataFrame) -> Column:
    """A flat feed row; a price without a known currency is left out."""
    currency = normalize_currency(F.col("price.currency"))
    link = F.get(F.transform(F.filter("sources", lambda s: s["type"] == "website"), lambda s: s["reference"]), 0)
    return F.struct(
        F.coalesce(filled(F.col("product_id")), filled(F.col("identifiers.sku")), F.col("product_name")).alias("id"), F.col("product_name").alias("title"), filled(F.col("description")).alias("description"), link.alias("link"),
        F.get("images", 0).alias("image_link"), F.when(F.size("images") > 1, F.array_join(F.slice("images", F.lit(2), F.size("images")), ",")).alias("additional_image_link"),
        filled(F.col("brand")).alias("brand"), filled(F.col("identifiers.gtin")).alias("gtin"), filled(F.col("identifiers.mpn")).alias("mpn"),
        F.when(F.col("price.value").isNotNull() & is_known_currency(currency), F.concat(F.format_string("%.2f", F.col("price.value")), F.lit(" "), currency)).alias("price"),
        match_availability(F.col("availability")).alias("availability"), confidence_bucket(F.col("overall_confidence")).alias("custom_label_0"),
    )


def google_issues(d: Column) -> Column:
    missing = lambda f: F.coalesce(d[f], F.lit("")) == ""
    return _issues(
        F.when(missing("id"), ISSUES["id"]), F.when(missing("title"), ISSUES["title"]), F.when(missing("description"), ISSUES["description"]),
        F.when(missing("link"), ISSUES["link"]), F.when(missing("image_link"), ISSUES["image_link"]),
        F.when(missing("availability"), ISSUES["availability"])
        .when(~d["availability"].isin(sorted({v for _, v in AVAILABILITY})), fill(ISSUES["known_availability"], value=d["availability"])),
        F.when(missing("price"), ISSUES["price"]),
        F.when(missing("brand") & missing("gtin") & missing("mpn"), ISSUES["brand"]),
        F.lit(ISSUES["condition"]), F.lit(ISSUES["category"]),
    )


def industrial(r: DataFrame) -> Column:
    """A classification block; write it with ignoreNullFields=false, as its null codes are part of it."""

    def feature(s: Column) -> Column:
        name = resolve_attribute(s["attribute"])
        of = lambda n: F.struct(_none().alias("feature_code"), F.coalesce(name, s["attribute"]).alias("feature_name"), n["number"].alias("value_num"), F.when(n["number"].isNull(), s["value"]).alias("value_str"), n["unit"].alias("unit"), s["confidence"].alias("confidence"), s["status"].alias("status"))
        return let(normalized_value(name, s["value"], s["unit"]), of)

    return F.struct(
        _none().alias("class_code"), filled(F.col("category.predicted")).alias("class_name"), F.col("category.confidence").alias("class_name_confidence"), F.lit(CLASSIFICATION_NOTE).alias("classification_note"),
        F.col("brand").alias("brand"), F.col("identifiers.mpn").alias("mpn"), F.transform("specifications", feature).alias("features"),
    )


def industrial_issues(d: Column) -> Column:
    of = lambda f: F.array_compact(F.array(
        F.when(f["value_num"].isNull() & f["value_str"].isNull(), fill(ISSUES["feature_value"], name=f["feature_name"])),
        F.when(f["value_num"].isNotNull() & (F.coalesce(f["unit"], F.lit("")) == "") & expects_unit(f["feature_name"]), fill(ISSUES["feature_unit"], name=f["feature_name"])),
    ))
    return F.concat(_issues(F.when(F.coalesce(d["class_name"], F.lit("")) == "", ISSUES["class_name"]), F.when(d["class_code"].isNotNull(), ISSUES["class_code"])), F.flatten(F.transform(F.coalesce(d["features"], F.array()), of)))


def map_to_all(records: DataFrame) -> DataFrame:
    """records with the three feeds and their issues."""
    fed = records.withColumns({"schema_org": schema_org(records), "google": google_item(records), "industrial": industrial(records)})
    return fed.withColumns({"schema_org_issues": schema_org_issues(F.col("schema_org")), "google_issues": google_issues(F.col("google")), "industrial_issues": industrial_issues(F.col("industrial"))})


def write_google_feed(records: DataFrame, path: str) -> None:
    """Tab-separated rows with a header."""
    records.select(google_item(records).alias("g")).select("g.*").write.csv(path, header=True, sep="\t")


def write_envelopes(records: DataFrame, path: str) -> None:
    """One JSON object a record: the record's name, its feeds and issues."""
    fed = map_to_all(records)
    names = ["schema_org", "schema_org_issues", "google", "google_issues", "industrial", "industrial_issues"]
    fed.select("product_name", *names).write.json(path, ignoreNullFields=False)


def object_lines(heads: DataFrame, items: DataFrame, keys: list[str], order: str) -> DataFrame:
    """(keys, part, at, line): the lines of one JSON object for each head, its own fields first and then its items, one a line, in order.

    Items whose keys no head has are left out; a head without items has an empty list.
    """
    fields = [c for c in heads.columns if c not in keys]
    opening = F.regexp_replace(F.to_json(F.struct(*keys, *fields), {"ignoreNullFields": "false"}), r"\}$", ',"items":[')
    place = unused([*items.columns, *keys], "place")
    numbered = running(items, keys, order, sums={place: F.lit(1)})
    body = F.concat(F.when(F.col(place) > 1, F.lit(",")).otherwise(F.lit("")), F.to_json(F.struct(*(c for c in items.columns if c not in keys)), {"ignoreNullFields": "false"}))
    known = heads.select(*keys)
    listed = numbered.select(*keys, F.lit(1).alias("part"), F.col(place).cast("long").alias("at"), body.alias("line")).join(known, keys, "left_semi")
    ends = heads.select(*keys, F.explode(F.array(F.struct(F.lit(0).alias("part"), opening.alias("line")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("line")))).alias("e"))
    return listed.unionByName(ends.select(*keys, "e.part", F.lit(0).cast("long").alias("at"), "e.line"))


def write_objects(heads: DataFrame, items: DataFrame, keys: list[str], order: str, path: str) -> None:
    """Writes one JSON object for each head, {keys, fields, "items": [...]}, under path/key=value/, an item a line.

    The lines of a key are sorted in one task and streamed to its file, of any length; none is held. Spark's own commit puts files
    in place when all tasks are done, so a task that fails leaves no half object and a job that fails leaves none.
    """
    lines = object_lines(heads, items, keys, order)
    by = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(f"{k}_") for k in keys]
    placed = lines.select(*by, "part", "at", "line")
    names = [f"{k}_" for k in keys]
    placed.repartition(*names).sortWithinPartitions(*names, "part", "at").select(*names, "line").write.partitionBy(*names).text(path)


def read_objects(spark, path: str, schema: str) -> DataFrame:
    """The objects that write_objects wrote, by a schema of theirs."""
    return spark.read.schema(schema).json(path, multiLine=True)


def write_demo(heads: DataFrame, items: DataFrame, keys: list[str], order: str, path: str) -> None:
    """write_objects under path/objects, and path/index: a JSON line for each head (its keys and fields), in the order of the keys."""
    write_objects(heads, items, keys, order, f"{path}/objects")
    heads.orderBy(*keys).write.json(f"{path}/index", ignoreNullFields=False)

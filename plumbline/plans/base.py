"""Shared inputs of the queries: the product domain mapped onto the driver's tables, as DataFrames and as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.tables import kept

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with the SQL that gives the same rows."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *key: str) -> DataFrame:
    """Rows of a small file with much work each, over all cores; a file of some megabytes is one or two tasks as it is read."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, *key)


#: header, value, unit of each catalogue cell of a part, in both dialects (plain CASE, || and casts).
CELLS = [
    ("Rated Voltage", "CAST(p_size * 30 AS STRING)", "CASE p_partkey % 5 WHEN 0 THEN 'V' WHEN 1 THEN 'kV' WHEN 2 THEN ' mV ' WHEN 3 THEN NULL ELSE 'bogus' END"),
    ("amperage", "CAST(p_size * 40 AS STRING) || ' mA'", "CAST(NULL AS STRING)"),
    ("IP Rating", "'IP' || CAST(p_size % 8 AS STRING) || CAST(p_partkey % 10 AS STRING)", "CAST(NULL AS STRING)"),
    ("Thread Size", "'M' || CAST(p_size AS STRING) || CASE WHEN p_partkey % 3 = 0 THEN ' x 1' WHEN p_partkey % 3 = 1 THEN '' ELSE ' junk' END", "CAST(NULL AS STRING)"),
    ("material", "CASE p_partkey % 4 WHEN 0 THEN 'Steel' WHEN 1 THEN ' brass ' WHEN 2 THEN 'Wood' ELSE 'carbon steel' END", "CAST(NULL AS STRING)"),
    ("length", "CAST(p_size - 1 AS STRING)", "CASE p_partkey % 3 WHEN 0 THEN 'mm' WHEN 1 THEN 'CM' ELSE 'in' END"),
    ("Operating Temperature", "CASE p_partkey % 3 WHEN 0 THEN CAST(p_size AS STRING) || ' °C' WHEN 1 THEN CAST(-p_size AS STRING) || 'C' ELSE CAST(p_size * 5 AS STRING) END", "CASE WHEN p_partkey % 3 = 2 THEN 'degC' END"),
    ("Warehouse Bin", "CASE WHEN p_partkey % 6 = 0 THEN '' ELSE 'W' || CAST(p_partkey % 50 AS STRING) END", "CAST(NULL AS STRING)"),
]
STATUS = "CASE p_partkey % 3 WHEN 0 THEN 'extracted' WHEN 1 THEN 'inferred' ELSE 'needs_review' END"
SOURCE = "CASE WHEN p_partkey % 2 = 0 THEN 'document' ELSE 'website' END"
_duck = lambda e: e.replace("STRING", "VARCHAR")

#: WITH parts: `cells` (p_partkey, p_brand, p_type, position, header, value, unit, status, source_type), and on top of it the checks.
CELLS_SQL = "cells AS (" + " UNION ALL ".join(f"SELECT p_partkey, p_brand, p_type, {k} AS position, '{h}' AS header, {_duck(v)} AS value, {_duck(u)} AS unit, {STATUS} AS status, {SOURCE} AS source_type FROM part" for k, (h, v, u) in enumerate(CELLS)) + ")"

_BASE = "CASE lower(trim(u)) WHEN 'v' THEN 'v' WHEN 'kv' THEN 'v' WHEN 'mv' THEN 'v' WHEN 'a' THEN 'a' WHEN 'ma' THEN 'a' WHEN 'mm' THEN 'mm' WHEN 'cm' THEN 'mm' WHEN 'in' THEN 'mm' WHEN '°c' THEN '°c' WHEN 'c' THEN '°c' WHEN 'degc' THEN '°c' END"
_TIMES = "CASE lower(trim(u)) WHEN 'v' THEN 1.0 WHEN 'kv' THEN 1000.0 WHEN 'mv' THEN 0.001 WHEN 'a' THEN 1.0 WHEN 'ma' THEN 0.001 WHEN 'mm' THEN 1.0 WHEN 'cm' THEN 10.0 WHEN 'in' THEN 25.4 WHEN '°c' THEN 1.0 WHEN 'c' THEN 1.0 WHEN 'degc' THEN 1.0 END"
CHECKED_SQL = f"""{CELLS_SQL}, named AS (
    SELECT *, CASE header WHEN 'Rated Voltage' THEN 'voltage_rating' WHEN 'amperage' THEN 'current_rating' WHEN 'IP Rating' THEN 'ip_rating' WHEN 'Thread Size' THEN 'thread_size' WHEN 'material' THEN 'material' WHEN 'length' THEN 'length' WHEN 'Operating Temperature' THEN 'operating_temp' END AS attribute,
        CASE WHEN regexp_full_match(trim(value), '[+-]?[0-9]+([.][0-9]*)?') THEN unit ELSE coalesce(nullif(trim(regexp_extract(value, '^\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*([^\\d\\s].*)?\\s*$', 2)), ''), unit) END AS u,
        TRY_CAST(regexp_extract(value, '^\\s*([+-]?\\d+(?:\\.\\d+)?)\\s*([^\\d\\s].*)?\\s*$', 1) AS DOUBLE) AS num
    FROM cells WHERE trim(value) <> ''
), based AS (
    SELECT *, CASE WHEN coalesce(u, '') = '' THEN num ELSE num * CAST({_TIMES} AS DOUBLE) END AS x, {_BASE} AS base FROM named
), checked AS (
    SELECT *, CASE
        WHEN attribute IS NULL THEN 'unverifiable'
        WHEN attribute IN ('voltage_rating', 'current_rating', 'length', 'operating_temp') THEN CASE
            WHEN num IS NULL OR (coalesce(u, '') <> '' AND base IS NULL) THEN 'unverifiable'
            WHEN attribute = 'voltage_rating' AND (x < 1 OR x > 1000) THEN 'fail'
            WHEN attribute = 'current_rating' AND (x < 0.1 OR x > 100) THEN 'fail'
            WHEN attribute = 'operating_temp' AND (x < -40 OR x > 150) THEN 'fail'
            WHEN attribute = 'length' AND x <= 0 THEN 'fail' ELSE 'pass' END
        WHEN attribute = 'ip_rating' THEN CASE WHEN regexp_matches(trim(value), '^IP[0-6][0-9K]$') THEN 'pass' ELSE 'fail' END
        WHEN attribute = 'thread_size' THEN CASE WHEN regexp_matches(regexp_replace(trim(value), '\\s*[×xX]\\s*', 'x', 'g'), '^(M\\d+(\\.\\d+)?(x\\d+(\\.\\d+)?)?|#\\d+|\\d+(\\.\\d+)?/\\d+in|\\d+(\\.\\d+)?in)$') THEN 'pass' ELSE 'fail' END
        WHEN attribute = 'material' THEN CASE WHEN lower(trim(value)) IN ('steel', 'stainless steel', 'carbon steel', 'alloy steel', 'brass', 'aluminum', 'titanium', 'nylon', 'plastic') THEN 'pass' ELSE 'fail' END
        END AS outcome
    FROM based
), scored AS (
    SELECT *, greatest(0.0, least(1.0, CAST(CASE status WHEN 'extracted' THEN 0.85 WHEN 'inferred' THEN 0.6 ELSE 0.3 END AS DOUBLE) * CAST(CASE source_type WHEN 'document' THEN 1.0 ELSE 0.85 END AS DOUBLE)
        + CAST(CASE outcome WHEN 'pass' THEN 0.10 WHEN 'fail' THEN -0.45 ELSE -0.05 END AS DOUBLE))) AS confidence,
        CASE WHEN attribute IS NULL OR outcome = 'fail' THEN 'needs_review' ELSE status END AS new_status
    FROM checked
)"""


#: Means in the order of the cells, to two places by their binary value: odd multiples of 1 / 200 are rounded by what lies beyond them.
OVERALL_SQL = """means AS (
    SELECT p_partkey, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(confidence ORDER BY position)), lambda a, x: a + x) / count(*) AS x, count(*) AS n FROM scored GROUP BY 1
), halves AS (
    SELECT *, round(x * 200) AS t FROM means
), overall AS (
    SELECT p_partkey, n, CASE
        WHEN t % 2 <> 1 OR abs(x * 200 - t) >= 1e-9 THEN round(x, 2)
        WHEN ((x * 128 - t) + x * 64) + x * 8 > 0 THEN (t + 1) / 200
        WHEN ((x * 128 - t) + x * 64) + x * 8 < 0 THEN (t - 1) / 200
        WHEN (t + 1) % 4 = 0 THEN (t + 1) / 200 ELSE (t - 1) / 200 END AS oc FROM halves
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue cells of all parts, blank ones included."""
    rows = F.array(*(F.struct(F.lit(k).alias("position"), F.lit(h).alias("header"), F.expr(v).alias("value"), F.expr(u).alias("unit")) for k, (h, v, u) in enumerate(CELLS)))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type", F.expr(STATUS).alias("status"), F.expr(SOURCE).alias("source_type"), F.explode(rows).alias("c"))
    return parts.select("p_partkey", "p_brand", "p_type", "c.*", "status", "source_type")


def records(spark: SparkSession, sf_dir: str, parts: DataFrame | None = None) -> DataFrame:
    """Nested records of all parts (as they are read, or the rows given) with scored specifications; no shuffle."""
    from ..operators.validate import overall_confidence, scored_specs

    parts = table(spark, sf_dir, "part") if parts is None else parts
    specs = F.array(*(
        F.struct(F.lit(h).alias("attribute"), F.expr(v).alias("value"), F.expr(u).alias("unit"), F.expr(STATUS).alias("status"), F.struct(F.expr(SOURCE).alias("type"), F.lit("src-1").alias("reference"), F.lit(None).cast("string").alias("snippet")).alias("source"))
        for h, v, u in CELLS
    ))
    full = F.filter(specs, lambda s: F.trim(s["value"]) != "")
    scored = parts.withColumn("specifications", scored_specs(full))
    key = F.col("p_partkey")
    return scored.select(
        key.cast("string").alias("product_id"), F.col("p_name").alias("product_name"), F.when(key % 7 == 0, "").otherwise(F.col("p_brand")).alias("brand"), F.when(key % 4 != 0, F.concat_ws(" ", "p_type", "p_name")).alias("description"),
        F.struct(F.when(key % 9 != 0, F.col("p_type")).otherwise("").alias("predicted"), F.lit(1.0).alias("confidence")).alias("category"),
        F.struct(F.when(key % 5 != 0, F.concat(F.lit("SKU-"), key.cast("string"))).alias("sku"), F.lit(None).cast("string").alias("gtin"), F.when(key % 11 == 0, F.concat(F.lit("M"), key.cast("string"))).alias("mpn")).alias("identifiers"),
        F.when(key % 3 == 0, F.array(F.lit("a.png"), F.lit("b.png"), F.lit("c.png"))).otherwise(F.array().cast("array<string>")).alias("images"),
        F.when(key % 8 != 0, F.struct(F.col("p_retailprice").alias("value"), F.element_at(F.array(*map(F.lit, ("usd", "XXX", " eur ", None))), (key % 4 + 1).cast("int")).alias("currency"))).alias("price"),
        F.element_at(F.array(*map(F.lit, ("in_stock", "Ships in 3 days", "sold out", None, "maybe"))), (key % 5 + 1).cast("int")).alias("availability"),
        F.array(F.struct(F.expr(SOURCE).alias("type"), F.concat(F.lit("https://shop.example.com/"), key.cast("string")).alias("reference"))).alias("sources"),
        overall_confidence(F.col("specifications")).alias("overall_confidence"), F.lit(None).cast("timestamp").alias("extracted_at"), "specifications",
    )


#: Of each part a second record, from a website: fewer specifications, of which some lengths and materials read otherwise.
AGAIN = ("Rated Voltage", "material", "length")
AGAIN_VALUE = "CASE WHEN {header} = 'length' AND p_partkey % 2 = 0 THEN {value} || '0' WHEN {header} = 'material' THEN upper({value}) ELSE {value} END"
POOLED_SQL = f"""pooled AS (
    SELECT p_partkey AS product, 0 AS record_ord, position AS pos, header AS attribute, value, unit, confidence, new_status AS status FROM scored
    UNION ALL
    SELECT p_partkey, 1, CASE header WHEN 'Rated Voltage' THEN 0 WHEN 'material' THEN 1 ELSE 2 END, header, {AGAIN_VALUE.format(header="header", value="value")}, unit, confidence, new_status FROM scored WHERE header IN {AGAIN}
)"""


def paired_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """records with product and record_ord: each part's own (0) and its website's (1), whose name is upper case and whose brand is given."""
    first = kept(records(spark, sf_dir, spread(table(spark, sf_dir, "part"), "p_partkey"))).withColumn("product", F.col("product_id").cast("long")).withColumn("p_partkey", F.col("product"))
    site = F.array(F.struct(F.lit("src-1").alias("id"), F.lit("website").alias("type"), F.concat(F.lit("https://site.example.com/"), "product_id").alias("reference")))
    own = F.transform("sources", lambda x: F.struct(F.lit("src-1").alias("id"), x["type"].alias("type"), x["reference"].alias("reference")))
    value = lambda x: F.when((x["attribute"] == "length") & (F.col("p_partkey") % 2 == 0), F.concat(x["value"], F.lit("0"))).when(x["attribute"] == "material", F.upper(x["value"])).otherwise(x["value"])
    again = F.flatten(F.array(*(F.transform(F.filter("specifications", lambda x: x["attribute"] == a), lambda x: x.withField("value", value(x))) for a in AGAIN)))  # noqa: B023
    second = first.withColumns({"record_ord": F.lit(1), "product_name": F.upper("product_name"), "brand": F.coalesce(F.when(F.col("brand") != "", F.col("brand")), F.lit("Site brand")), "specifications": again, "sources": site})
    return first.withColumn("record_ord", F.lit(0)).withColumn("sources", own).unionByName(second).drop("p_partkey")


#: Offers of several suppliers for each part: flat specs for merging.
OFFERS_SQL = """offers AS (
    SELECT l_partkey AS product, l_suppkey AS supplier, l_orderkey AS o, l_linenumber AS n, l_quantity, l_discount, l_returnflag FROM lineitem
), ordered AS (
    SELECT *, row_number() OVER (PARTITION BY product ORDER BY supplier, o, n) AS record_ord FROM offers
), specs AS (
    SELECT product, record_ord, 0 AS pos, 'length' AS attribute, CASE WHEN record_ord % 2 = 0 THEN CAST(CAST(l_quantity AS BIGINT) % 3 * 10 AS VARCHAR) || ' mm' ELSE CAST(CAST(l_quantity AS BIGINT) % 3 AS VARCHAR) END AS value, CASE WHEN record_ord % 2 = 0 THEN CAST(NULL AS VARCHAR) ELSE 'cm' END AS unit,
        CASE WHEN l_returnflag = 'R' THEN 0.35 ELSE 0.95 END AS confidence, 'extracted' AS status, 'src-1' AS reference FROM ordered
    UNION ALL
    SELECT product, record_ord, 1 AS pos, 'material' AS attribute, CASE WHEN l_returnflag = 'N' THEN ' Steel' ELSE 'steel' END AS value, NULL AS unit, 0.5 AS confidence, 'inferred' AS status, CASE WHEN record_ord % 4 = 0 THEN NULL ELSE 'src-1' END AS reference FROM ordered
)"""


def offers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """specs (product, record_ord, pos, attribute, value, unit, confidence, status, reference) of all line items, a record each."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_partkey").orderBy("l_suppkey", "l_orderkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("product"), F.row_number().over(order).alias("record_ord"), F.col("l_quantity").cast("long").alias("q"), "l_returnflag")
    even = F.col("record_ord") % 2 == 0
    length = F.struct(F.lit(0).alias("pos"), F.lit("length").alias("attribute"), F.when(even, F.concat((F.col("q") % 3 * 10).cast("string"), F.lit(" mm"))).otherwise((F.col("q") % 3).cast("string")).alias("value"), F.when(~even, "cm").alias("unit"), F.when(F.col("l_returnflag") == "R", 0.35).otherwise(0.95).alias("confidence"), F.lit("extracted").alias("status"), F.lit("src-1").alias("reference"))
    material = F.struct(F.lit(1).alias("pos"), F.lit("material").alias("attribute"), F.when(F.col("l_returnflag") == "N", " Steel").otherwise("steel").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit(0.5).alias("confidence"), F.lit("inferred").alias("status"), F.when(F.col("record_ord") % 4 != 0, "src-1").alias("reference"))
    return rows.select("product", "record_ord", F.explode(F.array(length, material)).alias("s")).select("product", "record_ord", "s.*")


#: The significant words of a text, in SQL.
_STOP = "['a', 'an', 'the', 'and', 'or', 'of', 'to', 'in', 'on', 'for', 'with', 'is', 'are', 'was', 'were', 'be', 'as', 'at', 'by', 'this', 'that']"
WORDS = "list_filter(list_distinct(regexp_extract_all(lower({0}), '[a-z]+|[0-9]+(?:\\.[0-9]+)?')), lambda w: NOT list_contains(" + _STOP + ", w))"

#: Lines of all documents as blocks.
LINES_SQL = """lines AS (
    SELECT doc_id, k AS pos, l AS text, CASE WHEN length(l) < 40 THEN 'heading' ELSE 'text' END AS type
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS k FROM documents)
)"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return docs.withColumn("type", F.when(F.length("text") < 40, "heading").otherwise("text"))

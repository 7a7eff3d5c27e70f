"""Catalogue, units, checks, scores and feeds over parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import dims
from ..functions.specs import check_spec, confidence_bucket, is_known_currency, issue_severity, match_availability, normalize_currency, parse_price, resolve_attribute, reviewed_status, score_spec
from ..functions.text import custom_name, display_name, display_value, normalize_header
from ..functions.units import comparable, normalized_value, parse_numeric, to_base
from ..operators import catalog, feeds, flow
from ..sources.tables import scratch_dir
from .base import CELLS, CELLS_SQL, CHECKED_SQL, OVERALL_SQL, cells, query, records, table


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).filter(F.trim("value") != "").withColumn("check", check_spec(F.col("header"), F.col("value"), F.col("unit")))
    return c.withColumns({"attribute": resolve_attribute(F.col("header")), "outcome": F.col("check.outcome"), "confidence": score_spec(F.col("status"), F.col("source_type"), F.col("check.outcome")), "new_status": reviewed_status(F.col("status"), F.col("header"), F.col("check.outcome"))})


@query(f"WITH {CHECKED_SQL} SELECT p_brand AS brand, p_type AS category, count(*) AS n_specs, count(DISTINCT p_partkey) AS n_records, CAST(sum(CAST(confidence AS DECIMAL(18, 6))) AS DOUBLE) / count(*) AS mean_confidence, sum(CASE WHEN confidence >= 0.8 THEN 1 ELSE 0 END)::BIGINT AS n_high, sum(CASE WHEN outcome = 'fail' THEN 1 ELSE 0 END)::BIGINT AS n_fail FROM scored GROUP BY 1, 2")
def q_trust_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("category")).agg(
        F.count(F.lit(1)).alias("n_specs"), F.count_distinct("p_partkey").alias("n_records"), (F.sum(F.col("confidence").cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias("mean_confidence"),
        F.count_if(F.col("confidence") >= 0.8).alias("n_high"), F.count_if(F.col("outcome") == "fail").alias("n_fail"),
    )


@query(f"WITH {CHECKED_SQL} SELECT p_partkey, position, num AS number, u AS stated_unit, CASE WHEN base IS NULL THEN NULL ELSE x END AS base_number, base AS base_unit FROM based WHERE num IS NOT NULL")
def q_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = cells(spark, sf_dir).filter(F.trim("value") != "").withColumn("p", parse_numeric(F.col("value"), F.col("unit"))).filter("p is not null")
    return p.withColumn("b", to_base(F.col("p.number"), F.col("p.unit"))).select("p_partkey", "position", F.col("p.number").alias("number"), F.col("p.unit").alias("stated_unit"), F.col("b.number").alias("base_number"), F.col("b.unit").alias("base_unit"))


@query(f"WITH {CHECKED_SQL} SELECT header, attribute, regexp_replace(lower(header), '[^a-z0-9]+', '_', 'g') AS custom, count(*) AS n FROM named GROUP BY 1, 2, 3")
def q_attr_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).filter(F.trim("value") != "").groupBy("header").agg(F.count(F.lit(1)).alias("n"))
    return c.select("header", resolve_attribute(F.col("header")).alias("attribute"), custom_name(F.col("header")).alias("custom"), "n")


@query(f"WITH {CELLS_SQL} SELECT p_partkey, position, header, trim(value) AS value FROM cells WHERE trim(value) <> ''")
def q_unpivot_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = table(spark, sf_dir, "part").select("p_partkey", *(F.expr(v).alias(h) for h, v, _ in CELLS))
    return catalog.unpivot_specs(wide, ["p_partkey"], [h for h, _, _ in CELLS])


def _outcomes(kind: tuple[str, ...]):
    return f"WITH {CHECKED_SQL} SELECT p_partkey, attribute, outcome FROM checked WHERE attribute IN {kind}" if len(kind) > 1 else f"WITH {CHECKED_SQL} SELECT p_partkey, attribute, outcome FROM checked WHERE attribute = '{kind[0]}'"


@query(_outcomes(("voltage_rating", "current_rating", "length")))
def q_range_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("attribute").isin("voltage_rating", "current_rating", "length")).select("p_partkey", "attribute", "outcome")


@query(_outcomes(("ip_rating", "thread_size")))
def q_pattern_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("attribute").isin("ip_rating", "thread_size")).select("p_partkey", "attribute", "outcome")


@query(_outcomes(("material",)))
def q_enum_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).filter(F.col("attribute") == "material").select("p_partkey", "attribute", "outcome")


@query(f"WITH {CHECKED_SQL} SELECT p_partkey, position, round(confidence, 9) AS confidence, new_status FROM scored")
def q_score_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", "position", F.round("confidence", 9).alias("confidence"), "new_status")


@query(f"WITH {CHECKED_SQL}, {OVERALL_SQL} SELECT CAST(p_partkey AS VARCHAR) AS product_id, oc AS overall_confidence, n AS n_specs FROM overall")
def q_overall_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records(spark, sf_dir).select("product_id", "overall_confidence", F.size("specifications").cast("long").alias("n_specs"))


@query(f"WITH {CHECKED_SQL} SELECT CASE WHEN confidence >= 0.8 THEN 'high' WHEN confidence >= 0.5 THEN 'medium' ELSE 'low' END AS bucket, new_status, count(*) AS n FROM scored GROUP BY 1, 2")
def q_bucket_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).groupBy(confidence_bucket(F.col("confidence")).alias("bucket"), "new_status").agg(F.count(F.lit(1)).alias("n"))


_PRICE = "CASE p_partkey % 6 WHEN 0 THEN '$1,2' || CAST(p_size % 10 AS {0}) || '0.50' WHEN 1 THEN CAST(p_size AS {0}) WHEN 2 THEN ' ' || CAST(p_size AS {0}) || '.25 ' WHEN 3 THEN '12f' WHEN 4 THEN 'call us' ELSE '1_000' END"


@query(f"SELECT p_partkey, CASE p_partkey % 6 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN 1000.0::DOUBLE ELSE TRY_CAST(trim(replace(replace(raw, ',', ''), '$', '')) AS DOUBLE) END AS price FROM (SELECT p_partkey, {_PRICE.format('VARCHAR')} AS raw FROM part)")
def q_price_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", parse_price(F.expr(_PRICE.format("STRING"))).alias("price"))


_STOCK = "CASE p_partkey % 8 WHEN 0 THEN 'In Stock' WHEN 1 THEN 'out_of_stock' WHEN 2 THEN 'Pre-Order now' WHEN 3 THEN 'not available' WHEN 4 THEN 'Ships in ' || CAST(p_size AS {0}) || ' days' WHEN 5 THEN 'back order' WHEN 6 THEN 'out-of-stock' ELSE NULL END"


@query(f"SELECT availability, count(*) AS n FROM (SELECT CASE WHEN t LIKE '%preorder%' OR t LIKE '%pre-order%' THEN 'preorder' WHEN t LIKE '%backorder%' OR t LIKE '%back order%' THEN 'backorder' WHEN t LIKE '%out of stock%' OR t LIKE '%unavailable%' OR t LIKE '%sold out%' OR t LIKE '%discontinued%' THEN 'out_of_stock' WHEN t LIKE '%in stock%' OR t LIKE '%available%' OR t LIKE '%ships%' THEN 'in_stock' END AS availability FROM (SELECT replace(lower(trim({_STOCK.format('VARCHAR')})), '_', ' ') AS t FROM part)) GROUP BY 1")
def q_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(match_availability(F.expr(_STOCK.format("STRING"))).alias("availability")).agg(F.count(F.lit(1)).alias("n"))


_CODE = "CASE n_nationkey % 5 WHEN 0 THEN 'usd' WHEN 1 THEN ' Eur ' WHEN 2 THEN substr(n_name, 1, 3) WHEN 3 THEN '' ELSE NULL END"


@query(f"SELECT n_nationkey, upper(trim(nullif(c, ''))) AS currency, coalesce(upper(trim(nullif(c, ''))) IN ('USD', 'EUR', 'GBP', 'INR', 'JPY', 'CNY', 'CAD', 'AUD', 'CHF', 'SGD'), false) AS known FROM (SELECT n_nationkey, {_CODE} AS c FROM nation)")
def q_currency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey", normalize_currency(F.expr(_CODE)).alias("currency"), is_known_currency(F.expr(_CODE)).alias("known"))


@query("SELECT p_brand, count(*) AS total_rows, sum(CASE WHEN product_name IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS accepted_rows, sum(CASE WHEN product_name IS NULL THEN 1 ELSE 0 END)::BIGINT AS rejected_rows FROM (SELECT p_brand, coalesce(CASE WHEN p_partkey % 3 <> 0 THEN p_name END, CASE WHEN p_partkey % 5 <> 0 THEN 'SKU-' || p_partkey END) AS product_name FROM part) GROUP BY 1")
def q_reject_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    named = table(spark, sf_dir, "part").select("p_brand", catalog.product_name(F.when(key % 3 != 0, F.col("p_name")).otherwise("  "), F.when(key % 5 != 0, F.concat(F.lit("SKU-"), key.cast("string"))).otherwise(""), F.lit(None).cast("string")).isNull().alias("rejected"))
    return catalog.summarize(named, ["p_brand"])


@query(f"WITH {CHECKED_SQL} SELECT p_partkey, position, CASE WHEN u IS NOT NULL AND base IS NULL THEN NULL WHEN u IS NULL THEN num ELSE x END AS number, CASE WHEN num IS NULL THEN NULL WHEN u IS NOT NULL THEN base ELSE CASE attribute WHEN 'voltage_rating' THEN 'v' END END AS unit FROM based")
def q_normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cells(spark, sf_dir).filter(F.trim("value") != "").withColumn("n", normalized_value(resolve_attribute(F.col("header")), F.col("value"), F.col("unit")))
    return c.select("p_partkey", "position", F.col("n.number").alias("number"), F.col("n.unit").alias("unit"))


_FED = f"""WITH {CHECKED_SQL}, {OVERALL_SQL}, rec AS (
    SELECT p.p_partkey AS k, p.*, o.oc, CASE WHEN p.p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS brand, CASE WHEN p.p_partkey % 4 <> 0 THEN p_type || ' ' || p_name END AS description,
        CASE WHEN p.p_partkey % 5 <> 0 THEN 'SKU-' || p.p_partkey END AS sku, CASE WHEN p.p_partkey % 11 = 0 THEN 'M' || p.p_partkey END AS mpn,
        CASE WHEN p.p_partkey % 8 <> 0 THEN p_retailprice END AS price, CASE WHEN p.p_partkey % 8 <> 0 THEN CASE p.p_partkey % 4 WHEN 0 THEN 'USD' WHEN 1 THEN 'XXX' WHEN 2 THEN 'EUR' END END AS code,
        CASE p.p_partkey % 5 WHEN 0 THEN 'in_stock' WHEN 1 THEN 'in_stock' WHEN 2 THEN 'out_of_stock' END AS stock, p.p_partkey % 5 <> 3 AS any_stock
    FROM part p JOIN overall o ON p.p_partkey = o.p_partkey
)"""


@query(f"{_FED} SELECT CAST(k AS VARCHAR) AS id, p_name AS name, brand, sku, mpn, CASE WHEN k % 9 <> 0 THEN p_type END AS category, price, code AS currency, CASE stock WHEN 'in_stock' THEN 'https://schema.org/InStock' WHEN 'out_of_stock' THEN 'https://schema.org/OutOfStock' END AS availability FROM rec")
def q_schema_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    d = r.select("product_id", feeds.schema_org(r).alias("d"))
    return d.select(F.col("product_id").alias("id"), "d.name", "d.brand", "d.sku", "d.mpn", "d.category", "d.offers.price", F.col("d.offers.priceCurrency").alias("currency"), "d.offers.availability")


@query(f"{_FED} SELECT CAST(k AS VARCHAR) AS id, p_name AS title, description, CASE WHEN k % 2 = 1 THEN 'https://shop.example.com/' || k END AS link, CASE WHEN k % 3 = 0 THEN 'a.png' END AS image_link, CASE WHEN k % 3 = 0 THEN 'b.png,c.png' END AS additional_image_link, brand, mpn, CASE WHEN code IN ('USD', 'EUR') AND price IS NOT NULL THEN printf('%.2f', price) || ' ' || code END AS price, stock AS availability, CASE WHEN oc >= 0.8 THEN 'high' WHEN oc >= 0.5 THEN 'medium' ELSE 'low' END AS custom_label_0 FROM rec")
def q_google_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    g = r.select(feeds.google_item(r).alias("g")).select("g.*")
    return g.select("id", "title", "description", "link", "image_link", "additional_image_link", "brand", "mpn", "price", "availability", "custom_label_0")


#: Numbers and units as feeds have them: in the base unit of a known unit, or in the attribute's own without one.
_VALUES_SQL = f"""WITH {CHECKED_SQL}, valued AS (
    SELECT *, coalesce(attribute, header) AS name, CASE WHEN coalesce(u, '') <> '' THEN CASE WHEN base IS NOT NULL THEN x END ELSE num END AS value_num,
        CASE WHEN num IS NULL THEN NULL WHEN coalesce(u, '') <> '' THEN base ELSE CASE attribute WHEN 'voltage_rating' THEN 'v' WHEN 'current_rating' THEN 'a' WHEN 'length' THEN 'mm' WHEN 'operating_temp' THEN '°c' END END AS base_unit FROM scored
)"""


@query(f"""{_VALUES_SQL} SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(position AS INTEGER) AS k, name AS feature_name, value_num, CASE WHEN value_num IS NULL THEN value END AS value_str, base_unit AS unit, round(confidence, 9) AS confidence, new_status AS status,
    replace(name, '_', ' ') || ': ' || value || CASE WHEN coalesce(unit, '') <> '' THEN ' ' || unit ELSE '' END AS shown FROM valued""")
def q_industrial(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    f = r.select("product_id", F.posexplode(F.arrays_zip(feeds.industrial(r)["features"].alias("f"), F.col("specifications").alias("s"))).alias("k", "z")).select("product_id", "k", "z.f", "z.s")
    shown = F.concat(display_name(F.col("f.feature_name")), F.lit(": "), display_value(F.col("s.value"), F.col("s.unit")))
    return f.select(F.col("product_id").alias("id"), "k", "f.feature_name", "f.value_num", "f.value_str", "f.unit", F.round("f.confidence", 9).alias("confidence"), "f.status", shown.alias("shown"))


@query(f"""{_VALUES_SQL} SELECT CAST(p_partkey AS VARCHAR) AS id, CAST(position AS INTEGER) AS k, header AS name, value_num, CASE WHEN value_num IS NULL THEN value END AS value_str, coalesce(nullif(unit, ''), upper(base_unit)) AS unit_text, new_status AS extraction_status,
    'confidence=' || CAST(CAST(CAST(confidence AS DECIMAL(18, 12)) AS DECIMAL(10, 2)) AS VARCHAR) || ', status=' || new_status AS description FROM valued""")
def q_property_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The additional properties of every part's Product document."""
    r = records(spark, sf_dir)
    p = r.select("product_id", F.posexplode(feeds.schema_org(r)["additionalProperty"]).alias("k", "p"))
    return p.select(F.col("product_id").alias("id"), "k", "p.name", "p.value_num", "p.value_str", F.col("p.unitText").alias("unit_text"), F.col("p.extractionStatus").alias("extraction_status"), "p.description")


@query(f"""{_FED} SELECT feed, issue, count(*) AS n FROM (
    SELECT 'google' AS feed, unnest(list_filter([CASE WHEN description IS NULL THEN 'required: description is missing' END, CASE WHEN k % 2 = 0 THEN 'required: link is missing (no website-sourced URL available)' END, CASE WHEN k % 3 <> 0 THEN 'required: image_link is missing' END,
        CASE WHEN stock IS NULL THEN 'required: availability is missing or unrecognized' END, CASE WHEN price IS NULL OR code IS NULL OR code = 'XXX' THEN 'required: price is missing (no price, no currency, or unrecognized currency)' END,
        CASE WHEN brand IS NULL AND mpn IS NULL THEN 'required: at least one of brand+mpn, or gtin, must identify the product' END, 'recommended: condition is not set (no condition signal)', 'recommended: google_product_category is not set (no taxonomy match implemented)'], lambda x: x IS NOT NULL)) AS issue FROM rec
    UNION ALL SELECT 'schema_org', unnest(list_filter([CASE WHEN k % 3 <> 0 THEN 'recommended: image is missing (Google Merchant Center requires it)' END, CASE WHEN price IS NULL AND NOT any_stock THEN 'recommended: offers is missing (no price/availability data)' END,
        CASE WHEN price IS NOT NULL AND code IS NULL THEN 'required: offers.priceCurrency is missing while offers.price is present' END, CASE WHEN code = 'XXX' THEN 'warning: offers.priceCurrency ''XXX'' is not a recognized ISO 4217 code' END,
        CASE WHEN sku IS NULL AND mpn IS NULL THEN 'recommended: at least one of sku/gtin/mpn should be present' END], lambda x: x IS NOT NULL)) FROM rec
    UNION ALL SELECT 'industrial', 'recommended: class_name is missing (no predicted category)' FROM rec WHERE k % 9 = 0
) GROUP BY 1, 2""")
def q_feed_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    fed = feeds.map_to_all(records(spark, sf_dir))
    pairs = F.array(*(F.struct(F.lit(f).alias("feed"), F.col(f"{f}_issues").alias("issues")) for f in ("google", "schema_org", "industrial")))
    issues = fed.select(F.explode(pairs).alias("p")).select("p.feed", F.explode("p.issues").alias("issue"))
    return issues.groupBy("feed", "issue").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {CHECKED_SQL} SELECT split_part(i, ':', 1) AS severity, count(*) AS n FROM (SELECT CASE WHEN outcome = 'fail' THEN 'required: ' || attribute WHEN outcome = 'unverifiable' THEN 'warning: ' || header ELSE 'recommended: ' || header END AS i FROM checked) GROUP BY 1")
def q_issue_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    issue = F.when(F.col("outcome") == "fail", F.concat(F.lit("required: "), "attribute")).when(F.col("outcome") == "unverifiable", F.concat(F.lit("warning: "), "header")).otherwise(F.concat(F.lit("recommended: "), "header"))
    return _scored(spark, sf_dir).groupBy(issue_severity(issue).alias("severity")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {CHECKED_SQL} SELECT count(DISTINCT key) AS n_keys, count(*) AS n FROM (SELECT CASE WHEN header IN ('Rated Voltage', 'amperage', 'length', 'Operating Temperature') AND (header IN ('amperage', 'Operating Temperature') OR (unit IS NOT NULL AND base IS NOT NULL)) THEN 'n|' || base || '|' || CAST(round(x, 9) AS VARCHAR) ELSE 's|' || lower(trim(value)) || '|' || coalesce(lower(trim(u)), '') END AS key FROM based)""")
def q_comparable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells(spark, sf_dir).filter(F.trim("value") != "").agg(F.count_distinct(comparable(F.col("value"), F.col("unit"))).alias("n_keys"), F.count(F.lit(1)).alias("n"))


#: Headers made of the parts: each has one of the known names without one of its letters, or with one twice, and its type.
_CHOICES_SQL = "choices AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, '{key}', '{target}', '{kind}')" for k, (key, target, kind) in enumerate(catalog.FUZZY_CHOICES)) + ") t(choice, key, target, kind))"
_HEADERS_SQL = f"""WITH RECURSIVE {_CHOICES_SQL}, aliases AS (
    SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in dims.ALIASES.items())}) v(name, target)
), headers AS (
    SELECT DISTINCT CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN substring(key, 1, p_size % length(key)) || substring(key, p_size % length(key) + 2) ELSE substring(key, 1, p_size % length(key) + 1) || substring(key, p_size % length(key) + 1) END AS header
    FROM part JOIN choices ON choice = p_partkey % {len(catalog.FUZZY_CHOICES)}
), normal AS (
    SELECT header, trim(regexp_replace(lower(header), '[^a-z0-9]+', ' ', 'g')) AS n FROM headers
), exact AS (
    SELECT header, c.target AS core, coalesce(s1.target, s2.target, s3.target) AS spec, n FROM normal
    LEFT JOIN (VALUES {", ".join(f"('{k}', '{v}')" for k, v in dims.CORE_COLUMNS.items())}) c(name, target) ON c.name = n
    LEFT JOIN aliases s1 ON s1.name = lower(trim(header)) LEFT JOIN aliases s2 ON s2.name = replace(lower(trim(header)), ' ', '_') LEFT JOIN aliases s3 ON s3.name = replace(lower(trim(header)), '_', ' ')
), pairs AS (
    SELECT DISTINCT n, choice, key FROM exact, choices WHERE core IS NULL AND spec IS NULL AND 2 * least(length(n), length(key)) >= 0.9 * (length(n) + length(key)) - 1e-9
), blocks AS (
    SELECT n, choice, n AS a, key AS b, 0 AS matched FROM pairs
    UNION ALL
    SELECT n, choice, unnest([substring(a, 1, f.i - 1), substring(a, f.i + f.k)]) AS a, unnest([substring(b, 1, f.j - 1), substring(b, f.j + f.k)]) AS b, unnest([f.k, 0]) AS matched FROM (
        SELECT n, choice, a, b, {{'k': m.k, 'i': -m.i, 'j': -m.j}} AS f FROM (
            SELECT n, choice, a, b, list_max(flatten(list_transform(range(1, length(a) + 1), lambda i: list_transform(range(1, length(b) + 1), lambda j: {{'k': len(list_filter(range(1, least(length(a) - i, length(b) - j) + 2), lambda k: substring(a, i, k) = substring(b, j, k))), 'i': -i, 'j': -j}})))) AS m
            FROM blocks WHERE a <> '' AND b <> ''
        ) WHERE m.k > 0
    )
), ratios AS (
    SELECT n, choice, 2.0 * sum(matched) / (length(n) + any_value(length(key))) AS ratio FROM blocks JOIN choices USING (choice) GROUP BY n, choice
), best AS (
    SELECT n, target, kind, ratio FROM ratios JOIN choices USING (choice) WHERE ratio >= 0.9 QUALIFY row_number() OVER (PARTITION BY n ORDER BY ratio DESC, choice) = 1
), mapped AS (
    SELECT header, CASE WHEN core IS NOT NULL THEN 'core' WHEN spec IS NOT NULL THEN 'spec' ELSE coalesce(kind, 'unmapped') END AS kind, coalesce(core, spec, target, replace(exact.n, ' ', '_')) AS target,
        CASE WHEN core IS NOT NULL OR spec IS NOT NULL THEN 'alias' WHEN target IS NOT NULL THEN 'fuzzy' ELSE 'custom_attribute' END AS method, CASE WHEN core IS NOT NULL OR spec IS NOT NULL THEN 1.0 ELSE coalesce(ratio, 0.0) END AS confidence
    FROM exact LEFT JOIN best ON best.n = exact.n AND core IS NULL AND spec IS NULL
)"""


def part_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = F.array(*(F.lit(key) for key, _, _ in catalog.FUZZY_CHOICES))
    named = table(spark, sf_dir, "part").select("p_partkey", "p_type", "p_size", F.element_at(keys, (F.col("p_partkey") % len(catalog.FUZZY_CHOICES) + 1).cast("int")).alias("key"))
    place = "CAST(p_size % length(key) AS INT)"
    return named.select(F.expr(f"CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN concat(left(key, {place}), substring(key, {place} + 2)) ELSE concat(left(key, {place} + 1), substring(key, {place} + 1)) END").alias("header")).distinct()


@query(f"{_HEADERS_SQL} SELECT header, kind, target, method, round(confidence, 9) AS confidence FROM mapped")
def q_fuzzy_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt names of columns, one for each part, and the parts' types."""
    return catalog.map_columns(part_headers(spark, sf_dir)).withColumn("confidence", F.round("confidence", 9))


@query(f"""{_HEADERS_SQL} SELECT count(*) AS total_columns, array_to_string(list_sort(list(DISTINCT target) FILTER (kind = 'core')), ',') AS mapped_core, count(*) FILTER (kind = 'spec') AS n_spec, md5(string_agg(header, ',' ORDER BY header) FILTER (kind = 'unmapped')) AS unmapped,
    md5(string_agg(header || ':' || target || ':' || method || ':' || CAST(CAST(round(confidence * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY header)) AS details FROM mapped""")
def q_mapping_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    summary = catalog.mapping_summary(catalog.map_columns(part_headers(spark, sf_dir)))
    told = F.transform(F.array_sort(F.map_entries("mapping_details")), lambda e: F.concat_ws(":", e["key"], e["value"]["target"], e["value"]["method"], F.round(e["value"]["confidence"] * 1000000).cast("long").cast("string")))
    return summary.select("total_columns", F.array_join("mapped_core", ",").alias("mapped_core"), F.size("mapped_spec").cast("long").alias("n_spec"), F.md5(F.array_join("unmapped", ",")).alias("unmapped"), F.md5(F.array_join(told, ",")).alias("details"))


@query("SELECT p_partkey AS row_number, p_name AS product_name, p_brand AS brand, CAST(p_retailprice AS DOUBLE) AS price_value, 2 AS n_specs FROM part")
def q_map_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    wide = part.select(F.col("p_partkey").alias("row_number"), F.col("p_name").alias("Item"), F.lit("x").alias("Make"), F.col("p_brand").alias("Mfr"), F.concat(F.lit("$"), F.col("p_retailprice").cast("decimal(12,2)").cast("string")).alias("Price"), F.col("p_size").cast("string").alias("Length"), F.col("p_type").alias("Bin Kind"))
    names = ["Item", "Make", "Mfr", "Price", "Length", "Bin Kind"]
    long = catalog.unpivot_specs(wide, ["row_number"], names).withColumn("file", F.lit("part"))
    mapped = catalog.map_rows(long, catalog.map_columns(spark.createDataFrame([(n,) for n in names], "header string")), ["file"])
    return mapped.select("row_number", "product_name", "brand", "price_value", F.size("specifications").alias("n_specs"))


@query("SELECT DISTINCT h AS header, trim(regexp_replace(lower(h), '[^a-z0-9]+', ' ', 'g')) AS normal FROM (SELECT p_brand || ' / ' || p_type || '_' || p_size AS h FROM part)")
def q_normalize_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(" / "), "p_type", F.lit("_"), F.col("p_size").cast("string")).alias("header")).distinct()
    return h.select("header", normalize_header(F.col("header")).alias("normal"))


#: Parts as raw rows of one catalogue a brand: names, numbers and prices that miss or fail, and the cells without units.
_RAW = {
    "Product Name": "CASE WHEN p_partkey % 3 <> 0 THEN p_name ELSE '  ' END",
    "SKU": "CASE WHEN p_partkey % 5 <> 0 THEN 'SKU-' || CAST(p_partkey AS STRING) ELSE '' END",
    "Price": "CASE WHEN p_partkey % 13 = 0 THEN 'on request' ELSE '$' || CAST(CAST(p_retailprice AS DECIMAL(12, 2)) AS STRING) END",
}
_RAW_CELLS_SQL = "cells AS (" + " UNION ALL ".join(
    f"SELECT p_partkey, p_brand, p_type, {k} AS position, '{h}' AS header, {v.replace('STRING', 'VARCHAR')} AS value, CAST(NULL AS VARCHAR) AS unit, "
    f"'{'needs_review' if h == 'Warehouse Bin' else 'extracted'}' AS status, 'document' AS source_type FROM part"
    for k, (h, v, _) in enumerate(CELLS)
) + ")"
_RAW_COLUMNS_SQL = ", ".join(f"{v.replace('STRING', 'VARCHAR')} AS c{k}" for k, v in enumerate(_RAW.values()))
_RAW_SQL = f"""raw AS (
    SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS INTEGER) AS row_number, {_RAW_COLUMNS_SQL} FROM part
), named_rows AS (
    SELECT *, coalesce(nullif(trim(c0), ''), nullif(c1, '')) AS product_name, TRY_CAST(replace(c2, '$', '') AS DOUBLE) AS price_value FROM raw
)"""
_RECORDS_SQL = f"""WITH {CHECKED_SQL.replace(CELLS_SQL, _RAW_CELLS_SQL)}, {OVERALL_SQL}, {_RAW_SQL}, reviews AS (
    SELECT p_partkey, CAST(sum(CASE WHEN new_status = 'needs_review' THEN 1 ELSE 0 END) AS BIGINT) AS n_review FROM scored GROUP BY 1
)
SELECT p_brand, row_number, product_name, nullif(c1, '') AS sku, price_value, CAST(n AS INTEGER) AS n_specs, n_review, oc AS overall_confidence
FROM named_rows JOIN overall USING (p_partkey) JOIN reviews USING (p_partkey) WHERE product_name IS NOT NULL"""
_WARNINGS_SQL = f"""WITH {_RAW_SQL}
SELECT p_brand, row_number, 'row ' || row_number || CASE
    WHEN product_name IS NULL THEN ': no product name (and no sku/mpn fallback), skipped'
    ELSE ': could not parse price ' || chr(39) || c2 || chr(39) END AS warning
FROM named_rows WHERE product_name IS NULL OR price_value IS NULL"""


def _raw_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    headers = [*_RAW, *(h for h, _, _ in CELLS)]
    top = part.select("p_brand").distinct().select("p_brand", F.lit(-1).cast("long").alias("n"), F.array(*map(F.lit, headers)).alias("cells"))
    values = F.array(*(F.expr(v) for v in _RAW.values()), *(F.expr(v) for _, v, _ in CELLS))
    body = part.select("p_brand", F.col("p_partkey").cast("long").alias("n"), values.alias("cells"))
    order = Window.partitionBy("p_brand").orderBy("n")
    return top.unionByName(body).select("p_brand", (F.row_number().over(order) - 1).alias("row_index"), "cells")


@query(_RECORDS_SQL)
def q_catalog_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = flow.catalog_records(_raw_catalogs(spark, sf_dir), ["p_brand"], F.col("p_brand"))
    review = F.size(F.filter("specifications", lambda s: s["status"] == "needs_review")).cast("long")
    return found.select(
        "p_brand", "row_number", "product_name", "identifiers.sku", F.col("price.value").alias("price_value"),
        F.size("specifications").alias("n_specs"), review.alias("n_review"), "overall_confidence",
    )


@query(_WARNINGS_SQL)
def q_catalog_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flow.catalog_records(_raw_catalogs(spark, sf_dir), ["p_brand"], F.col("p_brand"))[1]


@query(f"""SELECT p_brand, 1 + ascii(right(p_brand, 1)) % 3 AS header_row, '{'|'.join([*_RAW, *(h for h, _, _ in CELLS)])}' AS headers FROM (SELECT DISTINCT p_brand FROM part)""")
def q_header_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's catalogue, below none, one or two rows of other text."""
    raw = _raw_catalogs(spark, sf_dir)
    shift = F.ascii(F.right("p_brand", F.lit(1))) % 3
    brands = raw.select("p_brand").distinct().withColumn("row_index", F.explode(F.filter(F.array(F.lit(0), F.lit(1)), lambda k: k < shift)))
    top = brands.select("p_brand", "row_index", F.array(F.concat(F.lit("Catalogue of "), "p_brand"), F.lit(None).cast("string"), F.lit("")).alias("cells"))
    return catalog.detect_header(top.unionByName(raw.withColumn("row_index", F.col("row_index") + shift)), ["p_brand"]).select("p_brand", "header_row", F.array_join("headers", "|").alias("headers"))


@query(f"""WITH {_RAW_SQL}
SELECT p_brand, 1 AS header_row, count(*) AS total_rows, count(product_name) AS accepted_rows, count(*) - count(product_name) AS rejected_rows, count(*) FILTER (product_name IS NULL OR price_value IS NULL) AS n_warnings, {len([*_RAW, *CELLS])} AS n_columns,
    md5(string_agg(product_name, '|' ORDER BY row_number)) AS names FROM named_rows GROUP BY p_brand""")
def q_envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every brand's catalogue written as one object of items and statistics, and read again."""
    heads, items = flow.catalog_envelopes(_raw_catalogs(spark, sf_dir), ["p_brand"], F.col("p_brand"))
    at = scratch_dir(spark, "envelopes")
    feeds.write_objects(heads, items.select("p_brand", "row_number", "product_name", "google", "google_issues"), ["p_brand"], "row_number", at)
    back = feeds.read_objects(spark, at, "p_brand string, header_row int, total_rows long, accepted_rows long, rejected_rows long, row_warnings array<string>, column_mapping map<string, struct<target: string>>, items array<struct<row_number: int, product_name: string>>")
    names = F.md5(F.array_join(F.transform("items", lambda x: x["product_name"]), "|"))
    return back.select("p_brand", "header_row", "total_rows", "accepted_rows", "rejected_rows", F.size("row_warnings").cast("long").alias("n_warnings"), F.size("column_mapping").alias("n_columns"), names.alias("names"))


@query(f"""WITH {CHECKED_SQL} SELECT p_partkey, header, outcome, CASE
    WHEN attribute IS NULL THEN chr(39) || header || chr(39) || ' is not in the attribute dictionary'
    WHEN attribute = 'ip_rating' THEN chr(39) || value || chr(39) || CASE outcome WHEN 'pass' THEN ' matches expected format' ELSE ' does not match expected format for ip_rating' END
    WHEN attribute = 'thread_size' THEN chr(39) || value || chr(39) || CASE outcome WHEN 'pass' THEN ' matches expected format' ELSE ' does not match expected format for thread_size' END
    WHEN attribute = 'material' THEN chr(39) || value || chr(39) || CASE outcome WHEN 'pass' THEN ' is a known material value' ELSE ' is not a recognized material value' END
    WHEN num IS NULL THEN 'could not parse ' || chr(39) || value || chr(39) || ' as a number'
    WHEN outcome = 'unverifiable' THEN 'unrecognized unit ' || chr(39) || u || chr(39) || ' for ' || attribute
    WHEN outcome = 'fail' AND x <= low THEN CAST(x AS VARCHAR) || ' is below minimum ' || CAST(low AS VARCHAR) || ' ' || hint
    WHEN outcome = 'fail' THEN CAST(x AS VARCHAR) || ' is above maximum ' || CAST(high AS VARCHAR) || ' ' || hint
    ELSE CAST(x AS VARCHAR) || ' within [' || CAST(low AS VARCHAR) || ', ' || coalesce(CAST(high AS VARCHAR), 'None') || ']' END AS reason
FROM checked LEFT JOIN (VALUES {", ".join(f"('{a.name}', CAST({a.low if a.low is not None else 'NULL'} AS DOUBLE), CAST({a.high if a.high is not None else 'NULL'} AS DOUBLE), '{dims.HINTS.get(a.name, '')}')" for a in dims.ATTRIBUTES)}) t(name, low, high, hint) ON name = attribute""")
def q_check_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("p_partkey", "header", "check.outcome", "check.reason")

"""Blocks, groundedness, snippets, citations, merging and the web over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.specs import classify_spec, grounded
from ..functions.text import block_id, iso8601, normalize_whitespace, significant_words, snippet, split_on_match, strip_code_fences
from ..operators import blocks, citations, compare, extract, links, merge, validate
from ..sources.formats import html_blocks
from .base import LINES_SQL, OFFERS_SQL, WORDS, lines, offers, query, spread, table

@query(f"SELECT item_id, len({WORDS.format('text')}) AS n_words, list_sum(list_transform({WORDS.format('text')}, lambda w: length(w)))::BIGINT AS chars FROM benchmark")
def q_significant_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "benchmark").withColumn("w", significant_words(F.col("text")))
    return w.select("item_id", F.size("w").cast("long").alias("n_words"), F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + F.length(x)).alias("chars"))


@query(f"SELECT doc_id, len(v) = 0 OR len(list_intersect(v, b)) / len(v) >= 0.6 AS grounded FROM (SELECT d.doc_id, {WORDS.format('c.text')} AS v, {WORDS.format('d.text')} AS b FROM documents d JOIN documents c ON c.doc_id = d.doc_id + d.doc_id % 2)")
def q_groundedness(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.col("text").alias("value"))
    return docs.join(claims, F.col("claim_id") == F.col("doc_id") + F.col("doc_id") % 2).select("doc_id", grounded(F.col("value"), F.col("text")).alias("grounded"))


@query("""WITH t AS (SELECT doc_id, '[' || source || '] ' || trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t, lang AS needle FROM documents), p AS (SELECT *, position(lower(needle) IN lower(t)) - 1 AS spot FROM t), w AS (SELECT *, greatest(0, spot - 66) AS s FROM p)
SELECT doc_id, CASE WHEN length(t) <= 200 THEN t WHEN spot >= 0 THEN substr(
    CASE WHEN s + 200 < length(t) THEN rtrim(CASE WHEN s > 0 THEN '…' || substr(substr(t, s + 1, 200), 2) ELSE substr(t, s + 1, 200) END) || '…' ELSE CASE WHEN s > 0 THEN '…' || substr(substr(t, s + 1, 200), 2) ELSE substr(t, s + 1, 200) END END, 1, 200)
    ELSE rtrim(substr(t, 1, 199)) || '…' END AS snippet FROM w""")
def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", snippet(F.col("text"), F.col("source"), F.col("lang")).alias("snippet"))


@query("SELECT doc_id, md5(trim(regexp_replace(regexp_replace(text, '[ \\t]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS digest FROM documents")
def q_normalize_ws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(normalize_whitespace(F.col("text"))).alias("digest"))


@query(f"WITH {LINES_SQL} SELECT doc_id, pos, type, printf('b%04d', pos) AS block_id, md5(last_value(CASE WHEN type = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)) AS section FROM lines")
def q_running_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.with_block_ids(blocks.running_section(lines(spark, sf_dir)))
    return b.select("doc_id", "pos", "type", "block_id", F.md5("section").alias("section"))


@query(f"WITH {LINES_SQL}, n AS (SELECT *, sum(length(text)) OVER w AS chars, row_number() OVER w AS k FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)), f AS (SELECT *, k <= 200 AND chars <= 100000 AS fits FROM n) SELECT doc_id, count(*) AS n_blocks, max(chars)::BIGINT AS chars, bool_or(cut) AS truncated FROM (SELECT *, bool_or(NOT fits) OVER (PARTITION BY doc_id) AS cut FROM f) WHERE fits GROUP BY doc_id")
def q_source_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks.bounded_payload(lines(spark, sf_dir))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_blocks"), F.max("chars").alias("chars"), F.bool_or("truncated").alias("truncated"))


@query("SELECT conv_id AS doc_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY turn)) AS digest, count(*) AS n_blocks FROM conversations GROUP BY 1")
def q_raw_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "text")
    return blocks.raw_text(turns).select("doc_id", F.md5("raw_text").alias("digest"), "n_blocks")



@query("SELECT conv_id AS doc_id, md5('Names: coating, current_rating, ip_rating, length, material, operating_temp, tensile_strength, thread_size, voltage_rating, weight' || chr(10) || 'Target JSON schema:' || chr(10) || '{}' || chr(10) || chr(10) || 'Source: conversation ' || conv_id || chr(10) || 'Content blocks:' || chr(10) || string_agg('[' || printf('b%04d', turn) || '] TEXT (section ''' || role || '''): ' || text, chr(10) || chr(10) ORDER BY turn) || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def q_prompt_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), block_id(F.col("turn")).alias("block_id"), F.lit("text").alias("type"), "text", F.lit(None).cast("array<array<string>>").alias("table"),
        F.lit(None).cast("int").alias("page"), F.col("role").alias("section"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("source"),
    )
    return blocks.prompts(turns, "Names: {canonical_names}", "{}").select("doc_id", F.md5("prompt").alias("digest"))


@query("SELECT doc_id, CASE WHEN spot > 0 THEN substr(t, spot, 3) ELSE '' END AS match, CASE WHEN spot > 0 THEN spot - 1 ELSE length(t) END AS n_before FROM (SELECT doc_id, text AS t, position('the' IN lower(text)) AS spot FROM documents)")
def q_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "documents").withColumn("s", split_on_match(F.col("text"), F.lit("THE")))
    return s.select("doc_id", "s.match", F.length("s.before").cast("long").alias("n_before"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN strftime(ts, '%f') = '000000' THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00' AS at FROM events")
def q_iso_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", iso8601(F.col("ts")).alias("at"))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 10 AS k, count(*) AS n FROM events GROUP BY 1, 2")
def q_json_custom_attrs(spark: SparkSession, sf_dir: str) -> DataFrame:
    fenced = F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```"))
    k = F.try_variant_get(F.try_parse_json(strip_code_fences(fenced)), "$.k", "long")
    return table(spark, sf_dir, "events").groupBy("event_type", (k % 10).alias("k")).agg(F.count(F.lit(1)).alias("n"))


_HREF = "regexp_extract_all(html, '<a\\s[^>]*href=\"([^\"]*)\"', 1)"


@query(f"SELECT page_id, unnest(range(0, len({_HREF}))) AS pos, unnest({_HREF}) AS href FROM pages")
def q_html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.extract_links(table(spark, sf_dir, "pages")).select("page_id", "pos", "href")


@query(f"SELECT link, count(*) AS n_seen, min(page_id) AS first_page FROM (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || h AS link FROM (SELECT page_id, url, unnest({_HREF}) AS h FROM pages) WHERE h LIKE '/%') WHERE regexp_matches(link, '/[A-Z][a-z]+$') GROUP BY 1")
def q_link_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.product_links(links.extract_links(table(spark, sf_dir, "pages")), "/[A-Z][a-z]+$").select("link", "n_seen", "first_page")


@query(f"WITH l AS (SELECT DISTINCT h AS link FROM (SELECT unnest({_HREF}) AS h FROM pages)), t AS (SELECT count(*) AS total FROM l) SELECT link, 15 < total AS has_more FROM (SELECT link FROM l ORDER BY link LIMIT 10 OFFSET 5), t")
def q_page_paging(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = links.extract_links(table(spark, sf_dir, "pages")).select(F.col("href").alias("link")).distinct()
    page, more = links.page_of(found, 10, 5, ["link"])
    return page.withColumn("total", F.lit(found.count())).select("link", more.alias("has_more"))


@query("SELECT page_id, length(html) < 2000 AS thin FROM pages")
def q_thin_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", links.is_thin(F.col("html")).alias("thin"))


@query()
def q_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_blocks(table(spark, sf_dir, "pages")).select("doc_id", "pos", "type", "text", "section")


@query()
def q_crawl(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return links.crawl(links.extract_links(pages).select("url", "link"), pages.select("url").distinct())


@query(f"WITH {LINES_SQL}, claim AS (SELECT doc_id, pos, 'note' AS attribute, text AS value, printf('b%04d', CASE WHEN pos % 4 = 3 THEN pos + 1 ELSE pos END) AS block FROM lines), b AS (SELECT doc_id, printf('b%04d', pos) AS block, text FROM lines), j AS (SELECT c.doc_id, c.pos, c.value, c.block, b.text IS NOT NULL AS found FROM claim c LEFT JOIN b ON c.doc_id = b.doc_id AND c.block = b.block), k AS (SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS k FROM j WHERE found GROUP BY 1, 2) SELECT j.doc_id, j.pos, coalesce('src-' || (k.k + 1), j.block) AS reference, CASE WHEN found THEN 0.9 ELSE 0.3 END::DOUBLE AS confidence, CASE WHEN found THEN 'extracted' ELSE 'needs_review' END AS status, md5(value) AS value FROM j LEFT JOIN k ON j.doc_id = k.doc_id AND j.block = k.block")
def q_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs, _ = _cited(spark, sf_dir)
    return specs.select("doc_id", "pos", "reference", "confidence", "status", F.md5("value").alias("value"))


def _cited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every line of every document as a claim that cites itself, or in one of four cases the line after it."""
    b = lines(spark, sf_dir)
    block = b.select("doc_id", block_id(F.col("pos")).alias("block_id"), "pos", "text", F.lit(None).cast("array<array<string>>").alias("table"), F.lit(None).cast("string").alias("section"), F.lit(None).cast("int").alias("page"))
    specs = b.select("doc_id", "pos", F.lit("note").alias("attribute"), F.col("text").alias("value"), F.lit("extracted").alias("status"), F.lit(0.9).alias("confidence"), block_id(F.when(F.col("pos") % 4 == 3, F.col("pos") + 1).otherwise(F.col("pos"))).alias("reference"))
    sources = table(spark, sf_dir, "documents").select("doc_id", F.lit(0).alias("pos"), F.lit("src-1").alias("id"), F.lit("document").alias("type"), F.col("source").alias("reference"), F.lit(None).cast("int").alias("page"))
    return citations.resolve_citations(specs, block, sources)


@query(f"WITH {LINES_SQL}, c AS (SELECT doc_id, printf('b%04d', CASE WHEN pos % 4 = 3 THEN pos + 1 ELSE pos END) AS block FROM lines), b AS (SELECT doc_id, printf('b%04d', pos) AS block FROM lines) SELECT doc_id, count(DISTINCT block) AS n_sources FROM c SEMI JOIN b ON c.doc_id = b.doc_id AND c.block = b.block GROUP BY doc_id")
def q_cited_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sources = _cited(spark, sf_dir)
    return sources.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_sources"))


@query(f"WITH {LINES_SQL}, s AS (SELECT doc_id, pos, text AS value, pos + CASE WHEN pos % 3 = 2 THEN 1 ELSE 0 END AS target FROM lines), j AS (SELECT s.doc_id, s.pos, {WORDS.format('s.value')} AS v, CASE WHEN l.text IS NULL THEN NULL ELSE {WORDS.format('l.text')} END AS b, lower(trim(s.value)) IN ('yes', 'no', 'true', 'false', 'n/a', 'na', 'none', 'present', 'absent') AS flag FROM s LEFT JOIN lines l ON s.doc_id = l.doc_id AND s.target = l.pos) SELECT doc_id, pos, b IS NULL OR NOT (flag OR len(v) = 0 OR len(list_intersect(v, b)) / len(v) >= 0.6) AS ungrounded FROM j")
def q_score_with_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = lines(spark, sf_dir)
    block = b.select("doc_id", block_id(F.col("pos")).alias("block_id"), "pos", "text", F.lit(None).cast("array<array<string>>").alias("table"))
    specs = b.select("doc_id", "pos", F.lit("note").alias("attribute"), F.col("text").alias("value"), F.lit(None).cast("string").alias("unit"), F.lit("extracted").alias("status"), F.lit("document").alias("source_type"), block_id(F.col("pos") + F.when(F.col("pos") % 3 == 2, 1).otherwise(0)).alias("reference"))
    return validate.score_with_blocks(specs, block).select("doc_id", "pos", "ungrounded")


@query(f"WITH {OFFERS_SQL} SELECT product, record_ord, CASE WHEN reference IS NULL THEN NULL ELSE 'src-' || record_ord END AS reference, count(*) AS n FROM specs GROUP BY 1, 2, 3")
def q_merge_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = offers(spark, sf_dir)
    sources = specs.select("product", "record_ord", F.lit(0).alias("pos"), F.lit("src-1").alias("id")).distinct()
    return merge.pool_specs(specs, merge.renumber_sources(sources)).groupBy("product", "record_ord", "reference").agg(F.count(F.lit(1)).alias("n"))


_KEYED = f"{OFFERS_SQL}, keyed AS (SELECT *, CASE WHEN attribute = 'length' THEN CAST(round(TRY_CAST(regexp_extract(value, '[0-9]+') AS DOUBLE) * CASE WHEN unit = 'cm' THEN 10 ELSE 1 END, 9) AS VARCHAR) ELSE lower(trim(value)) END AS key FROM specs), conflicting AS (SELECT product, attribute, count(DISTINCT key) AS n_values, count(*) AS n_specs, array_to_string(list(value ORDER BY record_ord, pos), '|') AS vals, count(reference) AS n_sources FROM keyed GROUP BY 1, 2 HAVING count(DISTINCT key) > 1)"


@query(f"WITH {_KEYED} SELECT product, attribute, n_values, n_specs, vals, n_sources FROM conflicting")
def q_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = merge.conflicts(offers(spark, sf_dir))
    return found.select("product", "attribute", "n_values", "n_specs", F.array_join("values", "|").alias("vals"), F.size("sources").cast("long").alias("n_sources"))


#: The exact mean of confidences to two places by its binary value, for each product.
_MEAN = "CAST(sum(CAST(confidence AS DECIMAL(20,12))) AS DOUBLE) / count(*)"
_MEANS = f"SELECT product, CASE WHEN t % 2 <> 1 OR abs(x * 200 - t) >= 1e-9 THEN round(x, 2) WHEN ((x * 128 - t) + x * 64) + x * 8 > 0 THEN (t + 1) / 200 WHEN ((x * 128 - t) + x * 64) + x * 8 < 0 THEN (t - 1) / 200 WHEN (t + 1) % 4 = 0 THEN (t + 1) / 200 ELSE (t - 1) / 200 END AS overall_confidence, n_specs FROM (SELECT product, {_MEAN} AS x, round({_MEAN} * 200) AS t, count(*) AS n_specs FROM {{}} GROUP BY 1)"


@query(f"WITH {OFFERS_SQL} {_MEANS.format('specs')}")
def q_merged_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merged_confidence(offers(spark, sf_dir))


@query(f"WITH {_KEYED} SELECT CASE WHEN c.product IS NOT NULL THEN 'conflict' WHEN s.status IN ('needs_review', 'inferred') THEN 'unverified' ELSE 'grounded' END AS class, count(*) AS n FROM specs s LEFT JOIN conflicting c ON s.product = c.product AND s.attribute = c.attribute GROUP BY 1")
def q_classify_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = offers(spark, sf_dir)
    flagged = merge.flag_conflicts(specs, merge.conflicts(specs))
    return flagged.groupBy(classify_spec(F.col("status"), F.col("conflicting")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_KEYED}, l AS (SELECT product, attribute, array_to_string(list(value ORDER BY value), '|') AS v FROM specs WHERE record_ord % 2 = 0 AND product % 3 <> 0 GROUP BY 1, 2), r AS (SELECT product, attribute, array_to_string(list(value ORDER BY value), '|') AS v FROM specs WHERE record_ord % 2 = 1 AND product % 3 <> 1 GROUP BY 1, 2) SELECT coalesce(l.product, r.product, c.product) AS product, coalesce(l.attribute, r.attribute, c.attribute) AS attribute, l.v AS left_values, r.v AS right_values, CASE WHEN c.product IS NOT NULL THEN 'CONFLICT' WHEN l.v IS NOT NULL OR r.v IS NOT NULL THEN 'AGREEMENT / VERIFIED' ELSE 'UNVERIFIED' END AS verdict FROM l FULL JOIN r ON l.product = r.product AND l.attribute = r.attribute FULL JOIN conflicting c ON coalesce(l.product, r.product) = c.product AND coalesce(l.attribute, r.attribute) = c.attribute")
def q_compare_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = offers(spark, sf_dir)
    left, right = specs.filter("record_ord % 2 = 0 AND product % 3 <> 0"), specs.filter("record_ord % 2 = 1 AND product % 3 <> 1")
    grid = merge.compare_grid(left, right, merge.conflicts(specs))
    return grid.select("product", "attribute", F.array_join("left_values", "|").alias("left_values"), F.array_join("right_values", "|").alias("right_values"), "verdict")


@query(f"WITH {OFFERS_SQL}, ranked AS (SELECT *, row_number() OVER (PARTITION BY product, attribute ORDER BY record_ord, pos) - 1 AS rank FROM specs), kept AS (SELECT product, attribute, CASE WHEN product % 2 = 0 AND attribute = 'length' THEN 0.97 ELSE confidence END AS confidence FROM ranked WHERE NOT (product % 2 = 0 AND attribute = 'length') OR rank = 1) {_MEANS.format('kept')}")
def q_resolve_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    specs = offers(spark, sf_dir)
    decisions = specs.filter("product % 2 = 0").select("product", F.lit("length").alias("attribute"), F.lit(1).alias("winner")).distinct()
    return merge.merged_confidence(merge.resolve(specs, decisions)).select("product", "n_specs", "overall_confidence")


@query("WITH o AS (SELECT p_partkey AS doc_id, p_partkey % 4 AS page, CAST(p_size AS DOUBLE) AS x0, p_size + 2.0 AS x1, CAST(p_partkey % 90 AS DOUBLE) AS top, p_partkey % 90 + 4.0 AS bottom FROM part) SELECT doc_id % 100 AS g, count(*) AS n FROM o WHERE NOT (page % 2 = 0 AND 10 <= (x0 + x1) / 2 AND (x0 + x1) / 2 < 30 AND 20 <= (top + bottom) / 2 AND (top + bottom) / 2 < 50) GROUP BY 1")
def q_outside_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    objects = table(spark, sf_dir, "part").select(key.alias("doc_id"), (key % 4).alias("page"), F.col("p_size").cast("double").alias("x0"), (F.col("p_size") + 2.0).alias("x1"), (key % 90).cast("double").alias("top"), (key % 90 + 4.0).alias("bottom"))
    boxes = objects.filter("page % 2 = 0").select("doc_id", "page", F.lit(10.0).alias("x0"), F.lit(30.0).alias("x1"), F.lit(20.0).alias("top"), F.lit(50.0).alias("bottom"))
    return blocks.outside_boxes(objects, boxes).groupBy((F.col("doc_id") % 100).alias("g")).agg(F.count(F.lit(1)).alias("n"))


@query()
def q_extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = spread(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), "p_partkey")
    text = F.concat(F.lit("Content blocks:\n[b0000] TEXT: Product name: "), "p_name", F.lit("\n\n[b0001] TEXT: Rated Voltage: "), F.col("p_size").cast("string"), F.lit("V\n"))
    prompts = parts.select(F.col("p_partkey").alias("doc_id"), F.when(F.col("p_partkey") % 10 != 0, text).otherwise("Content blocks:\n").alias("prompt"))
    found = extract.extract_records(prompts, lambda: extract.Retrying(extract.Fallback([extract.KeyValueClient()]), pause=0))
    return found.select("doc_id", "product_name", F.size("specifications").alias("n_specs"), "attempts", F.col("error").isNotNull().alias("failed"))


@query("SELECT doc_id, max(CASE WHEN k = 1 THEN l END) AS first_long FROM (SELECT doc_id, l, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(0, len(string_split(text, chr(10))))) AS pos FROM documents) WHERE length(l) >= 40) GROUP BY 1")
def q_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    long = lines(spark, sf_dir).filter("type = 'text'").withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos")))
    return long.filter("k = 1").select("doc_id", F.col("text").alias("first_long"))


@query("SELECT p_partkey AS doc_id, CASE p_partkey % 3 WHEN 0 THEN 'src-1' WHEN 1 THEN 'b0001' END AS reference, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN 'b0001' END AS source_label, p_partkey % 3 = 0 AND p_partkey % 5 <> 0 AS has_citation, CAST(round(p_size / 50.0 * 100) AS INTEGER) AS shown FROM part")
def q_source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, key = table(spark, sf_dir, "part"), F.col("p_partkey")
    specs = part.select(key.alias("doc_id"), F.when(key % 3 == 0, "src-1").when(key % 3 == 1, "b0001").alias("reference"), F.when(key % 5 == 0, "needs_review").otherwise("extracted").alias("status"), (F.col("p_size") / 50.0).alias("confidence"))
    sources = part.select(key.alias("doc_id"), F.lit("src-1").alias("id"), F.col("p_brand").alias("reference"))
    return compare.with_source_labels(specs, sources).select("doc_id", "reference", "source_label", "has_citation", compare.percent(F.col("confidence")).alias("shown"))


@query("""WITH i AS (
    SELECT CASE WHEN p_partkey % 12 IN (2, 3) THEN -p_partkey ELSE p_partkey // 4 END AS pair, CASE WHEN p_partkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, CASE WHEN p_partkey % 12 IN (2, 3) THEN 0 ELSE (p_partkey % 4) // 2 END AS item, p_name FROM part
), s AS (
    SELECT pair, max(n) AS most, max(item) AS last FROM (SELECT pair, side, count(*) AS n, max(item) AS item FROM i GROUP BY 1, 2) GROUP BY 1
), j AS (
    SELECT i.*, i.pair % 5 <> 0 AS picked, most, last FROM i JOIN s ON i.pair = s.pair
) SELECT pair, side, CAST(item AS INTEGER) AS item, p_name, CASE WHEN NOT picked AND most > 1 THEN 'candidate' ELSE 'chosen' END AS role FROM j WHERE (NOT picked AND most > 1) OR item = CASE WHEN picked AND side = 'left' THEN last ELSE 0 END""")
def q_compare_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All parts as items of pairs of files: pairs of one item, of two sides with one or two each, with and without a pick."""
    key = F.col("p_partkey")
    single = (key % 12).isin(2, 3)
    items = table(spark, sf_dir, "part").select(F.when(single, -key).otherwise(F.floor(key / 4)).alias("pair"), F.when(key % 2 == 0, "left").otherwise("right").alias("side"), F.when(single, 0).otherwise(F.floor(key % 4 / 2)).cast("int").alias("item"), "p_name")
    most = items.groupBy("pair").agg(F.max("item").alias("last"))
    picks = most.filter("pair % 5 <> 0").select("pair", F.col("last").alias("left_item"), F.lit(0).alias("right_item"))
    chosen, candidates = compare.choose_items(items, picks)
    return chosen.withColumn("role", F.lit("chosen")).unionByName(candidates.withColumn("role", F.lit("candidate")))

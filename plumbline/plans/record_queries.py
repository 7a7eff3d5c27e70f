"""Whole records: merged from two sources, resolved, and fed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..dims import UNGROUNDED_PENALTY
from ..functions.text import block_id, iso8601
from ..operators import feeds, flow, merge
from ..operators.constraints import INTEGER, NUMBER, OBJECT, STRING, Constraint, faults, told
from ..sources.tables import kept
from .base import CHECKED_SQL, LINES_SQL, POOLED_SQL, WORDS, lines, paired_records, query, table

#: Two places of `x` by its binary value, as in base.OVERALL_SQL, from a table that has x and t = round(x * 200).
ROUND2 = "CASE WHEN t % 2 <> 1 OR abs(x * 200 - t) >= 1e-9 THEN round(x, 2) WHEN ((x * 128 - t) + x * 64) + x * 8 > 0 THEN (t + 1) / 200 WHEN ((x * 128 - t) + x * 64) + x * 8 < 0 THEN (t - 1) / 200 WHEN (t + 1) % 4 = 0 THEN (t + 1) / 200 ELSE (t - 1) / 200 END"

_CLASH = f"""WITH {CHECKED_SQL}, {POOLED_SQL}, clash AS (
    SELECT product, string_agg(value, '|' ORDER BY record_ord) AS vals FROM pooled WHERE attribute = 'length' GROUP BY product HAVING min(TRY_CAST(value AS DOUBLE)) <> max(TRY_CAST(value AS DOUBLE))
)"""
_MEAN = "CAST(sum(CAST(confidence AS DECIMAL(20,12))) AS DOUBLE) / count(*)"


@query(f"""{_CLASH}, means AS (
    SELECT product, {_MEAN} AS x, round({_MEAN} * 200) AS t, count(*) AS n_specs, count(*) FILTER (status = 'needs_review' OR attribute = 'length' AND product IN (SELECT product FROM clash)) AS n_review FROM pooled GROUP BY product
)
SELECT means.product, n_specs, n_review, {ROUND2} AS overall_confidence, CASE WHEN vals IS NULL THEN '' ELSE 'length:' || vals || ':src-1|src-2' END AS conflicts, CAST(2 AS BIGINT) AS n_sources,
    p_name AS product_name, CASE WHEN means.product % 7 = 0 THEN 'Site brand' ELSE p_brand END AS brand, CASE WHEN means.product % 7 = 0 THEN 1 ELSE 0 END AS brand_from,
    'https://site.example.com/' || means.product AS site, 'src-1|src-2' AS cited
FROM means JOIN part ON p_partkey = means.product LEFT JOIN clash ON clash.product = means.product""")
def q_merged_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's record merged with its website's; fields that the part leaves empty come from the site."""
    merged = merge.merge_records(paired_records(spark, sf_dir), fill=True)
    conflict = F.transform("conflicts", lambda c: F.concat_ws(":", c["attribute"], F.array_join(c["values"], "|"), F.array_join(c["sources"], "|")))
    cited = F.array_sort(F.array_distinct(F.transform("specifications", lambda s: s["source"]["reference"])))
    return merged.select(
        "product", F.size("specifications").cast("long").alias("n_specs"), F.size(F.filter("specifications", lambda s: s["status"] == "needs_review")).cast("long").alias("n_review"), "overall_confidence",
        F.array_join(conflict, ";").alias("conflicts"), F.size("sources").cast("long").alias("n_sources"), "product_name", "brand", F.col("provenance.brand").alias("brand_from"), F.get("sources", 1)["reference"].alias("site"), F.array_join(cited, "|").alias("cited"),
    )


@query(f"""{_CLASH}, kept AS (
    SELECT pooled.product, CASE WHEN decided THEN 0.97 ELSE confidence END AS confidence, CASE WHEN decided THEN 'extracted' WHEN clashed THEN 'needs_review' ELSE status END AS status, clashed AND NOT decided AS still
    FROM (SELECT *, attribute = 'length' AND product IN (SELECT product FROM clash) AS clashed, attribute = 'length' AND product % 4 = 0 AND product IN (SELECT product FROM clash) AS decided FROM pooled) pooled WHERE NOT decided OR record_ord = 1
), means AS (
    SELECT product, {_MEAN} AS x, round({_MEAN} * 200) AS t, count(*) AS n_specs, count(*) FILTER (status = 'needs_review') AS n_review, CAST(max(CAST(still AS INT)) AS BIGINT) AS n_conflicts FROM kept GROUP BY product
)
SELECT product, n_specs, n_review, n_conflicts, overall_confidence, CASE WHEN overall_confidence >= 0.8 THEN 'high' WHEN overall_confidence >= 0.5 THEN 'medium' ELSE 'low' END AS custom_label_0, n_specs AS n_features FROM (SELECT *, {ROUND2} AS overall_confidence FROM means)""")
def q_resolved_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merged records after decisions on some lengths, and what their feeds then say."""
    merged = kept(merge.merge_records(paired_records(spark, sf_dir)))
    decisions = merged.filter("product % 4 = 0").select("product", F.lit("length").alias("attribute"), F.lit(1).alias("winner"))
    fed = feeds.map_to_all(merge.resolve_records(merged, decisions))
    review = F.size(F.filter("specifications", lambda s: s["status"] == "needs_review"))
    return fed.select("product", F.size("specifications").cast("long").alias("n_specs"), review.cast("long").alias("n_review"), F.size("conflicts").cast("long").alias("n_conflicts"), "overall_confidence", "google.custom_label_0", F.size("industrial.features").cast("long").alias("n_features"))


_CLAIMS = f"""WITH {LINES_SQL}, claims AS (
    SELECT l.doc_id, l.pos, l.text AS value, l.pos + CASE WHEN l.pos % 3 = 2 THEN 1 ELSE 0 END AS target, b.text AS cited FROM lines l LEFT JOIN lines b ON b.doc_id = l.doc_id AND b.pos = l.pos + CASE WHEN l.pos % 3 = 2 THEN 1 ELSE 0 END
), worded AS (
    SELECT *, {WORDS.format('value')} AS v, {WORDS.format("coalesce(cited, '')")} AS b, lower(trim(value)) IN ('yes', 'no', 'true', 'false', 'n/a', 'na', 'none', 'present', 'absent') AS flag FROM claims
), scored AS (
    SELECT *, greatest(0.0, least(1.0, CAST(0.85 AS DOUBLE) * CAST(1.0 AS DOUBLE) - CAST(0.05 AS DOUBLE) - CASE WHEN cited IS NULL OR NOT (flag OR len(v) = 0 OR len(list_intersect(v, b)) / len(v) >= 0.6) THEN CAST({UNGROUNDED_PENALTY} AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)) AS confidence FROM worded
), means AS (
    SELECT doc_id, list_reduce(list_prepend(CAST(0 AS DOUBLE), list(confidence ORDER BY pos)), lambda a, x: a + x) / count(*) AS x, count(*) AS n_specs FROM scored GROUP BY doc_id
), cites AS (
    SELECT doc_id, target, row_number() OVER (PARTITION BY doc_id ORDER BY min(pos)) AS k FROM scored WHERE cited IS NOT NULL GROUP BY doc_id, target
), told AS (
    SELECT s.doc_id, md5(string_agg(coalesce('src-' || (k + 1), printf('b%04d', s.target)), ',' ORDER BY pos)) AS cited, count(*) FILTER (k IS NULL) AS n_lost, CAST(coalesce(max(k), 0) AS BIGINT) AS n_cited FROM scored s LEFT JOIN cites c ON c.doc_id = s.doc_id AND c.target = s.target GROUP BY s.doc_id
)
SELECT d.doc_id, 'Document ' || d.doc_id AS product_name, n_specs, CASE WHEN n_cited = 0 THEN 1 ELSE n_cited END AS n_sources, n_lost, cited, {ROUND2} AS overall_confidence, '2024-01-02T00:00:00+00:00' AS modified
FROM (SELECT *, round(x * 200) AS t FROM means) m JOIN told ON told.doc_id = m.doc_id JOIN documents d ON d.doc_id = m.doc_id"""


@query(_CLAIMS)
def q_document_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all documents, every line a specification that cites itself or in one of three cases the line after it."""
    b = lines(spark, sf_dir)
    none = lambda kind: F.lit(None).cast(kind)
    held = b.select("doc_id", block_id(F.col("pos")).alias("block_id"), "pos", "text", none("array<array<string>>").alias("table"), none("string").alias("section"), none("int").alias("page"))
    to = block_id(F.col("pos") + F.when(F.col("pos") % 3 == 2, 1).otherwise(0))
    spec = F.struct("pos", F.struct(F.lit("note").alias("attribute"), F.col("text").alias("value"), none("string").alias("unit"), F.lit("extracted").alias("status"), to.alias("reference")).alias("spec"))
    extracted = b.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(spec)), lambda x: x["spec"]).alias("specifications")).withColumn("product_name", F.concat(F.lit("Document "), F.col("doc_id").cast("string")))
    files = table(spark, sf_dir, "documents").select("doc_id", F.lit("document").alias("type"), F.col("source").alias("reference"))
    records = flow.document_records(extracted, held, files, F.lit("2024-01-02 00:00:00").cast("timestamp"))
    cited = F.md5(F.array_join(F.transform("specifications", lambda s: s["reference"]), ","))
    lost = F.size(F.filter("specifications", lambda s: s["reference"].startswith("b")))
    return records.select("doc_id", "product_name", F.size("specifications").cast("long").alias("n_specs"), F.size("sources").cast("long").alias("n_sources"), lost.cast("long").alias("n_lost"), cited.alias("cited"), "overall_confidence", iso8601(F.col("extracted_at")).alias("modified"))


@query("""SELECT event_id, nullif(concat_ws('; ', CASE WHEN k < 20 THEN 'k is below 20' WHEN k > 80 THEN 'k is above 80' END, 'kind is missing', CASE WHEN event_type = 'error' THEN 'note.level is not a whole number' END), '') AS faults
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def q_record_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The faults of every event's properties, with a note of its type added, by a table of constraints."""
    note = F.concat(F.lit(', "note": {"level": '), F.when(F.col("event_type") == "error", '"high"').otherwise("1"), F.lit("}}"))
    props = F.concat(F.regexp_replace("props", r"\}\s*$", ""), note)
    asked = [Constraint("k", NUMBER, low=20, high=80), Constraint("kind", STRING, required=True), Constraint("note", OBJECT), Constraint("note.level", INTEGER, required=True), Constraint("note.by", STRING)]
    return table(spark, sf_dir, "events").select("event_id", told(faults(F.try_parse_json(props), asked)).alias("faults"))

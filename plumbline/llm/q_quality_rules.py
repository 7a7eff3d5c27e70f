"""op1: weakly supervised quality of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .quality_rules import BEGIN, HIGHEST, LOWEST, PRIOR_RANGE, RULES, STEPS, score_quality

_VOTES = ",\n        ".join(f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for bad, good in RULES.values())
_K = len(RULES)

#: A WITH body that ends in `scored` (doc_id, statistics, base_failed, kept), over the view `documents`.
SCORED = f"""
texts AS (
    SELECT doc_id, coalesce(text, '') AS t FROM documents
), split AS (
    SELECT doc_id, t, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM texts
), windowed AS (
    SELECT doc_id, unnest(range(1, len(w) - 3)) AS k, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM split WHERE len(w) >= 5
), repeated AS (
    SELECT doc_id, k FROM windowed QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1
), covered AS (
    SELECT doc_id, count(DISTINCT i) AS n FROM (SELECT doc_id, unnest(range(k, k + 5)) AS i FROM repeated) GROUP BY doc_id
), counted AS (
    SELECT split.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        length(regexp_replace(t, '\\P{{Lu}}', '', 'g')) AS n_upper, length(regexp_replace(t, '\\P{{L}}', '', 'g')) AS n_letters,
        length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS n_marks
    FROM split LEFT JOIN covered ON split.doc_id = covered.doc_id
), voted AS (
    SELECT *, [{_VOTES}] AS v FROM counted
), patterns AS (
    SELECT v, CAST(count(*) AS DOUBLE) AS n FROM voted GROUP BY v
), em AS (
    SELECT 0 AS step, list_resize(CAST([] AS DOUBLE[]), {_K}, CAST({BEGIN} AS DOUBLE)) AS a, CAST({BEGIN} AS DOUBLE) AS prior
    UNION ALL
    SELECT step + 1, a, prior FROM (
        SELECT any_value(step) AS step, [{", ".join(f"greatest({LOWEST}, least({HIGHEST}, (sum(n * CASE v[{k}] WHEN 1 THEN p WHEN -1 THEN 1 - p ELSE 0 END) + 1) / (sum(CASE WHEN v[{k}] = 0 THEN 0 ELSE n END) + 2)))" for k in range(1, _K + 1))}] AS a,
            greatest({PRIOR_RANGE[0]}, least({PRIOR_RANGE[1]}, (sum(n * p) + 1) / (sum(n) + 2))) AS prior
        FROM (SELECT step, v, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + {" + ".join(f"v[{k}] * ln(a[{k}] / (1 - a[{k}]))" for k in range(1, _K + 1))}))) AS p FROM em, patterns WHERE step < {STEPS})
        HAVING count(*) > 0
    )
), model AS (
    SELECT a, prior FROM em WHERE step = {STEPS}
), scored AS (
    SELECT voted.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
        NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words)
        AND 1 / (1 + exp(-(ln(prior / (1 - prior)) + {" + ".join(f"v[{k}] * ln(a[{k}] / (1 - a[{k}]))" for k in range(1, _K + 1))}))) >= 0.5 AS kept
    FROM voted, model
)"""

SQL = f"WITH RECURSIVE {SCORED} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM scored"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_quality(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    s = F.col("quality_rules")
    return scored.select("doc_id", *(s[k].alias(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")))

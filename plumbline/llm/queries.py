"""One query for each operator of this subpackage, over its whole intended table."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name -> module of this subpackage that has query(spark, sf_dir), and SQL where SQL can express it.
_MODULES = {
    "op1_quality_rules": "q_quality_rules",
    "op2_license_scans": "q_license_scans",
    "op3_ngram_jaccard_join": "q_ngram_join",
    "op4_benchmark_decontamination": "q_decontamination",
    "op5_url_filters": "q_url_filters",
    "op6_lm_scoring": "q_lm_scoring",
    "op7_toxicity": "q_toxicity",
    "op8_byte_level_bpe": "q_byte_bpe",
    "op9_quality_classifier": "q_quality_classifier",
    "op10_token_files": "q_token_files",
    "op11_conversation_repair": "q_conversations",
    "op12_spelling_variants": "q_spelling",
    "op13_exact_dedup": "q_exact_dedup",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in _MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: getattr(import_module(f"{__package__}.{module}"), "SQL", None) for name, module in _MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}

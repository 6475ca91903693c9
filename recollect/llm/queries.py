"""The registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recollect.llm import bpe, images, language_id, licenses, mixing, quality_model, quality_rules, simhash, substring, templates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": mixing.query,
    "op2_quality_classifier": quality_model.query,
    "op3_image_copies": images.query,
    "op4_html_templates": templates.query,
    "op5_simhash_dedup": simhash.query,
    "op6_bpe_encoding": bpe.query,
    "op7_language_id": language_id.query,
    "op8_license_scan": licenses.query,
    "op9_substring_dedup": substring.query,
    "op10_quality_rules": quality_rules.query,
}

ORACLE_SQL: dict[str, str] = {"op1_source_mixing": mixing.oracle()}

"""Queries of the corpus operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidebook.llm import exact_topk, html_text, licenses, media, mixing, near_dedup, packing, quality, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": quality.query,
    "op2_mixing": mixing.query,
    "op3_media": media.query,
    "op4_exact_topk": exact_topk.query,
    "op5_near_dedup": near_dedup.query,
    "op6_packing": packing.query,
    "op7_sharding": sharding.query,
    "op8_html_text": html_text.query,
    "op9_toxicity": toxicity.query,
    "op10_license_scan": licenses.query,
}
ORACLE_SQL: dict[str, str] = {
    "op5_near_dedup": near_dedup.SQL,
    "op4_exact_topk": exact_topk.SQL,
    "op10_license_scan": licenses.SQL,
}

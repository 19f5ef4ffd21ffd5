"""Queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidewire.llm import op1_quality, op2_tokens, op3_fingerprints, op4_mixing, op5_language, op6_jaccard, op7_decontamination, op8_passages, op9_html, op10_toxicity, op11_importance, op12_licenses, op13_clusters

_MODULES = (op1_quality, op2_tokens, op3_fingerprints, op4_mixing, op5_language, op6_jaccard, op7_decontamination, op8_passages, op9_html, op10_toxicity, op11_importance, op12_licenses, op13_clusters)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.NAME: m.query for m in _MODULES} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}

"""Query op1: perplexity of all documents under a model of those labelled as good."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.quality import LOW_QUANTILE, classify
from tidewire.llm.tables import table

NAME = "op1_quality"
SQL = None  # tested against a brute-force model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1")
    return classify(table(spark, sf_dir, "documents"), trusted, low=LOW_QUANTILE)

"""Query op7: benchmark items in all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.decontaminate import matches
from tidewire.llm.tables import table

NAME = "op7_decontamination"
SQL = None  # approximate search; tested against brute-force edit distance


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

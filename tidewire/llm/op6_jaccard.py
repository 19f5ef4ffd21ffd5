"""Query op6: near-duplicate components of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.jaccard import near_duplicates
from tidewire.llm.tables import table

NAME = "op6_jaccard_join"
SQL = None  # components by way of all links are too slow in SQL on whole tables; tested against brute force


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")

"""Query op2: the exact token-length histogram of all documents, with its suffix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.tables import table
from tidewire.llm.tokencount import encoded_lengths, length_histogram

NAME = "op2_token_counts"
SQL = None  # SQL has no tokenizer; tested against a brute-force version


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram(encoded_lengths(table(spark, sf_dir, "documents").select("text")).select("n_tokens"))

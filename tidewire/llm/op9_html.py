"""Query op9: main text of all pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.htmlmodel import extract, labelled_pages, train
from tidewire.llm.tables import table

NAME = "op9_html_extraction"
SQL = None  # a trained model; tested on labelled pages and against brute-force marginals


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = train(labelled_pages(spark))
    out = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model)
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))

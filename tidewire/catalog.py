"""All queries of the library outside ``llm`` and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewire.plans import context, cyber, defense, desk, geography, lexical, monitor, news, upkeep  # noqa: F401  (importing the others registers their queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(news.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(news.SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return news.density(spark, sf_dir)

"""Query op4: mix all documents, weighted by their labelled quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.mixing import mix_sizes, word_count
from tidewire.llm.tables import table

NAME = "op4_mix_sources"


#: Weights of documents labelled good, not labelled, and labelled bad: a good one is four times as likely to be among the first.
GOOD, UNKNOWN, BAD = 1.0, 0.5, 0.25


def with_quality_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (doc_id, source, text or what else docs have) with ``weight`` by the least ``quality`` among a document's labels."""
    least = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("_quality"))
    weight = F.when(F.col("_quality") >= 1, GOOD).when(F.col("_quality") <= 0, BAD).otherwise(UNKNOWN)
    return docs.join(least, "doc_id", "left").withColumn("weight", weight).drop("_quality")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_by_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def mix_by_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Words that the mix takes of each document, good ones more likely in the last epoch. Only sizes and ids are joined with labels, no texts."""
    sized = docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sizes(with_quality_weight(sized, labels)).select("doc_id", "size", "source_size", "target", "taken")


MIX_SQL = """
q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
r AS (SELECT d.doc_id, source, CASE WHEN quality >= 1 THEN 1.0 WHEN quality <= 0 THEN 0.25 ELSE 0.5 END AS weight,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
        (CAST(CAST('0x' || substr(md5(coalesce(CAST(d.doc_id AS VARCHAR), '') || ':0'), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
      FROM {docs} d LEFT JOIN q ON q.doc_id = d.doc_id),
k AS (SELECT doc_id, source, size, -ln(u) / CAST(weight AS DOUBLE) AS key FROM r),
s AS (SELECT source, sum(size) AS source_size,
        row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM k GROUP BY source),
w AS (SELECT *, CAST((rank - 1) % 3 + 1 AS DOUBLE) AS weight, source_size * 3.0 AS room FROM s),
l AS (SELECT *, (sum(source_size) OVER () - coalesce(sum(room) OVER (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
        / sum(weight) OVER (ORDER BY room / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
f AS (SELECT *, level * weight >= room AS is_full FROM l),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
        CASE WHEN source_size = 0 THEN 0.0 WHEN is_full THEN room
             ELSE (max(CASE WHEN NOT is_full THEN level END) OVER ()) * weight END AS target FROM f),
p AS (SELECT k.doc_id, k.size, t.source_size, t.target,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS epochs,
        coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
      FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  CAST(epochs * size + least(size, greatest(0, CAST(round(target - epochs * source_size) AS BIGINT) - ahead)) AS BIGINT) AS taken
FROM p"""

SQL = "WITH " + MIX_SQL.format(docs="documents").strip()

"""Query op12: licences named or quoted in all documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.licenses import LEAST_SHARE, LOWER, TEMPLATES, UPPER, WORD, Template, scan
from tidewire.llm.tables import table

NAME = "op12_license_scan"


def _labels(found: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda x: x["label"]))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("_base", F.filter("found", lambda x: x["base"]))
    starts = F.transform("_base", lambda x: x["start"].cast("long"))
    score = F.coalesce(F.array_max(F.transform("found", lambda x: x["share"])), F.lit(0.0))
    return out.select("doc_id", "n_words", F.size("_base").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                      _labels(F.col("_base")).alias("base_labels"), _labels(F.col("found")).alias("labels"), score.alias("score"))


def _row(n: int, t: Template) -> str:
    words = lambda ws: "[" + ", ".join(f"'{w}'" for w in ws) + "]"
    must = "[" + ", ".join(f"{{'a': {a}, 'p': {words(p)}}}" for a, p in t.must) + "]"
    return f"({n}, '{t.label}', {str(t.base).lower()}, {words(t.words)}, {must})"


#: Every place of each passage's first mandatory word is tried.
SQL = f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(_row(n, t) for n, t in enumerate(TEMPLATES))}) AS v(t, label, base, words, must)),
w AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS ws FROM documents),
c AS (SELECT rid, ws, t.*, unnest(list_filter(range(len(ws)), lambda i: ws[i + 1] = must[1].p[1])) - must[1].a AS s FROM w, t WHERE list_contains(ws, must[1].p[1])),
f AS (SELECT rid, label, base, s, CAST(len(list_filter(range(len(words)), lambda j: s + j >= 0 AND s + j < len(ws) AND ws[s + j + 1] = words[j + 1])) AS DOUBLE) / len(words) AS share
  FROM c WHERE len(list_filter(must, lambda m: s + m.a >= 0 AND ws[s + m.a + 1:s + m.a + len(m.p)] = m.p)) = len(must)),
g AS (SELECT rid, count(*) FILTER (base) AS n_base, min(s) FILTER (base) AS first_word, max(s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
  string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM f WHERE share >= {LEAST_SHARE} GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score FROM w LEFT JOIN g USING (rid)"""

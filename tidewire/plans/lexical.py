"""Queries of weighted terms over documents with small lexicons, each with its SQL.

Terms overlap. SQL goes through the terms in the order in which they claim: it counts a term in what is left of the text and
then masks its places. For that every character but a-z and digits is doubled, so that two neighbours do not share it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import lexical
from tidewire.plans.news import query, table

#: Small lexicons of words that the texts have: group, term, weight.
SECTORS = (("energy", "of the", 3), ("energy", "the", 1), ("energy", "to the", 2), ("finance", "from", 2), ("finance", "pour", 2), ("finance", "license", 1), ("finance", "the", 1), ("health", "de la", 2), ("health", "la", 1), ("health", "de", 1))
TOPICS = (("Trade", "of the", 2), ("Trade", "the of", 3), ("Trade", "nicht", 3), ("Crisis & Conflict", "dan", 2), ("Crisis & Conflict", "was", 1), ("Crisis & Conflict", "wa", 2), ("Diplomacy", "como", 2), ("Diplomacy", "had", 1))
SIGNALS = (("escalation", "que", 2), ("escalation", "which", 3), ("escalation", "und der", 4), ("escalation", "der", 1), ("magnitude", "le", 2), ("magnitude", "not", 2), ("deescalation", "del", 2), ("deescalation", "auf", 4))
PLACES = (("France", "est", "europe", False), ("Spain", "los", "europe", False), ("Japan", "at", "asia", False), ("Chile", "of the", "america", False), ("Peru", "the", "america", False), ("asia", "ist", "asia", True), ("europe", "las", "europe", True), ("europe", "the", "europe", True))
ORDER = ["Crisis & Conflict", "Trade", "Diplomacy"]
RELEVANT = ("une", "thi")
#: Curly quotes and dashes as ASCII, as ``plain_marks`` has them.
_MARKS = "'‘’ʼ′“”‒–—―−ı', '''''''''" + '""-----i' + "'"
_FOLDED = f"trim(regexp_replace(translate(strip_accents(lower(coalesce(text, ''))), {_MARKS}), '\\s+', ' ', 'g'))"


def _values(rows: tuple, names: str) -> str:
    cell = lambda x: str(x).lower() if isinstance(x, (bool, int)) else f"'{x}'"
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({names}))"


DOCS_SQL = f"d AS (SELECT doc_id AS id, {_FOLDED} AS t, coalesce(source = 'src1', false) AS official FROM documents)"


def _pattern(term: str, plural: bool) -> str:
    return "([^a-z0-9])" + re.sub("([^a-z0-9])", r"\1\1", term) + ("(?:e?s)?" if plural else "") + "([^a-z0-9])"


def _claims_sql(name: str, terms: list[str], plural: bool, every: bool) -> tuple[str, str]:
    """CTEs of the texts' states, and the last one's name; its column n has each term's places by number."""
    order = sorted(set(terms), key=lambda t: (-len(t), t))
    parts = [f"{name}0 AS (SELECT id, ' ' || regexp_replace(t, '([^a-z0-9])', '\\1\\1', 'g') || ' ' AS t, [] :: BIGINT[] AS n FROM d)"]
    for i, term in enumerate(order):
        pattern, all_places = _pattern(term, plural), ", 'g'" if every else ""
        n = f"len(regexp_extract_all(t, '{pattern}'))" if every else f"CAST(regexp_matches(t, '{pattern}') AS BIGINT)"
        parts.append(f"{name}{i + 1} AS (SELECT id, regexp_replace(t, '{pattern}', '\\1#\\2'{all_places}) AS t, list_append(n, {n}) AS n FROM {name}{i})")
    return ",\n".join(parts), f"{name}{len(order)}"


def _scores_sql(name: str, rows: tuple, plural: bool = False) -> str:
    ctes, picks = [], []
    for g, group in enumerate(sorted({r[0] for r in rows})):
        own = sorted(((t, w) for x, t, w in rows if x == group), key=lambda r: (-len(r[0]), r[0]))
        cte, last = _claims_sql(f"{name}_{g}_", [t for t, _ in own], plural, False)
        ctes.append(cte)
        picks += [f"SELECT id, '{group}' AS grp, '{t}' AS term, {w} AS weight FROM {last} WHERE n[{i + 1}] > 0" for i, (t, w) in enumerate(own)]
    return ",\n".join(ctes) + f""",
{name} AS (SELECT id, grp, CAST(sum(weight) AS BIGINT) AS score, max(weight) AS max_weight, string_agg(term, ',' ORDER BY term) AS terms FROM ({" UNION ALL ".join(picks)}) GROUP BY id, grp)"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text", F.coalesce(F.col("source") == "src1", F.lit(False)).alias("official"))


def _lexicon(spark: SparkSession, rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), "group string, term string, weight int")


@query("sector_hits", f"""WITH {DOCS_SQL}, {_scores_sql("s", SECTORS)} SELECT id, grp AS sector, score, CASE WHEN score >= 4 THEN 'high' WHEN score >= 3 THEN 'medium' ELSE 'low' END AS confidence, terms FROM s WHERE score >= 2 AND max_weight >= 2""")
def sector_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexical.sectors(lexical.weighted_scores(_texts(spark, sf_dir), _lexicon(spark, SECTORS)))
    return found.withColumn("terms", F.array_join("terms", ","))


def _places_sql() -> str:
    order = sorted((r for r in PLACES if not r[3]), key=lambda r: (-len(r[1]), r[1]))
    claims, last = _claims_sql("pc", [r[1] for r in order], False, True)
    picks = [f"SELECT id, '{g}' AS country, '{region}' AS region, n[{i + 1}] AS n FROM {last}" for i, (g, _, region, _) in enumerate(order)]
    picks += [f"SELECT id, NULL, '{region}', len(regexp_extract_all(t, '{_pattern(term, False)}')) FROM pc0" for _, term, region, direct in PLACES if direct]
    return f"{claims},\npl AS (SELECT id, country, region, sum(n) AS mentions FROM ({' UNION ALL '.join(picks)}) WHERE n > 0 GROUP BY ALL)"


PLACES_SQL = f"""{_places_sql()},
pr AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY mentions DESC, country) AS rank FROM pl WHERE country IS NOT NULL),
pt AS (SELECT id, max(country) FILTER (rank = 1) AS f, max(mentions) FILTER (rank = 1) AS n1, coalesce(max(mentions) FILTER (rank = 2), 0) AS n2 FROM pr GROUP BY id),
pg AS (SELECT id, count(DISTINCT region) AS k, min(region) AS o FROM pl GROUP BY id),
px AS (SELECT id, CASE WHEN n1 > n2 THEN f WHEN k = 1 THEN o ELSE 'Global / Multi-region' END AS region FROM pg LEFT JOIN pt USING (id))"""


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.places(_texts(spark, sf_dir), _place_lexicon(spark))


def _place_lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PLACES), "group string, term string, region string, is_region boolean")


@query("mentioned_places", f"WITH {DOCS_SQL}, {PLACES_SQL} SELECT id, country, region, CAST(mentions AS BIGINT) AS mentions FROM pl")
def mentioned_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _places(spark, sf_dir)


@query("policy_signals", f"""WITH {DOCS_SQL}, {PLACES_SQL}, {_scores_sql("ts", TOPICS, True)}, {_scores_sql("ss", SIGNALS, True)},
tb AS (SELECT id, first(grp ORDER BY score DESC, max_weight DESC, list_position({ORDER}, grp)) AS topic, max(score) AS topic_score FROM ts GROUP BY id),
lv AS (SELECT id, coalesce(max(score) FILTER (grp = 'escalation'), 0) AS e, coalesce(max(score) FILTER (grp = 'magnitude'), 0) AS m, coalesce(max(score) FILTER (grp = 'deescalation'), 0) AS x FROM ss GROUP BY id),
r AS (SELECT d.id, official, coalesce(topic, 'Diplomacy') AS topic, coalesce(topic_score, 0) AS topic_score, coalesce(e, 0) AS e, coalesce(m, 0) AS m, coalesce(x, 0) AS x, px.region,
  coalesce(topic_score, 0) >= 2 OR regexp_matches(t, '(^|[^a-z0-9])({"|".join(RELEVANT)})(e?s)?($|[^a-z0-9])') AS relevant FROM d LEFT JOIN tb USING (id) LEFT JOIN lv USING (id) LEFT JOIN px ON px.id = d.id),
l AS (SELECT *, CASE WHEN e >= 6 OR (e >= 3 AND m >= 2) THEN 4 WHEN e >= 3 OR m >= 4 THEN 3 WHEN e >= 2 OR m >= 2 OR topic <> 'Diplomacy' THEN 2 WHEN topic = 'Crisis & Conflict' THEN 2 ELSE 1 END - CASE WHEN x >= 4 THEN 2 WHEN x >= 2 THEN 1 ELSE 0 END AS level,
  CASE WHEN relevant THEN 2 ELSE 1 END + (topic_score >= 2)::INT + (region IS NOT NULL)::INT + official::INT AS sure FROM r)
SELECT id, topic, CAST(topic_score AS BIGINT) AS topic_score, CASE WHEN level >= 4 THEN 'critical' WHEN level = 3 THEN 'high' WHEN level = 2 THEN 'medium' ELSE 'low' END AS severity, coalesce(region, 'Global / Unspecified') AS region, relevant,
CASE WHEN sure >= 4 THEN 'high' WHEN sure >= 3 THEN 'medium' ELSE 'low' END AS confidence FROM l""")
def policy_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    relevant = spark.createDataFrame([(x,) for x in RELEVANT], "term string")
    return lexical.policy(_texts(spark, sf_dir), _lexicon(spark, TOPICS), _lexicon(spark, SIGNALS), None, ORDER, relevant, _place_lexicon(spark))

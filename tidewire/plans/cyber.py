"""Query of attackers and victims over documents in which some words stand for attacks, with its SQL for names that do not overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import cyber
from tidewire.plans.news import query, table

#: Words of the texts and what they are taken for.
WORDS = ((" of ", " attacks on "), (" is ", " hackers "), (" was ", " was breached "), (" by ", " targeted by "), (" que ", " linked "), (" und ", " firms "))
COUNTRIES = (("Aland", "north", "the", False), ("Bland", "south", "la", False), ("Cland", "south", "der", True), ("Dland", "north", "that", True), ("Dland", "north", "this", False))
ACTORS = (("One", "nation_state", "Aland", "for"), ("Two", "nation_state", "Bland", "les"), ("Three", "cybercrime", None, "it"))
REGIONS = (("east", "in"), ("east", "von"), ("west", "de"))


def spoken(text: Column | str) -> Column:
    out = F.coalesce(text, F.lit(""))
    for word, other in WORDS:
        out = F.replace(out, F.lit(word), F.lit(other))
    return out


def _text_sql() -> str:
    out = "coalesce(text, '')"
    for word, other in WORDS:
        out = f"replace({out}, '{word}', '{other}')"
    out = rf"regexp_replace({out}, '\bU\.S\.A\.?|\bU\.S\.|\bUSA\b|\bUS\b', ' usa ', 'g')"
    out = f"translate(strip_accents(lower({out})), '‘’ʼ′“”‒–—―−ı', '''''''''\"\"-----i')"
    return rf"trim(regexp_replace({out}, '\s+', ' ', 'g'))"


def _like(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, '{pattern.replace(chr(39), chr(39) * 2)}')"


_NAMED, _CALLED = rf"^(?:'s)?[ ](?:{cyber.VICTIMS})\b", rf"^[ ](?:[a-z][a-z-]+ ){{0,2}}(?:{cyber.VICTIMS})\b"
ROLE_SQL = f"""CASE WHEN demonym AND {_like("a", cyber.ACTORS_AFTER)} THEN 'origin high' WHEN {_like("a", cyber.TAIL_AFTER)} OR {_like("a", cyber.SERVICE_AFTER)} OR {_like("b", cyber.BY_BEFORE)} OR {_like("b", cyber.SOURCE_BEFORE)} THEN 'origin high'
WHEN {_like("b", cyber.VERB_BEFORE)} OR {_like("a", cyber.PASSIVE_AFTER)} THEN 'target high' WHEN {_like("b", cyber.PREPOSITION_BEFORE)} THEN 'target medium'
WHEN attack AND CASE WHEN demonym THEN {_like("a", _CALLED)} ELSE {_like("a", _NAMED)} END THEN 'target medium' WHEN demonym THEN 'neutral low' ELSE 'neutral medium' END"""
_LEXICON = [("c", c, r, t, d) for c, r, t, d in COUNTRIES] + [("r", r, r, t, True) for r, t in REGIONS]


def _mentions(kind: str, name: str, region: str, term: str, demonym: bool) -> str:
    """Places of one term, as the 64 characters before and after each."""
    split = f"SELECT id, attack, parts, unnest(range(1, len(parts))) AS k FROM (SELECT id, attack, string_split(t, '{term}') AS parts FROM d WHERE contains(t, '{term}'))"
    near = f"right(array_to_string(parts[greatest(1, k - 64):k], '{term}'), 64) AS b, left(array_to_string(parts[k + 1:k + 65], '{term}'), 64) AS a"
    return f"SELECT id, attack, '{kind}' AS kind, '{name}' AS name, '{region}' AS region, '{term}' AS term, {str(demonym).lower()} AS demonym, k, {near} FROM ({split})"


_RANK = "CASE split_part(m, ' ', 1) WHEN 'target' THEN 3 WHEN 'origin' THEN 2 ELSE 1 END"
_TRUST = "CASE split_part(m, ' ', 2) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END"


@query("geo_roles", f"""WITH d AS (SELECT doc_id AS id, t, {_like("t", cyber.ATTACK)} AS attack FROM (SELECT doc_id, {_text_sql()} AS t FROM documents)),
w AS ({" UNION ALL ".join(_mentions(*x) for x in _LEXICON)}),
s AS (SELECT id, kind, name, region, term, k, {ROLE_SQL} AS m FROM w WHERE NOT regexp_matches(b, '[a-z0-9]$') AND NOT regexp_matches(a, '^[a-z0-9]')),
x AS (SELECT id, name, region, m FROM s WHERE kind = 'c' UNION ALL SELECT id, country, region, 'origin high' FROM d, (SELECT * FROM (VALUES {", ".join(f"('{c}', '{next(r for n, r, *_ in COUNTRIES if n == c)}', '{t}')" for _, k, c, t in ACTORS if k == "nation_state")}) AS v(country, region, term))
  WHERE regexp_matches(t, '(^|[^a-z0-9])' || term || '($|[^a-z0-9])'))
SELECT id, region, name AS country, array_to_string(list_sort(list(DISTINCT split_part(m, ' ', 1))), ',') AS roles, split_part(max_by(m, {_RANK}), ' ', 1) AS role, split_part(max_by(m, {_TRUST}), ' ', 2) AS confidence FROM x GROUP BY ALL
UNION ALL SELECT id, region, NULL, role, role, CASE WHEN trust = 'low' THEN 'low' ELSE 'medium' END FROM (SELECT id, region, split_part(max_by(m, {_RANK}), ' ', 1) AS role, split_part(max_by(m, k), ' ', 2) AS trust FROM s WHERE kind = 'r' GROUP BY id, region, term)""")
def geo_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), spoken("text").alias("text"))
    lexicons = (spark.createDataFrame(list(COUNTRIES), "country string, region string, term string, demonym boolean"), spark.createDataFrame(list(ACTORS), "actor string, kind string, country string, term string"), spark.createDataFrame(list(REGIONS), "region string, term string"))
    out = cyber.geo_roles(items, *lexicons)
    return out.select(F.col("item_id").alias("id"), "region", "country", F.array_join("roles", ",").alias("roles"), "role", "confidence")

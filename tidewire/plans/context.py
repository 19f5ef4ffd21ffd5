"""Queries of event types and roles over documents as items, with rules and names of words that they have, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import context
from tidewire.operators.context import Lexicons, Rule
from tidewire.plans.news import query, table

RULES = {
    "guards": (("sports_or_non_relevant_domain", "sports", ("pour la", "asci")), ("local_crime_not_geopolitical", "local_crime", ("ist das", "from the from"))), "opinion": ("is that", "eau eau"),
    "appointing": ("by the", "von der", "que la"), "appointments": (Rule("defense_appointment", ("with the", "nicht")), Rule("diplomatic_appointment", ("on the", "mit", "del"))),
    "events": (Rule("strike", ("at the", "est")), Rule("diplomatic_visit", ("was the", "auf")), Rule("meeting", ("for the", "par")), Rule("official_statement", ("the", "la", "der"))),
}
COUNTRIES = (("Aland", "the"), ("Bland", "of the"), ("Cland", "la"), ("Dland", "de la"), ("Eland", "der"), ("Fland", "von der"))
TITLES = (("of", "President"), ("to the", "Minister"), ("de", "Envoy"), ("and", "Leader"))
PERSONS = (("Anna", "Gland", "Judge", "Court", ("are the", "pas la")), ("Ben", "Hland", "King", "Palace", ("this is", "im")))
INSTITUTIONS = (("Senate", "Iland", ("that is", "zu der")), ("Bank", "Jland", ("que el",)))
STATE = (("from the", "Army"), ("una", "Navy"))
LEXICONS = Lexicons(COUNTRIES, TITLES, PERSONS, ("as the", "und der"), ("are", "sich"), INSTITUTIONS, STATE, ("Cland", "Bland"))


def _any(phrases: tuple[str, ...]) -> str:
    return f"regexp_matches(t, '(^| )({'|'.join(phrases)})( |$)')"


def _cases(rows: list[tuple[tuple[str, ...], str]], other: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {_any(p)} THEN '{v}'" for p, v in rows) + f" ELSE {other} END"


def _event_sql() -> str:
    kind = _cases([(r.phrases, r.event) for r in RULES["appointments"]], "'official_appointment'")
    rest = _cases([(r.phrases, r.event) for r in RULES["events"]], "'unknown'")
    return _cases([(p, e) for _, e, p in RULES["guards"]] + [(RULES["opinion"], "analysis_or_opinion")], f"CASE WHEN {_any(RULES['appointing'])} THEN {kind} ELSE {rest} END")


DOCS = "d AS (SELECT doc_id AS id, trim(regexp_replace(strip_accents(lower(replace(coalesce(text, ''), 'ı', 'i'))), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents)"
GUARD_SQL = _cases([(p, r) for r, _, p in RULES["guards"]])


@query("event_types", f"WITH {DOCS} SELECT id, {_event_sql()} AS event_type, {GUARD_SQL} AS guard FROM d")
def event_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return context.event_types(texts, **RULES).select("id", "event_type", "guard")


def _pair_sql(left: list[str], right: list[str]) -> str:
    """The first two neighbours, as left and right; longer names are tried first."""
    a, b = ("|".join(sorted(x, key=lambda w: -len(w))) for x in (left, right))
    return f"regexp_extract(t, '(?:^| )({a}) ({b})(?: |$)', ['l', 'r'])"


def _value(expression: str, rows: tuple) -> str:
    return f"CASE {expression} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in rows) + " END"


_OF = tuple((a, c) for c, a in COUNTRIES)
_BY_LENGTH = sorted(COUNTRIES, key=lambda r: -len(r[1]))
_COUNTRIES_SQL = "list_filter([" + ", ".join(f"CASE WHEN {_any((a,))} THEN '{c}' END" for c, a in _BY_LENGTH) + "], lambda x: x IS NOT NULL)"


@query("entity_roles", f"""WITH {DOCS},
e AS (SELECT *, {_event_sql()} AS event_type, {_COUNTRIES_SQL} AS found, {_cases([(p[4], str(i)) for i, p in enumerate(PERSONS)])} AS p, {_cases([(x[2], str(i)) for i, x in enumerate(INSTITUTIONS)])} AS x, {_cases([((s,), v) for s, v in STATE])} AS state,
  {_pair_sql([a for _, a in COUNTRIES], [t for t, _ in TITLES])} AS ct, {_pair_sql([t for t, _ in TITLES], [a for _, a in COUNTRIES])} AS tc, {_cases([((t,), v) for t, v in TITLES])} AS any_title, {_cases([(("as the",), "AS THE"), (("und der",), "UND DER")])} AS org FROM d),
f AS (SELECT *, {_value("p", tuple((str(i), x[1]) for i, x in enumerate(PERSONS)))} AS person_country, CASE WHEN ct.l <> '' THEN {_value("ct.l", _OF)} WHEN tc.r <> '' THEN {_value("tc.r", _OF)} END AS pair_country,
  CASE WHEN ct.l <> '' THEN {_value("ct.r", TITLES)} WHEN tc.r <> '' THEN {_value("tc.l", TITLES)} END AS pair_title FROM e),
g AS (SELECT *, CASE WHEN person_country IS NULL AND pair_country IS NULL AND any_title IS NOT NULL THEN found[1] END AS listed FROM f),
h AS (SELECT *, coalesce(person_country, pair_country, listed, {_value("x", tuple((str(i), r[1]) for i, r in enumerate(INSTITUTIONS)))}) AS issuing_country, {_value("x", tuple((str(i), r[0]) for i, r in enumerate(INSTITUTIONS)))} AS direct FROM g)
SELECT id, event_type, {_value("p", tuple((str(i), x[0]) for i, x in enumerate(PERSONS)))} AS issuing_actor, issuing_country,
coalesce({_value("p", tuple((str(i), x[2]) for i, x in enumerate(PERSONS)))}, CASE WHEN person_country IS NULL THEN pair_title END, CASE WHEN listed IS NOT NULL THEN any_title END) AS issuing_title,
coalesce({_value("p", tuple((str(i), x[3]) for i, x in enumerate(PERSONS)))}, org, direct, state) AS issuing_institution, coalesce(direct, state) AS institution,
CASE WHEN event_type = 'diplomatic_visit' THEN nullif(array_to_string(list_filter(found, lambda c: c IS DISTINCT FROM issuing_country), ','), '') END AS destinations,
CASE WHEN event_type = 'meeting' THEN coalesce(list_filter(found, lambda c: c IS DISTINCT FROM issuing_country)[1], found[1]) END AS counterparty_country,
{_cases([(("la",), "Cland"), (("of the",), "Bland")])} AS strategic_location, found[1] AS event_location,
CASE WHEN event_type = 'analysis_or_opinion' THEN 'analysis_or_opinion_item' WHEN event_type LIKE '%appointment' AND issuing_country IS NULL THEN CASE WHEN coalesce(direct, state) IS NULL THEN 'unresolved_issuing_country' ELSE 'institution_without_country_context' END ELSE {GUARD_SQL} END AS no_marker FROM h""")  # fmt: skip
def entity_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("title"))
    out = context.entity_roles(items, LEXICONS, **RULES)
    return out.select("id", "event_type", "issuing_actor", "issuing_country", "issuing_title", "issuing_institution", "institution", F.array_join("destinations", ",").alias("destinations"), "counterparty_country", "strategic_location", "event_location", "no_marker")

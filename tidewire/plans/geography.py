"""Queries of places over documents as items, with a small gazetteer of words that they have, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import decision
from tidewire.operators import geography as geo
from tidewire.operators.geography import METHODS, Place
from tidewire.plans.context import DOCS
from tidewire.plans.news import query, table

PLACES = (
    Place("Aland", 60.0, 20.0, "AX", "north", ("license", "with the", "from the", "aland")), Place("Bland", 1.5, -2.0, "BL", None, ("dans", "dans la")), Place("Cland", -3.0, 4.0, None, "south", ("nicht", "und der"), ("nicht",)),
    Place("Dland", 5.0, 6.0, "BL", None, ("avec", "que la")), Place("Eland", 7.0, 8.0, None, None, ("para", "are the", "zu der"), ("are the",)),
)


def _ways(name: str, weak: bool) -> tuple[list[str], str]:
    """Conditions of the ways in which a text speaks of a name, and that of a context."""

    def near(before: str | None, after: str | None) -> str:
        parts = [f"regexp_matches(t, '{before.removesuffix('$')}{name}( |$)')"] if before else []
        parts += [f"regexp_matches(t, '(^| ){name}{after.removeprefix('^')}')"] if after else []
        return "(" + " OR ".join(parts) + ")"

    event, no = f"({near(geo.BEFORE_EVENT, geo.AFTER_EVENT)} OR {near(geo.PEOPLE_OF, None)})", "false AND " if weak else ""
    ways = [near(None, geo.AFTER_OFFICIAL), f"{no}(regexp_matches(t, '^{name}( |$)') OR {near(geo.HEAD_BEFORE, None)})", no + near(None, geo.AFTER_ACTOR), f"talks AND {event}", event, no + near(geo.BEFORE_TARGET, geo.AFTER_TARGET)]
    return ways, no + near(geo.BEFORE_EVENT, geo.AFTER_PLAIN)


def _found() -> str:
    """Names in texts with their ways as numbers; a name's patterns are constants, so that each is compiled once."""
    parts = []
    for n, p in enumerate(PLACES):
        for i, name in enumerate(p.names):
            ways, context = _ways(name, name in p.weak)
            parts.append(f"""SELECT id, {n} AS place, {i} AS i, '{p.country_code or p.label}' AS key, '{p.label}' AS label, '{name}' AS name, {name.count(" ") + 1} AS tokens, {str(name in p.weak).lower()} AS weak,
list_filter([{", ".join(f"CASE WHEN {w} THEN {k} END" for k, w in enumerate(ways))}], lambda x: x IS NOT NULL) AS ways, {context} AS context FROM dt WHERE regexp_matches(t, '(^| ){name}( |$)')""")
    return f"dt AS (SELECT *, regexp_matches(t, '{geo.IN_TALKS}') AS talks FROM d),\nm AS MATERIALIZED (" + "\nUNION ALL ".join(parts) + ")"


CANDIDATES_SQL = f"""{DOCS}, {_found()},
w AS (SELECT id, place, i, key, label, name, tokens, unnest(ways) AS way FROM m),
o AS (SELECT id, place, min(i) FILTER (tokens = top) AS i FROM (SELECT *, max(tokens) OVER (PARTITION BY id, place) AS top, count(*) FILTER (NOT weak) OVER (PARTITION BY id, place) AS strong FROM m)
  WHERE (id, place) NOT IN (SELECT (id, place) FROM w) AND (top >= 2 OR strong >= 2) GROUP BY id, place),
c AS (SELECT * FROM w UNION ALL SELECT m.id, m.place, m.i, key, label, name, tokens, 6 FROM o JOIN m USING (id, place, i)),
s AS (SELECT *, CASE WHEN tokens >= 2 THEN ({[m[1] for m in METHODS]})[way + 1] ELSE ({[m[2] for m in METHODS]})[way + 1] END AS score FROM c)"""


@query("location_candidates", f"""WITH {CANDIDATES_SQL}
SELECT id, key AS place, ({[m[0] for m in METHODS]})[way + 1] AS method, CAST(max(score) AS INTEGER) AS score, first(name ORDER BY score DESC, place, i) AS name, first(label ORDER BY score DESC, place, i) AS label FROM s GROUP BY id, key, way""")
def location_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    found = geo.location_candidates(items, geo.gazetteer(spark, PLACES)).select("id", F.inline("candidates"))
    return found.select("id", F.coalesce("country_code", "label").alias("place"), "method", "score", "name", "label")


@query("text_locations", f"""WITH {DOCS}, {_found()},
s AS (SELECT id, place, greatest(max(CASE WHEN tokens >= 2 THEN CASE WHEN weak THEN 60 ELSE 90 END WHEN context THEN 70 ELSE 0 END), CASE WHEN count(*) FILTER (NOT weak) >= 2 THEN 75 ELSE 0 END) AS score,
  max(CASE WHEN list_contains(ways, 0) THEN CASE WHEN tokens >= 2 THEN 95 ELSE 85 END ELSE 0 END) AS official FROM m GROUP BY id, place),
b AS (SELECT id, first(place ORDER BY score DESC, place) FILTER (score >= 70) AS best, first(place ORDER BY official DESC, place) FILTER (official >= 80) AS whose FROM s GROUP BY id),
l AS (SELECT DISTINCT place, label FROM m) SELECT d.id, x.label AS location, y.label AS official_location FROM d LEFT JOIN b USING (id) LEFT JOIN l x ON x.place = b.best LEFT JOIN l y ON y.place = b.whose""")
def text_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return geo.locations(items, geo.gazetteer(spark, PLACES)).select("id", F.col("location.label").alias("location"), F.col("official_location.label").alias("official_location"))


DOMAINS = ("official_statement", "diplomacy", "peace_process", "sanctions_law", "conflict", "international_org", "border_territory")
#: Columns of items besides their words: names and SQL.
ITEM = {
    "primary_domain": f"CASE doc_id % 9 {' '.join(f"WHEN {i} THEN '{d}'" for i, d in enumerate(DOMAINS))} END", "strategy": "CASE WHEN doc_id % 17 = 0 THEN 'none' WHEN doc_id % 13 = 0 THEN 'institution_location' END", "official": "coalesce(source = 'src1', false)",
    "event_type": "CASE WHEN doc_id % 19 = 0 THEN 'sports' WHEN doc_id % 23 = 0 THEN 'summit' WHEN doc_id % 29 = 0 THEN 'strike' END", "counterparty_country": "CASE WHEN doc_id % 2 = 0 THEN 'Bland' END",
}
_PRIORITIES = ", ".join(f"('{d}', '{r}', {p})" for d, roles in decision.PRIORITIES.items() for r, p in roles.items())
_ROLES = ", ".join(f"('{m}', '{r}')" for m, r in decision.ROLE_OF.items())


@query("geo_decisions", f"""WITH {CANDIDATES_SQL},
k AS (SELECT id, key, way, max(score) AS score, first(label ORDER BY score DESC, place, i) AS label, min(place * 100 + i) AS seen FROM s GROUP BY id, key, way),
it AS (SELECT doc_id AS id, doc_id % 5 = 0 AS hinted, doc_id % 4 = 0 AS seated, {", ".join(f"{c} AS {n}" for n, c in ITEM.items())} FROM documents),
pr AS (SELECT * FROM (VALUES {_PRIORITIES}) AS v(domain, role, p)), ro AS (SELECT * FROM (VALUES {_ROLES}) AS v(method, role)),
ev AS (SELECT id, 0 AS rank, 0 AS seen, 'institution_location' AS role, 'institution_location' AS method, 'Seat' AS label, 'SE' AS key, true AS solid, 10 AS points FROM it WHERE seated AND (coalesce(strategy = 'institution_location', false) OR official AND primary_domain IN ('official_statement', 'diplomacy', 'sanctions_law', 'international_org'))
UNION ALL SELECT id, 1, 0, 'payload_coordinates', 'payload_coordinates', 'Hint', 'HH', official, 8 FROM it WHERE hinted
UNION ALL SELECT id, 200 - score, seen * 8 + way, role, ro.method, label, key, score >= 78, CAST(round(score / 10.0) AS INTEGER) FROM k JOIN ro ON ro.method = ({[m[0] for m in METHODS]})[way + 1]),
ac AS (SELECT ev.*, p + points AS priority, row_number() OVER (PARTITION BY ev.id ORDER BY p + points DESC, rank, seen) AS place FROM ev JOIN it USING (id) JOIN pr ON pr.domain = it.primary_domain AND pr.role = ev.role WHERE solid),
an AS (SELECT id, count(*) > 0 AS any_evidence FROM ev GROUP BY id), fi AS (SELECT id, hinted OR seated AND (coalesce(strategy = 'institution_location', false) OR official AND primary_domain IN ('official_statement', 'diplomacy', 'sanctions_law', 'international_org')) AS first_evidence FROM it),
j AS (SELECT it.*, a.label, a.method, a.role, coalesce(b.priority IS NOT NULL AND a.key <> b.key AND a.role NOT IN ('venue', 'official_actor') AND NOT (a.method = 'event_location_phrase' AND b.method = 'headline_location_prefix') AND a.priority - b.priority <= 3, false) AS close,
  CASE WHEN strategy = 'none' AND event_type IS NOT NULL THEN 'feed_only' WHEN event_type = 'sports' THEN 'rejected' WHEN event_type = 'summit' AND counterparty_country IS NULL THEN 'feed_only' WHEN event_type = 'strike' THEN 'needs_location' END AS told,
  CASE WHEN strategy = 'none' AND event_type IS NOT NULL THEN 'source_entity_not_location' WHEN event_type = 'sports' THEN 'sports_or_non_relevant_domain' WHEN event_type = 'summit' AND counterparty_country IS NULL THEN 'unresolved_event_venue' WHEN event_type = 'strike' THEN 'no_explicit_location' END AS why
  FROM it LEFT JOIN ac a ON a.id = it.id AND a.place = 1 LEFT JOIN ac b ON b.id = it.id AND b.place = 2),
r AS (SELECT *, told IS NULL AND event_type = 'summit' AS anchored, told IS NULL AND event_type IS NULL AND label IS NOT NULL AND NOT close AS marked FROM j)
SELECT id, CASE WHEN told IS NOT NULL THEN told WHEN coalesce(anchored, false) OR marked THEN 'eligible' WHEN NOT close AND coalesce(strategy = 'none', false) THEN 'feed_only' ELSE 'needs_location' END AS eligibility,
CASE WHEN anchored THEN 'Bland' WHEN marked THEN label END AS place, CASE WHEN anchored THEN 'negotiation_location_phrase' WHEN marked THEN method END AS method,
CASE WHEN anchored THEN 'event_location' WHEN marked THEN CASE role WHEN 'institution_location' THEN role WHEN 'official_actor' THEN 'actor_country' WHEN 'country_actor' THEN 'actor_country' WHEN 'target' THEN 'target_country' ELSE 'event_location' END
  WHEN CASE WHEN event_type IS NULL THEN coalesce(any_evidence, false) ELSE first_evidence END THEN 'mentioned_country' END AS basis,
CASE WHEN told IS NOT NULL THEN why WHEN coalesce(anchored, false) OR marked THEN NULL WHEN close THEN 'ambiguous_competing_locations' WHEN coalesce(strategy = 'none', false) THEN 'source_entity_not_location' ELSE 'no_explicit_location' END AS no_marker
FROM r LEFT JOIN an USING (id) JOIN fi USING (id)""")  # fmt: skip
def geo_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = geo.gazetteer(spark, PLACES)

    def place(when: str, label: str, code: str) -> str:
        return f"CASE WHEN {when} THEN named_struct('label', '{label}', 'country_code', '{code}', 'lat', 1D, 'lng', 2D) END"

    items = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), "text", *(F.expr(c).alias(n) for n, c in ITEM.items()), F.expr(place("doc_id % 5 = 0", "Hint", "HH")).alias("hint"), F.expr(place("doc_id % 4 = 0", "Seat", "SE")).alias("institution_place"))
    out = decision.geo_decisions(geo.location_candidates(items, known), known)
    return out.select("id", "eligibility", F.col("place.label").alias("place"), "method", "basis", "no_marker")

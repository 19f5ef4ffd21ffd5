"""Query of defense items over documents with a small lexicon of words that they have, with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import defense
from tidewire.plans.cyber import _like
from tidewire.plans.lexical import _FOLDED, _scores_sql
from tidewire.plans.news import query, table

#: kind, name, term, weight, place, link.
LEXICON = (
    ("segment", "Naval", "of the", 2, 0, None), ("segment", "Naval", "the", 1, 0, None), ("segment", "Aerospace", "que", 2, 1, None), ("segment", "UAV / Unmanned", "mit", 2, 2, None), ("segment", "Land", "les", 1, 3, None),
    ("activity", "Procurement", "with", 2, 10, None), ("activity", "Supply Chain", "der", 2, 11, None), ("activity", "Supply Chain", "by the", 1, 11, None), ("commodity", "Steel", "for the", 2, 20, None), ("commodity", "Chips", "la de", 2, 21, None), ("commodity", "Oil", "on", 1, 22, None),
    ("stress", "stress", "was", 2, 30, None), ("stress", "stress", "auf", 1, 30, None), ("platform", "P1", "at the", None, 40, "Land"), ("platform", "P2", "by", None, 41, "Naval"), ("contractor", "Firm A", "from the", None, 50, "Aland"), ("contractor", "Firm B", "sur", None, 51, "Cland"), ("relevance", "", "this", None, 60, None),
)
COUNTRIES = (("Aland", "north", "to", False), ("Bland", "south", "en", False), ("Cland", "north", "und", True), ("Dland", "north", "in", False))
#: Words of the texts and what they are taken for.
WORDS = ((" a ", " buys "), (" as ", " from "), (" is ", " delivers "), (" zu ", " firms "), (" por ", " billion "), (" se ", " crisis "))


def _values(kind: str) -> tuple:
    return tuple((n, t, w) for k, n, t, w, _, _ in LEXICON if k == kind)


def _text_sql() -> str:
    out = "coalesce(text, '')"
    for word, other in WORDS:
        out = f"replace({out}, '{word}', '{other}')"
    return _FOLDED.replace("coalesce(text, '')", out)


def _any(terms: tuple[str, ...]) -> str:
    return _like("t", "(^|[^a-z0-9])(" + "|".join(t.replace("$", r"\$") for t in terms) + ")(e?s)?($|[^a-z0-9])")


def _named(kind: str) -> str:
    """Names of a kind in their order."""
    names = {}
    for k, n, t, *_ in LEXICON:
        if k == kind:
            names.setdefault(n, []).append(t)
    return "list_filter([" + ", ".join(f"CASE WHEN {_any(tuple(ts))} THEN '{n}' END" for n, ts in names.items()) + "], lambda x: x IS NOT NULL)"


def _mentions(country: str, region: str, term: str, demonym: bool) -> str:
    split = f"SELECT id, parts, unnest(range(1, len(parts))) AS k FROM (SELECT id, string_split(t, '{term}') AS parts FROM d WHERE contains(t, '{term}'))"
    near = f"right(array_to_string(parts[greatest(1, k - 60):k], '{term}'), 60) AS b, left(array_to_string(parts[k + 1:k + 61], '{term}'), 60) AS a"
    first = "length(array_to_string(parts[1:k], '" + term + "'))"
    return f"SELECT id, '{country}' AS country, '{region}' AS region, '{term}' AS term, {str(demonym).lower()} AS demonym, {first} AS first, {near} FROM ({split})"


_SEGMENTS = {n: p for k, n, _, _, p, _ in LEXICON if k == "segment"}
_BOOST = " + ".join(f"CASE WHEN grp = '{link}' AND list_contains(programs, '{n}') THEN 3 ELSE 0 END" for k, n, _, _, _, link in LEXICON if k == "platform")
_PLACES = "CASE grp " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in _SEGMENTS.items()) + " END"
_OTHER = "CASE " + " ".join(f"WHEN segments[1] = '{s}' THEN '{a}'" for s, a in defense.BY_SEGMENT.items()) + f" ELSE '{defense.OTHER_ACTIVITY}' END"
_HOMES = " OR ".join(f"(country = '{link}' AND list_contains(organisations, '{n}'))" for k, n, _, _, _, link in LEXICON if k == "contractor")
_TWO = lambda c: f"array_to_string({c}[1:2], ' / ')"

SQL = f"""WITH d AS (SELECT doc_id AS id, {_text_sql()} AS t, coalesce(source = 'src1', false) AS official FROM documents),
{_scores_sql("sg", _values("segment"), True)},
{_scores_sql("ac", _values("activity"), True)},
{_scores_sql("co", _values("commodity"), True)},
{_scores_sql("st", _values("stress"), True)},
n AS (SELECT id, official, {_named("platform")} AS programs, {_named("contractor")} AS organisations, {_any(("this",))} AS known, {_any(defense.VALUE)} AS value, {_any(defense.URGENT)} AS urgent FROM d),
se AS (SELECT id, grp, total FROM (SELECT n.id, s.grp, coalesce(score, 0) + {_BOOST.replace("grp", "s.grp")} AS total, coalesce(max_weight, 0) >= 2 OR {_BOOST.replace("grp", "s.grp")} > 0 AS solid FROM n, (SELECT unnest({list(_SEGMENTS)}) AS grp) s LEFT JOIN sg ON sg.id = n.id AND sg.grp = s.grp) WHERE total >= 2 AND solid),
sl AS (SELECT id, list(grp ORDER BY total DESC, {_PLACES}) AS segments FROM se GROUP BY id),
al AS (SELECT id, first(grp ORDER BY score DESC, grp) AS activity FROM ac WHERE score >= 2 GROUP BY id),
cl AS (SELECT id, list(grp ORDER BY CASE grp WHEN 'Steel' THEN 0 ELSE 1 END) AS commodities FROM co WHERE score >= 2 GROUP BY id),
m AS ({" UNION ALL ".join(_mentions(*c) for c in COUNTRIES)}),
r AS (SELECT *, CASE WHEN {_like("a", defense.MADE_AFTER)} OR {_like("b", defense.MADE_BEFORE)} OR {_like("a", defense.SUPPLIES_AFTER)} OR (demonym AND {_like("a", defense.MAKERS_AFTER)}) THEN 'supplier' WHEN {_like("b", defense.SOLD_TO_BEFORE)} OR {_like("a", defense.BUYS_AFTER)} THEN 'buyer' ELSE 'neutral' END AS role
  FROM m WHERE NOT regexp_matches(b, '[a-z0-9]$') AND NOT regexp_matches(a, '^[a-z0-9]')),
q AS (SELECT id, country, region, min((-length(term), term, first)) AS seen, first(role ORDER BY role = 'neutral', -length(term), term, first) AS role FROM r GROUP BY id, country, region),
p AS (SELECT q.id, country, region, seen, CASE WHEN role = 'neutral' AND ({_HOMES}) THEN 'supplier' ELSE role END AS role FROM q JOIN n USING (id)),
pl AS (SELECT id, coalesce(list(country ORDER BY seen) FILTER (role = 'buyer'), []) AS buyers, coalesce(list(country ORDER BY seen) FILTER (role = 'supplier'), []) AS suppliers, coalesce(list(country ORDER BY seen) FILTER (role = 'neutral'), []) AS others, count(DISTINCT region) FILTER (role = 'neutral') AS regions, min(region) FILTER (role = 'neutral') AS region FROM p GROUP BY id),
x AS (SELECT n.*, coalesce(segments, []) AS segments, activity AS named_activity, coalesce(commodities, []) AS commodities, coalesce(st.score, 0) AS stress, coalesce(buyers, []) AS buyers, coalesce(suppliers, []) AS suppliers, coalesce(others, []) AS others, regions, region FROM n LEFT JOIN sl USING (id) LEFT JOIN al USING (id) LEFT JOIN cl USING (id) LEFT JOIN st ON st.id = n.id LEFT JOIN pl ON pl.id = n.id),
y AS (SELECT *, coalesce(named_activity, {_OTHER}) AS activity, greatest(2, CASE WHEN official THEN 3 ELSE 2 END + least(3, (len(organisations) > 0)::INT + (len(programs) > 0)::INT + (len(buyers) + len(suppliers) > 0)::INT + (len(commodities) > 0)::INT + (len(segments) > 0)::INT) - 1) AS trust FROM x),
z AS (SELECT *, 2 + (activity IN ('Procurement', 'Export Review', 'Naval Program', 'Production Capacity'))::INT + value::INT + (stress > 0 AND activity = 'Supply Chain')::INT AS level FROM y)
SELECT id, len(segments) > 0 OR len(organisations) > 0 OR len(programs) > 0 OR len(commodities) > 0 OR known AS relevant, coalesce(segments[1], 'Not specified') AS segment, activity, coalesce(organisations[1], 'Not specified') AS organisation, coalesce(programs[1], 'Not specified') AS program,
CASE WHEN len(commodities) > 0 THEN array_to_string(commodities[1:3], ', ') ELSE 'Not specified' END AS area, CAST(stress AS BIGINT) AS stress,
CASE WHEN len(suppliers) > 0 AND len(buyers) > 0 THEN {_TWO("suppliers")} || ' → ' || {_TWO("buyers")} WHEN len(buyers) > 0 THEN {_TWO("buyers")} || ' (buyer)' WHEN len(suppliers) > 0 THEN {_TWO("suppliers")} || ' (supplier)'
  WHEN len(others) = 1 THEN others[1] WHEN len(others) > 1 AND regions = 1 THEN region WHEN len(others) > 1 THEN 'Multi-region' ELSE 'Global / Unspecified' END AS parties,
CASE WHEN trust >= 4 THEN 'High' WHEN trust >= 3 THEN 'Medium' ELSE 'Low' END AS confidence, CASE WHEN level >= 4 THEN 'High' WHEN level >= 3 THEN 'Medium' ELSE 'Low' END AS impact, CASE WHEN level >= 4 AND urgent THEN 'elevated' WHEN level >= 4 THEN 'high' WHEN level >= 3 THEN 'medium' ELSE 'low' END AS priority FROM z"""


@query("defense_items", SQL)
def defense_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    for word, other in WORDS:
        text = F.replace(text, F.lit(word), F.lit(other))
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), text.alias("text"), F.coalesce(F.col("source") == "src1", F.lit(False)).alias("official"))
    lexicon = spark.createDataFrame(list(LEXICON), "kind string, name string, term string, weight int, place int, link string")
    out = defense.detect(items, lexicon, spark.createDataFrame(list(COUNTRIES), "country string, region string, term string, demonym boolean"))
    return out.select("id", "relevant", "segment", "activity", "organisation", "program", "area", "stress", "parties", "confidence", "impact", "priority")

"""Weighted terms in texts with punctuation: sectors, policy topics with their severity, and places that texts mention.

Lexicons are tables that a caller gives; ``terms`` finds their places. Longer terms claim their place in a text first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import fold
from tidewire.operators.terms import ALL, GROUP, NONE, places_by_lexicon, term_places

#: Least score and least weight of a strong term of a sector; scores of high and medium confidence.
SECTOR_SCORE, STRONG_WEIGHT, HIGH, MEDIUM = 2, 2, 4, 3
#: The topic of texts without any, the topic that is never below medium, and the labels of texts about several
#: regions or none.
NO_TOPIC, CONFLICT, SEVERAL, NOWHERE = "Diplomacy", "Crisis & Conflict", "Global / Multi-region", "Global / Unspecified"


def plain_marks(text: Column) -> Column:
    """Lower case without accents, punctuation kept but quotes and dashes as ASCII, white space squeezed; null is empty."""
    ascii_ = F.translate(fold(F.coalesce(text, F.lit(""))), "‘’ʼ′“”‒–—―−ı", "''''\"\"-----i")
    return F.trim(F.regexp_replace(ascii_, r"(?U)\s+", " "))


def marked(texts: DataFrame) -> DataFrame:
    """Rows (id, text) as terms are looked for; an item's summary, where there is a column for it, follows the title as a sentence of its own."""
    text = plain_marks(F.col("text"))
    if "summary" in texts.columns:
        text = F.trim(F.concat(text, F.lit(" . "), plain_marks(F.col("summary"))))
    return texts.select("id", text.alias("text"))


def weighted_scores(texts: DataFrame, lexicon: DataFrame, plural: bool = False) -> DataFrame:
    """Rows (id, group, score, max_weight, terms): a term counts once in a text. texts: id, text; lexicon: group, term (plain), weight.

    Within a group longer terms claim their first free place before shorter ones; ``plural``: terms may end in s or es.
    """
    weights = lexicon.groupBy("group", "term").agg(F.max("weight").cast("long").alias("weight"))
    hits = term_places(marked(texts), lexicon, GROUP, every=False, plural=plural).join(F.broadcast(weights), ["group", "term"])
    return hits.groupBy("id", "group").agg(F.sum("weight").alias("score"), F.max("weight").alias("max_weight"), F.sort_array(F.collect_set("term")).alias("terms"))


def sectors(scores: DataFrame) -> DataFrame:
    """Rows (id, sector, score, confidence, terms) of groups with enough weight, one term of it strong."""
    confidence = F.when(F.col("score") >= HIGH, "high").when(F.col("score") >= MEDIUM, "medium").otherwise("low")
    strong = scores.where((F.col("score") >= SECTOR_SCORE) & (F.col("max_weight") >= STRONG_WEIGHT))
    return strong.select("id", F.col("group").alias("sector"), "score", confidence.alias("confidence"), "terms")


def places(texts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Rows (id, country, region, mentions): every free mention counts. lexicon: term, group (country, or region of its own), region, is_region.

    Longer names of countries claim their places before shorter ones; terms of regions count each by itself.
    """
    of = lexicon.select("group", "region", "is_region").distinct()
    found = places_by_lexicon(marked(texts), _place_terms(lexicon)).groupBy("id", (F.col("lexicon") == "areas").alias("is_region"), "group").agg(F.count("*").alias("mentions"))
    rows = found.join(of, ["group", "is_region"])
    return rows.select("id", F.when(~F.col("is_region"), F.col("group")).alias("country"), "region", "mentions")


def _place_terms(lexicon: DataFrame) -> dict[str, tuple[DataFrame, dict]]:
    """Terms of countries and of regions, and how each are looked for."""
    return {"countries": (lexicon.where("NOT is_region"), {"claim": ALL}), "areas": (lexicon.where("is_region"), {"claim": NONE})}


def display_region(places_: DataFrame) -> DataFrame:
    """Rows (id, region): the only or most mentioned country, else the only region, else a label for several."""
    countries = places_.where("country IS NOT NULL").groupBy("id", "country").agg(F.sum("mentions").alias("n"))
    best = F.row_number().over(W.partitionBy("id").orderBy(F.desc("n"), "country"))
    top = countries.withColumn("_rank", best).where("_rank <= 2").groupBy("id").agg(
        F.max(F.when(F.col("_rank") == 1, F.col("country"))).alias("first"), F.max(F.when(F.col("_rank") == 1, F.col("n"))).alias("n1"), F.coalesce(F.max(F.when(F.col("_rank") == 2, F.col("n"))), F.lit(0)).alias("n2"))
    regions = places_.groupBy("id").agg(F.count_distinct("region").alias("k"), F.min("region").alias("only"))
    label = F.when(F.col("n1") > F.col("n2"), F.col("first")).when(F.col("k") == 1, F.col("only")).otherwise(SEVERAL)
    return regions.join(top, "id", "left").select("id", label.alias("region"))


def policy(texts: DataFrame, topics: DataFrame, signals: DataFrame, places_: DataFrame | None, topic_order: list[str], relevant_terms: DataFrame, place_terms: DataFrame | None = None) -> DataFrame:
    """Rows (id, topic, topic_score, severity, region, relevant, confidence) of every text.

    texts: id, text, official; topics and signals: lexicons for ``weighted_scores``, the latter with the groups escalation, magnitude and deescalation;
    relevant_terms: term. All but places may end in s or es. The topic has the highest score, then the strongest term, then comes first in ``topic_order``.
    places_: rows as ``places`` gives them, or None with ``place_terms``, its lexicon, whose terms are then found in the same pass over the texts.
    """
    once = {"every": False, "plural": True}
    asked = {"topics": (topics, {"claim": GROUP, **once}), "signals": (signals, {"claim": GROUP, **once}), "known": (relevant_terms.select(F.lit("").alias("group"), "term"), once)}
    weights = [t.select(F.lit(name).alias("lexicon"), "group", "term", F.col("weight").cast("long").alias("weight")) for name, (t, _) in asked.items() if name != "known"]
    weights = weights[0].unionByName(weights[1]).groupBy("lexicon", "group", "term").agg(F.max("weight").alias("weight"))
    if place_terms is not None:
        asked |= _place_terms(place_terms)
    found = places_by_lexicon(marked(texts), asked).select("id", "lexicon", "group", "term")
    weighed = found.join(F.broadcast(weights.withColumn("_weighed", F.lit(True))), ["lexicon", "group", "term"], "left").where("_weighed OR lexicon NOT IN ('topics', 'signals')")
    scores = weighed.groupBy("id", "lexicon", "group").agg(F.sum("weight").alias("score"), F.max("weight").alias("max_weight"), F.count("*").alias("n"))
    is_ = lambda name: F.col("lexicon") == name
    order = F.array_position(F.array(*map(F.lit, topic_order)), F.col("group"))
    best = F.max_by(F.when(is_("topics"), F.struct("group", "score")), F.when(is_("topics"), F.struct("score", "max_weight", -order)))
    columns = [best.alias("t"), *(F.coalesce(F.max(F.when(is_("signals") & (F.col("group") == g), F.col("score"))), F.lit(0)).alias(g) for g in ("escalation", "magnitude", "deescalation")), F.bool_or(is_("known")).alias("_known")]
    if place_terms is not None:
        of = place_terms.where("is_region IS NOT NULL").select(F.when(F.col("is_region"), "areas").otherwise("countries").alias("lexicon"), "group", "region").distinct()
        of = of.groupBy("lexicon", "group").agg(F.collect_set("region").alias("regions"), F.count("*").alias("times"))
        scores = scores.join(F.broadcast(of), ["lexicon", "group"], "left")
        known_place = F.col("times").isNotNull()
        columns += [
            F.sort_array(F.collect_list(F.when(known_place & is_("countries"), F.struct((-F.col("n") * F.col("times")).alias("n"), F.col("group").alias("country"))))).alias("_countries"),
            F.array_distinct(F.flatten(F.collect_list(F.when(known_place, F.col("regions"))))).alias("_regions"), F.bool_or(known_place).alias("_placed"),
        ]
    by_text = scores.groupBy("id").agg(*columns)
    if place_terms is None:
        by_text = by_text.join(display_region(places_).withColumnRenamed("region", "_region"), "id", "full")
    else:
        top = lambda i: F.get("_countries", F.lit(i))
        label = F.when(-top(0)["n"] > F.coalesce(-top(1)["n"], F.lit(0)), top(0)["country"]).when(F.size("_regions") == 1, F.array_min("_regions")).otherwise(SEVERAL)
        by_text = by_text.withColumn("_region", F.when(F.col("_placed"), label))
    by_text = by_text.select("id", F.col("t.group").alias("topic"), F.col("t.score").alias("topic_score"), "escalation", "magnitude", "deescalation", "_known", "_region")
    rows = texts.select("id", "official").join(by_text, "id", "left")
    rows = rows.fillna(0, ["topic_score", "escalation", "magnitude", "deescalation"]).withColumn("topic", F.coalesce("topic", F.lit(NO_TOPIC)))
    e, m, d, base = F.col("escalation"), F.col("magnitude"), F.col("deescalation"), F.when(F.col("topic") == CONFLICT, 2).otherwise(1)
    level = F.when((e >= 6) | ((e >= 3) & (m >= 2)), 4).when((e >= 3) | (m >= 4), 3).when((e >= 2) | (m >= 2) | (F.col("topic") != NO_TOPIC), F.greatest(base, F.lit(2))).otherwise(base)
    level = F.greatest(F.lit(1), F.least(F.lit(4), level - F.when(d >= 4, 2).when(d >= 2, 1).otherwise(0)))
    severity = F.when(level >= 4, "critical").when(level == 3, "high").when(level == 2, "medium").otherwise("low")
    relevant = (F.col("topic_score") >= 2) | F.coalesce("_known", F.lit(False))
    one = lambda c: F.when(c, 1).otherwise(0)
    sure = F.when(relevant, 2).otherwise(1) + one(F.col("topic_score") >= 2) + one(F.col("_region").isNotNull()) + one(F.col("official"))
    confidence = F.when(sure >= 4, "high").when(sure >= 3, "medium").otherwise("low")
    return rows.select("id", "topic", F.col("topic_score").cast("long").alias("topic_score"), severity.alias("severity"), F.coalesce("_region", F.lit(NOWHERE)).alias("region"), relevant.alias("relevant"), confidence.alias("confidence"))

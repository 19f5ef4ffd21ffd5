"""The whole way of news items: context, relevance, places, decision and markers as one plan, with counters from the same pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidewire.operators import context, decision, geography, phrases, signals
from tidewire.operators.context import Lexicons
from tidewire.operators.geography import Gazetteer

#: Counters of a pass, and the condition under which an item counts.
COUNTERS = {
    "items": "true", "accepted": "accepted", "rejected": "NOT accepted", "guarded": "guard IS NOT NULL", "noise": "rejected_by = 'negative_noise'", "low_relevance": "rejected_by = 'low_relevance'",
    "eligible": "accepted AND eligibility = 'eligible'", "needs_location": "accepted AND eligibility = 'needs_location'", "feed_only": "accepted AND eligibility = 'feed_only'", "ambiguous": "accepted AND no_marker = 'ambiguous_competing_locations'",
}
TEXTS = ("title", "summary", "body")


def processed(items: DataFrame, names: Lexicons, keywords: DataFrame, groups: DataFrame, known: Gazetteer, counters: Observation | None = None, body_chars: int | None = context.BODY_CHARS) -> DataFrame:
    """Items with all that ``entity_roles``, ``relevance`` and ``geo_decisions`` add.

    items: id (one row each), title, and where there are such columns summary, body, source_name, official, aggregator and those of ``decision.ITEM``; keywords
    and groups as ``phrase_hits`` and ``relevance`` take them. ``counters`` gets COUNTERS of the rows that the first action on the result, or on what is made of it, reads.
    Items that are not accepted are rejected whatever their place. Null texts have no relevance. Empty table: no rows.
    """
    texts = [F.col(c) for c in TEXTS if c in items.columns]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) if c in items.columns else F.lit(False).alias(c) for c in ("official", "aggregator")]
    read = context.entity_roles(items.select(*(F.col(f"`{c}`") for c in items.columns if c not in ("official", "aggregator")), *flags, F.concat_ws(" ", *texts).alias("_text")), names, body_chars)
    hits = phrases.phrase_hits(items.select("id", F.concat_ws(" ", *texts).alias("text")), keywords)
    judged = phrases.relevance(read.select("id", "official", "aggregator", context.event_domain(F.col("event_type")).alias("context"), "guard"), hits, groups)
    rows = read.join(judged.withColumnRenamed("domain", "primary_domain"), "id")
    out = decision.geo_decisions(geography.location_candidates(rows, known, "_text"), known).drop("_text", "candidates")
    out = out.withColumns({"eligibility": F.when(F.col("accepted"), F.col("eligibility")).otherwise("rejected"), "place": F.when(F.col("accepted"), F.col("place"))})
    return out if counters is None else out.observe(counters, *(F.count_if(F.expr(c)).alias(n) for n, c in COUNTERS.items()))


def event_markers(events: DataFrame) -> DataFrame:
    """Markers, as ``signals.markers`` gives them, of the accepted events that have a place. events: those of ``processed``, with source_id and published_at."""
    located = events.where("accepted AND eligibility = 'eligible' AND place IS NOT NULL")
    return signals.markers(located.select(F.col("id").alias("item_id"), "source_id", "published_at", F.col("score").alias("priority_score"), "place.label", "place.lat", "place.lng"))

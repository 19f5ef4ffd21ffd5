"""Which place marks a news item: an anchor that its event type asks for, else the best of all evidence unless two places compete."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.operators.geography import Gazetteer, locations

#: How much each kind of evidence counts in a domain; kinds that are left out never mark an item.
_EVENTFUL = {"event_location": 106, "target": 98, "payload_coordinates": 94, "country_actor": 90, "official_actor": 88, "venue": 80}
PRIORITIES = {
    "official_statement": {"official_actor": 104, "institution_location": 100, "payload_coordinates": 96, "event_location": 92, "country_actor": 88, "target": 78, "venue": 76},
    "diplomacy": {"venue": 105, "event_location": 96, "official_actor": 90, "institution_location": 86, "country_actor": 84, "payload_coordinates": 84},
    "peace_process": {"venue": 106, "event_location": 98, "target": 86, "official_actor": 84, "country_actor": 82, "payload_coordinates": 84},
    "sanctions_law": {"official_actor": 102, "institution_location": 98, "target": 96, "event_location": 88, "payload_coordinates": 86, "country_actor": 82},
    **dict.fromkeys(("conflict", "crisis", "humanitarian", "border_territory", "instability"), _EVENTFUL),
    "international_org": {"venue": 100, "event_location": 98, "target": 94, "institution_location": 92, "official_actor": 88, "country_actor": 86, "payload_coordinates": 86},
}
#: The kind of evidence that a way of speaking is; scores of strong and moderate evidence; the margin between the two best places.
ROLE_OF = {"official_actor_phrase": "official_actor", "country_actor_phrase": "country_actor", "target_country_phrase": "target", "negotiation_location_phrase": "venue", "event_location_phrase": "event_location", "headline_location_prefix": "event_location", "mentioned_location_phrase": "mentioned_only"}
STRONG, MODERATE, MARGIN, MOST_POINTS, INSTITUTION_POINTS, PAYLOAD_POINTS = 88, 78, 3, 10, 10, 8
#: Sources whose coordinates are trusted, by type and by way of collection; domains in which an official source's own place counts.
TRUSTED_TYPES, TRUSTED_METHODS = ("crisis_humanitarian", "conflict_dataset"), ("dataset", "script_import", "official_page")
OWN_PLACE = ("official_statement", "diplomacy", "sanctions_law", "international_org")
#: The kind of place that evidence gives, and why a domain has it.
BASES = {"institution_location": "institution_location", "official_actor": "actor_country", "country_actor": "actor_country", "target": "target_country", "event_location": "event_location", "venue": "event_location", "payload_coordinates": "event_location"}
REASONS = {"official_statement": "official_statement", "conflict": "conflict", "crisis": "crisis", "humanitarian": "humanitarian", "peace_process": "peace_process", "sanctions_law": "sanctions", "border_territory": "border_incident"}
#: Events that mark nothing, with their eligibility and reason.
UNMARKED = (("analysis_or_opinion", "feed_only", "analysis_or_opinion_item"), ("local_crime", "rejected", "local_crime_not_geopolitical"), ("ordinary_rescue", "rejected", "local_crime_not_geopolitical"), ("sports", "rejected", "sports_or_non_relevant_domain"), ("lifestyle", "rejected", "non_relevant_lifestyle_item"))
_ISSUED, _AFFECTED = ("issuing_institution", "issuing_institution_country"), (("affected_location", "affected_location"), ("affected_country", "affected_country"))
#: For other events the roles whose place marks them, with the marker's reason, in order, and the reason if there is none.
ANCHORS = (
    (("strategic_waterway", "maritime_security"), (("strategic_location", "strategic_topic_location"),), "no_explicit_location"), (("sanctions_impact",), (("impact_location", "impact_location"),), "no_explicit_location"),
    (("health_outbreak", "humanitarian_crisis"), _AFFECTED, "no_explicit_location"), (("diplomatic_visit",), (("destination", "destination_location"),), "no_explicit_location"),
    (("official_appointment", "government_appointment", "national_security_appointment", "defense_appointment", "diplomatic_appointment", "internal_government_decision"), (("issuing_country", "appointment_issuing_country"), _ISSUED), "unresolved_issuing_country"),
    (("meeting", "summit"), (("meeting_venue", "meeting_venue"), ("counterparty_country", "official_counterparty_country")), "unresolved_event_venue"),
    (("attack", "strike", "drone_strike", "missile_strike", "military_incident", "military_operation", "clash"), (_AFFECTED[0], ("event_location", "event_location"), _AFFECTED[1], ("referenced_event_location", "event_location")), "no_explicit_location"),
    (("condemnation", "warning", "official_statement", "diplomatic_message", "defense_policy", "sanctions_announcement", "legal_decision"), (*_AFFECTED, ("issuing_country", "issuing_actor_country"), _ISSUED), "unresolved_official_actor"),
)
#: The way of speaking that a marker's reason stands for, event_location_phrase if it is not here.
WAY_OF = {**dict.fromkeys(("issuing_actor_country", "issuing_institution_country", "appointment_issuing_country"), "official_actor_phrase"), **dict.fromkeys(("destination_location", "meeting_venue", "official_counterparty_country"), "negotiation_location_phrase")}
EVIDENCE = "array<struct<role:string,method:string,label:string,country_code:string,region:string,lat:double,lng:double,strength:string,priority:int,rejection:string>>"
ITEM = {"event_type": "string", "primary_domain": "string", "candidates": "array<struct<label:string,country_code:string,region:string,lat:double,lng:double,method:string,score:int,name:string>>", "strategy": "string", "source_type": "string",
        "collection_method": "string", "official": "boolean", "source_country": "string", "institution_place": "struct<label:string,country_code:string,lat:double,lng:double>", "hint": "struct<label:string,country_code:string,lat:double,lng:double>",
        "destinations": "array<string>", "reasons": "array<string>"}
_ROLES = ("strategic_location", "impact_location", "affected_location", "affected_country", "issuing_country", "issuing_institution", "institution", "meeting_venue", "counterparty_country", "event_location", "referenced_event_location")


def _map(values: dict[str, str | int], key: Column) -> Column:
    out = F.when(F.lit(False), F.lit(None))
    for k, v in values.items():
        out = out.when(key == k, v)
    return out


def _priority(domain: Column, role: Column) -> Column:
    return _map({f"{d}/{r}": p for d, roles in PRIORITIES.items() for r, p in roles.items()}, F.concat(domain, F.lit("/"), role))


def _evidence(domain: Column, role: Column, method: Column, place: Column, strength: Column, points: Column, rejection: Column, region: Column | None = None) -> Column:
    base = _priority(domain, role)
    fine = base.isNotNull() & (strength != "weak")
    return F.struct(
        role.alias("role"), method.alias("method"), place["label"].alias("label"), place["country_code"].alias("country_code"), (F.lit(None).cast("string") if region is None else region).alias("region"), place["lat"].alias("lat"), place["lng"].alias("lng"),
        strength.alias("strength"), F.when(fine, base + F.least(points, F.lit(MOST_POINTS))).cast("int").alias("priority"), F.when(~fine, rejection).alias("rejection"))


def _context(event: Column, strategy: Column) -> tuple[Column, Column, Column, Column]:
    """Anchor, marker reason, eligibility and reason for no marker that an event type gives; all null for events that leave it to the evidence."""
    anchor, marker, eligible, no = (F.when(F.lit(False), F.lit(None).cast("string")) for _ in range(4))
    eligible, no = eligible.when(strategy == "none", "feed_only"), no.when(strategy == "none", "source_entity_not_location")
    for name, how, why in UNMARKED:
        eligible, no = eligible.when(event == name, how), no.when(event == name, why)
    for events, roles, why in ANCHORS:
        here = event.isin(*events)
        first = F.coalesce(*(F.col(r) for r, _ in roles))
        reason = F.when(F.lit(False), "")
        for role, name in roles:
            told = F.when(F.exists("reasons", lambda x: x.contains("summary")), "summary_first_sentence_location").otherwise(name) if role == "affected_country" and "health_outbreak" in events else F.lit(name)
            reason = reason.when(F.col(role).isNotNull(), told)
        anchor, marker = anchor.when(here, first), marker.when(here, reason)
        eligible = eligible.when(here & first.isNull(), F.when(event == "summit", "feed_only").otherwise("needs_location"))
        no = no.when(here & first.isNull(), F.when(F.col("institution").isNotNull(), "institution_without_country_context").otherwise(why) if why == "unresolved_issuing_country" else F.lit(why))
    barred = (strategy == "none") | event.isin(*(e for e, _, _ in UNMARKED))
    given = event.isNotNull()
    return tuple(F.when(given & ~F.coalesce(barred, F.lit(False)), x) for x in (anchor, marker)) + tuple(F.when(given, x) for x in (eligible, no))


def geo_decisions(items: DataFrame, known: Gazetteer) -> DataFrame:
    """Add ``eligibility``, ``place`` (label, country_code, region, lat, lng), ``method``, ``basis``, ``basis_reason``, ``anchor``, ``marker_reason``, ``no_marker`` and ``evidence`` to items.

    items: those columns of ITEM and of the roles of ``entity_roles`` that there are; others count as null. Evidence is the source's own place where its
    strategy or domain puts that first, coordinates of the item, the source's country, which never marks, and the candidates. The best by domain, kind and score wins;
    within MARGIN of it another place makes the item ambiguous, unless the best is a venue or an official, or an event's place against a headline's. No shuffle.
    """
    added = ("eligibility", "place", "method", "basis", "basis_reason", "anchor", "marker_reason", "no_marker", "evidence")
    kept = [c for c in items.columns if c.lower() not in added]
    kinds = ITEM | dict.fromkeys(_ROLES, "string")
    rows = items.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_item"), *(F.col(f"`{c}`").cast(k).alias(c) if c in items.columns else F.lit(None).cast(k).alias(c) for c, k in kinds.items()))
    rows = rows.withColumn("destination", F.get("destinations", 0))
    event, domain, strategy = F.col("event_type"), F.col("primary_domain"), F.coalesce("strategy", F.lit(""))
    anchor, marker, eligible, no = _context(event, strategy)
    rows = rows.withColumns({"_anchor": anchor, "_marker": marker, "_eligible": eligible, "_no": no})
    rows = locations(rows, known, "_anchor", anchors=True)

    official = F.coalesce("official", F.lit(False))
    own = F.col("institution_place").isNotNull() & ((strategy == "institution_location") | (official & domain.isin(*OWN_PLACE)))
    lit, nothing = F.lit, F.lit(None).cast("string")
    institution = F.when(own, _evidence(domain, lit("institution_location"), lit("institution_location"), F.col("institution_place"), lit("strong"), lit(INSTITUTION_POINTS), nothing))
    trusted = official | F.coalesce(F.col("source_type").isin(*TRUSTED_TYPES), lit(False)) | F.coalesce(F.col("collection_method").isin(*TRUSTED_METHODS), lit(False))
    payload = F.when(F.col("hint").isNotNull(), _evidence(domain, lit("payload_coordinates"), lit("payload_coordinates"), F.col("hint"), F.when(trusted, "strong").otherwise("weak"), F.when(trusted, PAYLOAD_POINTS).otherwise(0), lit("untrusted_payload")))
    home = F.struct(nothing.alias("label"), F.col("source_country").alias("country_code"), lit(None).cast("double").alias("lat"), lit(None).cast("double").alias("lng"))
    fallback = F.when(F.col("source_country").isNotNull() & (strategy != "none"), _evidence(lit(""), lit("source_country_fallback"), lit("source_country_fallback"), home, lit("weak"), lit(0), lit("fallback_only")))

    def spoken(c: Column) -> Column:
        role = _map(ROLE_OF, c["method"])
        strength = F.when(c["score"] >= STRONG, "strong").when(c["score"] >= MODERATE, "moderate").otherwise("weak")
        return _evidence(F.col("primary_domain"), role, c["method"], c, strength, F.floor(c["score"] / 10 + 0.5), F.when(role == "mentioned_only", role).when(strength == "weak", "weak_evidence"), c["region"])

    first = F.array_compact(F.array(institution, payload, fallback)).cast(EVIDENCE)
    by_context = F.col("_anchor").isNotNull() | F.col("_eligible").isNotNull()
    rows = rows.withColumn("evidence", F.when(by_context, first).otherwise(F.concat(first, F.coalesce(F.transform("candidates", spoken), F.array()).cast(EVIDENCE))))
    ranked = F.array_sort(F.transform(F.filter("evidence", lambda e: e["priority"].isNotNull()), lambda e: e), lambda a, b: b["priority"] - a["priority"])
    rows = rows.withColumn("_ranked", ranked).withColumn("_top", F.get("_ranked", 0)).withColumn("_next", F.get("_ranked", 1))
    top, other = F.col("_top"), F.col("_next")
    key = lambda e: F.coalesce(e["country_code"], e["label"])
    close = (key(top) != key(other)) & ~top["role"].isin("venue", "official_actor") & ~((top["method"] == "event_location_phrase") & (other["method"] == "headline_location_prefix")) & (top["priority"] - other["priority"] <= MARGIN)
    rows = rows.withColumn("_close", F.coalesce(~by_context & close, lit(False)))
    found = F.col("_anchor").isNotNull() & F.col("location").isNotNull()
    marked = ~by_context & top.isNotNull() & ~F.col("_close")
    place = F.when(found, F.col("location")).when(marked, F.struct(*(top[c].alias(c) for c in ("label", "country_code", "region", "lat", "lng"))))
    method = F.when(found, F.coalesce(_map(WAY_OF, F.col("_marker")), lit("event_location_phrase"))).when(marked, top["method"])
    role = F.when(found, F.coalesce(_map(ROLE_OF, method), lit("event_location"))).when(marked, top["role"])
    reason = F.coalesce(_map(REASONS, domain), lit("fallback"))
    any_evidence = F.size("evidence") > 0
    out = {
        "eligibility": F.when(found | marked, "eligible").when(F.col("_anchor").isNotNull(), "needs_location").otherwise(F.coalesce("_eligible", F.when(~F.col("_close") & (strategy == "none"), "feed_only").otherwise("needs_location"))),
        "place": place, "method": method, "basis": F.coalesce(_map(BASES, role), F.when(any_evidence, "mentioned_country")),
        "basis_reason": F.when(marked & (role == "official_actor") & (domain == "official_statement"), "ministry_statement").when(found | marked, reason).when(any_evidence, "fallback"),
        "anchor": F.coalesce("_anchor", F.when(marked, top["label"])), "marker_reason": F.when(found, F.col("_marker")),
        "no_marker": F.when(found | marked, nothing).when(F.col("_anchor").isNotNull(), "no_explicit_location").otherwise(F.coalesce("_no", F.when(F.col("_close"), "ambiguous_competing_locations").when(strategy == "none", "source_entity_not_location").otherwise("no_explicit_location"))),
        "evidence": F.when(F.col("_close"), F.transform("evidence", lambda e: F.when(e["priority"].isNotNull(), e.withField("rejection", lit("ambiguous_candidates")).withField("priority", lit(None).cast("int"))).otherwise(e))).otherwise(F.col("evidence")),
    }
    return rows.select("_item.*", *(c.alias(n) for n, c in out.items()))

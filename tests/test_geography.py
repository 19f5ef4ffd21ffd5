import pytest

from tidewire.operators import geography as geo
from tidewire.operators.decision import geo_decisions
from tidewire.operators.geography import Place

PLACES = (
    Place("Middle East", 29.8, 44.0, None, "Middle East", ("middle east", "mena")), Place("Iran", 32.0, 53.0, "IR", None, ("iran", "iranian", "tehran", "khamenei"), ("khamenei",)), Place("Israel", 31.5, 35.0, "IL", None, ("israel", "israeli", "tel aviv", "netanyahu"), ("netanyahu",)),
    Place("Turkey", 39.0, 35.0, "TR", None, ("Türkiye", "turkey", "ankara")), Place("Qatar", 25.3, 51.5, "QA", None, ("qatar", "doha")), Place("South Korea", 37.5, 127.0, "KR", None, ("south korea", "seoul")), Place("United States", 38.9, -77.0, "US", None, ("united states", "white house"), ("white house",)),
)


@pytest.fixture(scope="module")
def known(spark):
    return geo.gazetteer(spark, PLACES)


def ways(spark, known, *texts):
    rows = geo.location_candidates(spark.createDataFrame([(i, t, 3) for i, t in enumerate(texts)], "id int, text string, candidates int"), known).collect()
    return [[(c.label, c.method, c.score) for c in r.candidates] for r in sorted(rows, key=lambda r: r.id)]


def test_ways_of_speaking_of_a_place(spark, known):
    got = ways(
        spark, known, "Protests in northern Iran", "Iran's foreign ministry denies it", "Update: Iran", "It was said that Israel rejects it", "Talks held in Doha", "Sanctions on the Iran", "He saw south korea", "The iran of old", None, "",
        "Reports of Tehran and Iranian men", "x Netanyahu said", "Near the white house", "Türkiye'de deprem", "people of the iran")
    assert got[0] == [("Iran", "event_location_phrase", 88)] and got[1] == [("Iran", "official_actor_phrase", 90), ("Iran", "headline_location_prefix", 82)]
    assert got[2] == [("Iran", "headline_location_prefix", 82)] and got[3] == [("Israel", "country_actor_phrase", 84)]
    assert got[4] == [("Qatar", "negotiation_location_phrase", 91), ("Qatar", "event_location_phrase", 88)] and got[5] == [("Iran", "target_country_phrase", 84)]
    assert got[6] == [("South Korea", "mentioned_location_phrase", 74)] and got[7] == got[8] == got[9] == [] and got[10] == [("Iran", "mentioned_location_phrase", 70)]
    assert got[11] == [] and got[12] == [("United States", "event_location_phrase", 95)]
    assert got[13] == [("Turkey", "event_location_phrase", 88), ("Turkey", "headline_location_prefix", 82)] and got[14] == [("Iran", "event_location_phrase", 88)]


def test_best_names_and_places_of_one_country(spark, known):
    double = geo.gazetteer(spark, (*PLACES, Place("Isfahan province", 32.6, 51.6, "IR", None, ("isfahan province",))))
    row = geo.location_candidates(spark.createDataFrame([("In Iran, and in Isfahan province. In Iran",)], "text string"), double).first()
    assert [(c.label, c.method, c.score, c.name) for c in row.candidates] == [("Isfahan province", "event_location_phrase", 95, "isfahan province")]
    long = spark.createDataFrame([("in iran " * 5000,)], "text string")
    assert len(geo.location_candidates(long, known).first().candidates) == 1 and geo.location_candidates(long.where("false"), known).collect() == []
    assert geo.location_candidates(long, geo.gazetteer(spark, ())).first().candidates == []


def test_places_of_texts_and_anchors(spark, known):
    texts = {"middle east": "Middle East", "Iran": "Iran", "white house": "United States", "the white house": None, "war in israel": "Israel", "iran iranian": "Iran", "Turkey president resigns in doha": "Qatar", "none": None, None: None}
    rows = geo.locations(spark.createDataFrame([(t,) for t in texts], "text string"), known, anchors=True).collect()
    assert {r.text: r.location and r.location.label for r in rows} == texts
    assert {r.text: r.official_location.label for r in rows if r.official_location} == {"Turkey president resigns in doha": "Turkey"}
    assert geo.locations(spark.createDataFrame([("Iran",)], "text string"), known).first().location is None


def decide(spark, known, rows, **columns):
    """rows: dicts of columns."""
    names = {"id": "int", "text": "string", "primary_domain": "string", "event_type": "string", "strategy": "string", "official": "boolean", "source_country": "string", "hint": "struct<label:string,country_code:string,lat:double,lng:double>",
             "institution_place": "struct<label:string,country_code:string,lat:double,lng:double>", "affected_country": "string", "issuing_country": "string", "issuing_institution": "string", "institution": "string", "counterparty_country": "string", "destinations": "array<string>", "reasons": "array<string>"}
    frame = spark.createDataFrame([tuple((i if c == "id" else r.get(c)) for c in names) for i, r in enumerate(rows)], ", ".join(f"{c} {k}" for c, k in names.items()))
    return [r for _, r in sorted((r.id, r) for r in geo_decisions(geo.location_candidates(frame, known), known).collect())]


def test_evidence_by_domain_and_ambiguity(spark, known):
    got = decide(
        spark, known, [
            {"text": "Strike in Iran", "primary_domain": "conflict"}, {"text": "Strike in Iran and in Israel", "primary_domain": "conflict"}, {"text": "Talks held in Doha, Iran president says", "primary_domain": "diplomacy"},
            {"text": "He saw south korea", "primary_domain": "conflict", "source_country": "KR"}, {"text": "x", "primary_domain": "conflict", "strategy": "none"}, {"text": "Iran president", "primary_domain": "official_statement"},
            {"text": "x", "primary_domain": "official_statement", "official": True, "institution_place": ("Ankara", "TR", 39.9, 32.9)}, {"text": "x", "primary_domain": "conflict", "official": False, "hint": ("There", None, 1.0, 2.0)},
            {"text": "x", "primary_domain": "conflict", "official": True, "hint": ("There", None, 1.0, 2.0)}, {"text": "Israel: blast in Iran", "primary_domain": "conflict"}, {"text": "in iran", "primary_domain": None},
        ])
    brief = [(r.eligibility, r.place and r.place.label, r.method, r.basis, r.basis_reason, r.no_marker) for r in got]
    assert brief[0] == ("eligible", "Iran", "event_location_phrase", "event_location", "conflict", None)
    assert brief[1] == ("needs_location", None, None, "mentioned_country", "fallback", "ambiguous_competing_locations") and {e.rejection for e in got[1].evidence} == {"ambiguous_candidates"}
    assert brief[2] == ("eligible", "Qatar", "negotiation_location_phrase", "event_location", "fallback", None)
    assert brief[3] == ("needs_location", None, None, "mentioned_country", "fallback", "no_explicit_location") and [e.rejection for e in got[3].evidence] == ["fallback_only", "mentioned_only"]
    assert brief[4] == ("feed_only", None, None, None, None, "source_entity_not_location") and brief[5][4] == "ministry_statement" and brief[5][3] == "actor_country"
    assert brief[6] == ("eligible", "Ankara", "institution_location", "institution_location", "official_statement", None) and got[6].evidence[0].priority == 110
    assert brief[7][0] == "needs_location" and got[7].evidence[0].rejection == "untrusted_payload" and brief[8][:3] == ("eligible", "There", "payload_coordinates")
    assert brief[9][:2] == ("eligible", "Iran") and brief[10][0] == "needs_location"


def test_anchors_of_event_types(spark, known):
    got = decide(
        spark, known, [
            {"text": "in iran", "event_type": "sports", "primary_domain": "conflict"}, {"text": "in iran", "event_type": "analysis_or_opinion"}, {"text": "in iran", "event_type": "health_outbreak", "affected_country": "Qatar", "reasons": ["summary/body health-crisis location"], "primary_domain": "humanitarian"},
            {"text": "in iran", "event_type": "health_outbreak", "affected_country": "Israel"}, {"text": "in iran", "event_type": "diplomatic_visit", "destinations": ["Turkey", "Iran"]}, {"text": "in iran", "event_type": "summit"}, {"text": "in iran", "event_type": "meeting"},
            {"text": "in iran", "event_type": "meeting", "counterparty_country": "Atlantis"}, {"text": "x", "event_type": "defense_appointment", "institution": "Army"}, {"text": "x", "event_type": "defense_appointment", "issuing_country": "United States"}, {"text": "in iran", "event_type": "unknown", "primary_domain": "conflict"},
            {"text": "x", "event_type": "warning", "issuing_institution": "NATO in south korea"}, {"text": "x", "event_type": "warning"}, {"text": "x", "event_type": "strike", "strategy": "none", "affected_country": "Iran"},
        ])
    assert [(r.eligibility, r.place and r.place.label, r.marker_reason, r.no_marker) for r in got] == [
        ("rejected", None, None, "sports_or_non_relevant_domain"), ("feed_only", None, None, "analysis_or_opinion_item"), ("eligible", "Qatar", "summary_first_sentence_location", None), ("eligible", "Israel", "affected_country", None), ("eligible", "Turkey", "destination_location", None),
        ("feed_only", None, None, "unresolved_event_venue"), ("needs_location", None, None, "unresolved_event_venue"), ("needs_location", None, None, "no_explicit_location"), ("needs_location", None, None, "institution_without_country_context"),
        ("eligible", "United States", "appointment_issuing_country", None), ("eligible", "Iran", None, None), ("eligible", "South Korea", "issuing_institution_country", None), ("needs_location", None, None, "unresolved_official_actor"), ("feed_only", None, None, "source_entity_not_location")]
    assert got[4].method == "negotiation_location_phrase" and got[9].basis == "actor_country" and got[7].anchor == "Atlantis" and got[2].basis_reason == "humanitarian"

import pytest
from pyspark.sql import functions as F

from tidewire.operators import context
from tidewire.operators.context import APPOINTMENTS, EVENTS, GUARDS, Lexicons
from tidewire.operators.phrases import relevance

COUNTRIES = (
    ("United States", "united states"), ("United States", "us"), ("United States", "american"), ("Turkey", "turkey"), ("Turkey", "turkish"), ("Israel", "israeli"), ("Israel", "israel"), ("Lebanon", "lebanon"), ("Lebanon", "lebanese"),
    ("Russia", "russia"), ("Russia", "russian"), ("Strait of Hormuz", "strait of hormuz"), ("Red Sea", "red sea"), ("Iran", "iran"), ("Iran", "iranian"), ("Italy", "italian"), ("France", "france"), ("Gaza Strip", "gaza"),
    ("South Korea", "south korea"), ("South Korea", "south korean"), ("Romania", "romania"), ("Montenegro", "montenegro"), ("Democratic Republic of the Congo", "dr congo"), ("Japan", "japan"),
)
TITLES = (("pm", "Prime Minister"), ("president", "President"), ("prime minister", "Prime Minister"), ("foreign minister", "Foreign Minister"), ("defense ministry", "Defense Ministry"), ("army", "Army"), ("minister", "Minister"))
PERSONS = (("Netanyahu", "Israel", "Prime Minister", "Prime Minister's Office", ("netanyahu", "benjamin netanyahu")), ("Donald Trump", "United States", "President", "Presidency", ("trump",)))
LEXICONS = Lexicons(COUNTRIES, TITLES, PERSONS, ("un", "nato"), ("reuters", "bbc"), (("Kremlin", "Russia", ("kremlin",)), ("White House", "United States", ("white house",))), (("foreign ministry", "Foreign Ministry"), ("parliament", "Parliament")), ("Strait of Hormuz", "Red Sea"))


@pytest.fixture(scope="module")
def roles(spark):
    def read(*items):
        rows = [(i, *(x if isinstance(x, tuple) else (x, None, None))) for i, x in enumerate(items)]
        frame = spark.createDataFrame([(*r, "kept", 1) for r in rows], "id int, title string, summary string, body string, event_location string, n int").withColumn("source_name", F.lit("Reuters"))
        return [r for _, r in sorted((r.id, r) for r in context.entity_roles(frame, LEXICONS).collect())]

    return read


def test_every_rule_gives_its_event(spark):
    rows = [(e, f"xx {p} yy") for _, e, ps in GUARDS for p in ps] + [(context.OPINION, p) for p in context.OPINION_PHRASES]
    rows += [(r.event, f"appointed {p}") for r in APPOINTMENTS for p in r.phrases] + [("official_appointment", p) for p in ("appoints someone", "yeni gorev")]
    got = context.event_types(spark.createDataFrame(rows, "want string, text string")).collect()
    assert [(r.text, r.event_type) for r in got] == [(t, w) for w, t in rows]
    order = [r.event for r in EVENTS]
    rows = [(r.event, p) for r in EVENTS for p in r.phrases]
    for r in context.event_types(spark.createDataFrame(rows, "want string, text string")).collect():
        earlier = [e.event for e in EVENTS if any(f" {q} " in f" {r.text} " for q in e.phrases)]
        assert r.event_type == min(earlier, key=order.index) and r.guard is None


def test_order_words_and_odd_texts(spark):
    cases = {
        "Football match after missile strike": "sports", "Opinion: strikes and sanctions": "analysis_or_opinion", "PM names new ambassador after strike": "diplomatic_appointment",
        "Drone strikes hit base, minister says": "drone_strike", "Strikers said": "official_statement", "Salgın uyarısı": "health_outbreak", "": "unknown", None: "unknown", "Scores of warning signs": "unknown",
    }
    got = {r.text: r for r in context.event_types(spark.createDataFrame([(t, "old") for t in cases], "text string, guard string")).collect()}
    assert {t: r.event_type for t, r in got.items()} == cases and got["Football match after missile strike"].guard == "sports_or_non_relevant_domain" and got[None].guard is None


def test_actors(roles):
    got = roles("Netanyahu says American president warned", "Turkish foreign minister visits France", "Foreign Minister Italian parliament", "Russia warned over talks in France with the army", "Lebanon condemned it", "White House and parliament", "UN meeting", None)
    assert [(r.issuing_actor, r.issuing_country, r.issuing_title, r.issuing_institution) for r in got] == [
        ("Netanyahu", "Israel", "Prime Minister", "Prime Minister's Office"), (None, "Turkey", "Foreign Minister", None), (None, "Italy", "Foreign Minister", "Parliament"), (None, "Russia", "Army", None),
        (None, "Lebanon", None, None), (None, "United States", None, "White House"), (None, None, None, "UN"), (None, None, None, None)]
    assert got[1].reasons == ["country_demonym_role: turkish foreign minister -> Turkey", "title location"] and got[1].destinations == ["France"]
    assert got[0].reasons[0] == "known_actor_alias: Netanyahu -> Israel" and got[5].reasons == ["institution_country: White House -> United States"]
    assert got[2].reasons[1] == "institution_inherits_country: Parliament -> Italy" and got[0].source_media == ["reuters"] and got[7].event_type == "unknown" and got[0].n == 1


def test_parts_of_events(roles):
    got = roles(
        "Israeli strike kills Lebanese soldiers", "Drone strikes: Romanian building damaged, Romania hit", ("Ebola outbreak grows", "Cases in DR Congo rise. Japan helps.", None), ("Outbreak", None, "In Montenegro it is quiet. In France not."),
        "Iran warns over Strait of Hormuz and Red Sea", "EU sanctions impact on Montenegro and Russian assets", "PM met with South Korean leader in Japan", "Summit of France", ("A visit", "Russia after talks. Italy", None), "Attack in Gaza by France")
    assert (got[0].event_type, got[0].primary_actor_country, got[0].affected_actor, got[0].affected_country, got[0].event_location) == ("strike", "Israel", "Lebanese soldiers", "Lebanon", "Lebanon")
    assert got[1].referenced_event_location == "Romania" and got[1].event_location == "Romania"
    assert got[2].affected_country == "Democratic Republic of the Congo" and "summary/body health-crisis location" in got[2].reasons and got[2].mentioned_only is None
    assert got[3].affected_country == "Montenegro" and got[4].strategic_location == "Strait of Hormuz" and got[4].event_type == "strategic_waterway"
    assert (got[5].event_type, got[5].impact_location, got[5].target_actor, got[5].issuing_institution) == ("sanctions_impact", "Montenegro", "Russian investments", "EU")
    assert got[6].counterparty_country == "Japan" and got[6].issuing_country == "South Korea" and got[6].partner_country == "Japan" and got[7].counterparty_country == "France"
    assert got[8].blamed_actor == "Russia" and got[8].mentioned_only == "Russia" and (got[9].affected_location, got[9].event_location) == ("Gaza Strip", None)


def test_appointments_and_reasons_for_no_marker(roles):
    got = roles("Turkey president appoints John Smith as envoy", "Parliament names speaker", "Names new chief", "Tennis match in France", "Commentary on Iran", "President appoints the as leader")
    assert [r.no_marker for r in got] == [None, "institution_without_country_context", "unresolved_issuing_country", "sports_or_non_relevant_domain", "analysis_or_opinion_item", "unresolved_issuing_country"]
    assert got[0].appointed_person == "john smith" and got[0].issuing_country == "Turkey" and got[5].appointed_person is None and got[3].guard == "sports_or_non_relevant_domain"


def test_bodies_count_up_to_a_limit(spark):
    frame = spark.createDataFrame([("t", "x " * 700 + "missile strike")], "title string, body string")
    assert context.entity_roles(frame, LEXICONS).first().event_type == "unknown" and context.entity_roles(frame, LEXICONS, body_chars=None).first().event_type == "missile_strike"
    assert context.entity_roles(frame, Lexicons()).first().issuing_country is None and context.entity_roles(frame.where("false"), LEXICONS).collect() == []


def test_guards_reject_items_without_context(spark):
    texts = spark.createDataFrame([(1, True, True, None, "sports"), (2, True, True, "conflict", "sports"), (3, True, True, None, None)], "id long, official boolean, aggregator boolean, context string, guard string")
    hits = spark.createDataFrame([(i, "g", "p", 1) for i in (1, 2, 3)], "id long, group string, phrase string, hits long")
    groups = spark.createDataFrame([("g", "conflict", 18, 0, True)], "group string, domain string, base int, place int, strong boolean")
    assert {r.id: (r.accepted, r.rejected_by) for r in relevance(texts, hits, groups).collect()} == {1: (False, "negative_noise"), 2: (True, None), 3: (True, None)}
    events = spark.createDataFrame([("strike",), ("summit",), ("sports",), ("unknown",)], "e string")
    assert [r.d for r in events.select(context.event_domain(F.col("e")).alias("d")).collect()] == ["conflict", "diplomacy", None, None]

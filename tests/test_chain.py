from datetime import datetime

from pyspark.sql import Observation

from tests.test_context import LEXICONS
from tests.test_geography import PLACES
from tidewire.operators import chain, geography
from tidewire.operators.geography import Place

SEEDS = (
    (1, "tass", "Missile strike hits military base near Kharkiv, officials report", False), (2, "tass", "Foreign ministry issues warning over border clashes in Syria", False), (3, "wam", "UAE foreign minister meets delegation for ceasefire talks", True),
    (4, "tass", "Ten best summer dessert recipes for the weekend", False), (5, "tass", "Football match ends in Iran", False), (6, "tass", None, False), (7, "tass", "Clashes in Iran and shelling in Israel", True),
)


def test_one_pass_from_items_to_markers(spark):
    known = geography.gazetteer(spark, (*PLACES, Place("Ukraine", 49.0, 32.0, "UA", None, ("ukraine", "kharkiv")), Place("Syria", 35.0, 38.0, "SY", None, ("syria",))))
    seat = "struct<label:string,country_code:string,lat:double,lng:double>"
    rows = [(i, s, t, "Synthetic summary.", o, s == "wam", datetime(2024, 1, 1, i), ("Abu Dhabi", "AE", 24.4, 54.4) if s == "wam" else None, "institution_location" if s == "wam" else None) for i, s, t, o in SEEDS]
    items = spark.createDataFrame(rows, f"id long, source_id string, title string, summary string, official boolean, aggregator boolean, published_at timestamp, institution_place {seat}, strategy string")
    keywords = spark.createDataFrame([("conflict.hard", "missile strike"), ("conflict.hard", "border clashes"), ("conflict.hard", "Clashes"), ("conflict.hard", "shelling"), ("diplomacy.hard", "foreign minister"), ("diplomacy.hard", "foreign ministry"), ("peace.hard", "ceasefire"), ("negative", "recipes")], "group string, phrase string")
    groups = spark.createDataFrame([("conflict.hard", "conflict", 18, 0, True), ("diplomacy.hard", "diplomacy", 18, 1, True), ("peace.hard", "peace_process", 18, 2, True)], "group string, domain string, base int, place int, strong boolean")
    counters = Observation("pass")
    events = chain.processed(items, LEXICONS, keywords, groups, known, counters)
    markers = chain.event_markers(events)
    got = {r.label: (r.n_items, r.lead) for r in markers.collect()}
    assert got == {"Abu Dhabi": (1, 3), "Syria": (1, 2)}
    seen = {r.id: r for r in events.collect()}
    assert seen[4].rejected_by == "negative_noise" and seen[5].rejected_by == "negative_noise" and seen[5].guard and not seen[6].accepted and seen[1].event_type == "missile_strike" and seen[1].accepted
    assert seen[7].no_marker == "ambiguous_competing_locations" and seen[7].place is None and seen[4].eligibility == "rejected"
    assert counters.get["items"] == 7 and counters.get["accepted"] == sum(r.accepted for r in seen.values()) and counters.get["guarded"] == 1 and counters.get["ambiguous"] == 1
    assert counters.get["accepted"] + counters.get["rejected"] == 7 and counters.get["eligible"] == sum(r.accepted and r.eligibility == "eligible" for r in seen.values())
    assert chain.processed(items.where("false"), LEXICONS, keywords, groups, known).collect() == []

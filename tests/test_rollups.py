import random
from datetime import datetime

from tidewire.operators import rollups


def test_kth_smallest_against_sorting(spark):
    rng = random.Random(5)
    values = [rng.choice([rng.randrange(-50, 50), rng.randrange(-(2**62), 2**62), 7]) for _ in range(600)]
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v long")
    for k in (1, 2, 300, 599, 600):
        assert rollups.kth_smallest(rows, "v", k) == sorted(values)[k - 1]
    assert rollups.kth_smallest(rows, "v", 0) is None
    assert rollups.kth_smallest(rows, "v", 601) is None


def test_momentum(spark):
    rows = spark.createDataFrame([(1, ["a", "a"]), (2, ["a", None]), (3, ["b"]), (4, ["b", "a"]), (5, [])], "ordinal long, segments array<string>")
    got = {r.segment: (r.n, r.change, r["rank"]) for r in rollups.momentum(rows).collect()}
    assert got == {"a": (3, 66.7, 1), "b": (2, -66.7, 2)}
    assert rollups.momentum(rows.limit(0)).count() == 0


def test_pressure_bands(spark):
    rows = spark.createDataFrame([("x", None)] + [("y", True)] * 2 + [("z", True)] * 9, "commodity string, stressed boolean")
    got = {r.commodity: (r.score, r.status) for r in rollups.pressure(rows).collect()}
    assert got == {"x": (12, "Moderate"), "y": (36, "Elevated"), "z": (100, "Critical")}


def test_topics_without_items_and_empty_table(spark):
    rows = spark.createDataFrame([("b",), ("b",), (None,), ("?",)], "topic string")
    got = [tuple(r) for r in rollups.topic_metrics(rows, ["a", "b", "c"]).orderBy("rank").collect()]
    assert got == [("b", 2, 1.0, 1), ("a", 0, 0.0, 2), ("c", 0, 0.0, 3)]
    assert [r.share for r in rollups.topic_metrics(rows.limit(0), ["a"]).collect()] == [0.0]


def test_consolidated_centre(spark):
    rows = spark.createDataFrame([("p", "u", "low", 1, 0.0, 0.0), ("p", "v", "high", 3, 4.0, 8.0), ("p", "v", "low", 1, None, 1.0)], "label string, category string, level string, reports long, lat double, lng double")
    r = rollups.consolidate(rows, ["low", "medium", "high"]).first()
    assert (r.reports, r.level, r.lat, r.lng, r.n_categories) == (4, "high", 3.0, 6.0, 2)


def test_view_alerts(spark):
    entries = spark.createDataFrame([(1, "x", "s", "The end"), (2, "y", "t", None), (3, None, "s", "the")], "entry_id int, layer string, source string, text string")
    views = spark.createDataFrame([(1, None, None, "THE"), (2, None, "t", None), (3, "x", None, None)], "view_id int, layer string, source string, query string")
    seen = spark.createDataFrame([(3, 1)], "view_id int, entry_id int")
    assert sorted(map(tuple, rollups.view_alerts(entries, views, seen).collect())) == [(1, 1), (2, 2)]
    assert rollups.view_alerts(entries.limit(0), views, seen).count() == 0


def test_ring_layout_few_cards(spark):
    cards = spark.createDataFrame([(0,), (1,)], "place int")
    assert [(r.x, r.y) for r in rollups.ring_layout(cards).orderBy("place").collect()] == [(17.0, 50.0), (83.0, 50.0)]
    assert rollups.ring_layout(cards.limit(1)).first().x == 50.0


def test_feed_state(spark):
    at = datetime(2024, 1, 1, 1)
    rows = spark.createDataFrame([("current", datetime(2024, 1, 1, 0, 45), "ready"), ("current", datetime(2024, 1, 1), "ready"), ("previous", at, "ready")], "slot string, generated_at timestamp, state string")
    assert sorted((r.age_seconds, r.state) for r in rollups.feed_state(rows, at).collect()) == [(0, "stale"), (900, "ready"), (3600, "stale")]

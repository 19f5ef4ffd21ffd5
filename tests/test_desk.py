from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.operators import desk, health

NOW = datetime(2024, 1, 10)


def poll(spark, **change):
    base = dict(interval_s=1000, streak=0, failures=0, observed_s=None, ttl_s=None, max_age_s=None, min_s=300, max_s=7200, daily_budget=None, ok=True, new_items=0, parsed_items=10, rate_limited=False, retry_after_s=None, chance=0.5)
    kinds = "interval_s long, streak long, failures long, observed_s long, ttl_s long, max_age_s long, min_s long, max_s long, daily_budget long, ok boolean, new_items long, parsed_items long, rate_limited boolean, retry_after_s long, chance double"
    r = health.next_poll(spark.createDataFrame([tuple((base | change).values())], kinds)).first()
    return r.interval_s, r.delay_s, r.reason, r.streak, r.failures


def test_next_poll(spark):
    assert poll(spark, new_items=5) == (700, 700, "observed_cadence", 0, 0) and poll(spark, new_items=1, failures=3) == (850, 850, "observed_cadence", 0, 0)
    assert poll(spark, streak=1) == (1000, 1000, "observed_cadence", 2, 0) and poll(spark, streak=2) == (1500, 1500, "observed_cadence", 3, 0)
    assert poll(spark, ok=False) == (1000, 2000, "backoff", 0, 1) and poll(spark, ok=False, failures=9) == (1000, 21600, "backoff", 0, 10)
    assert poll(spark, ok=False, rate_limited=True, retry_after_s=50000)[1] == 50000
    assert poll(spark, observed_s=4000)[0] == 1500 and poll(spark, ttl_s=3000, max_age_s=10)[0::2] == (3000, "rss_hint", 0)
    assert poll(spark, daily_budget=10)[0::2] == (10800, "quota", 0) and poll(spark, interval_s=10)[0] == 300
    assert poll(spark, chance=0.0)[1] == 900 and poll(spark, chance=0.999999)[1] == 1100


def test_runs_and_slots(spark):
    rows = [(1, True, 2, 0, 5), (1, False, None, 1, 6), (2, True, 1, 1, 1), (3, False, 0, 0, 9), (3, None, 0, 0, 9)]
    runs = health.run_results(spark.createDataFrame(rows, "run_id int, ok boolean, new_items int, duplicates int, duration_ms int"))
    assert {r.run_id: (r.status, r.attempted, r.succeeded, r.new_items, r.duration_ms) for r in runs.collect()} == {1: ("partial", 2, 1, 2, 11), 2: ("success", 1, 1, 1, 1), 3: ("failed", 2, 0, 0, 18)}
    assert tuple(health.run_totals(runs).first()) == (3, 1, 1, 1, 3, 1, 18)
    slots = spark.createDataFrame([("a", "current", NOW, 1), ("a", "previous", NOW, 0), ("b", "previous", NOW - timedelta(hours=1), 5), ("c", "current", NOW - timedelta(seconds=901), 7)], "payload_type string, slot string, generated_at timestamp, body int")
    new = spark.createDataFrame([("a", NOW, 2), ("d", NOW, 9)], "payload_type string, generated_at timestamp, body int")
    after = health.swap_slots(slots, new)
    assert sorted((r.payload_type, r.slot, r.body) for r in after.collect()) == [("a", "current", 2), ("a", "previous", 1), ("b", "previous", 5), ("c", "current", 7), ("d", "current", 9)]
    assert {r.payload_type: r.body for r in health.served(after).collect()} == {"a": 2, "b": 5, "c": 7, "d": 9}
    types, fresh = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "payload_type string"), spark.createDataFrame([("d",)], "payload_type string")
    assert sorted(r.payload_type for r in health.to_rebuild(after, fresh, types, NOW).collect()) == ["b", "c", "d"]


def test_coverage_of_no_and_some_sources(spark):
    state = spark.createDataFrame([("a", True, NOW, 60), ("b", True, None, 60), ("c", False, NOW, 60), ("x", True, NOW, 60)], "source_id string, enabled boolean, last_success_at timestamp, interval_s long")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "source_id string")
    got = health.coverage(state, ids("a", "b", "c"), ids("a", "a", "q"), NOW, ["b", "a"]).first()
    assert tuple(got) == (3, 2, 1, 1, "partial", ["enabled_2_of_3", "critical_overdue_b", "fresh_sources_below_80pct"])
    assert tuple(health.coverage(state, ids("a"), ids(), NOW).first()) == (1, 1, 1, 0, "fresh", [])
    assert health.coverage(state.limit(0), ids("a"), ids(), NOW).first().reasons == ["enabled_0_of_1"]


def test_outcomes_and_changes(spark):
    rows = [(200, None, False, 3), (200, None, False, 0), (304, None, True, 0), (429, None, False, 0), (403, None, False, 0), (500, None, False, 0), (None, "timeout", False, 0), (None, "blocked_address", False, 0)]
    got = spark.createDataFrame(rows, "status int, code string, unmodified boolean, n int").select(health.fetch_outcome(*map(F.col, ("status", "code", "unmodified", "n"))).alias("x"))
    assert [r.x for r in got.collect()] == ["new_items", "unchanged", "not_modified", "error:rate_limited", "error:blocked", "error:temporary", "error:temporary", "error:blocked"]
    kinds = "source_id string, status int, etag string, last_modified string"
    fetches = spark.createDataFrame([("a", 304, None, None), ("b", 200, "e", None), ("c", 200, "f", "m"), ("d", 200, None, "m"), ("e", 200, None, None)], kinds)
    known = spark.createDataFrame([("b", 200, "e", None), ("c", 200, "e", "m"), ("d", 200, None, "m")], kinds)
    assert sorted(r.source_id for r in health.changed(fetches, known).collect()) == ["c", "e"]


def test_first_rows_and_seen(spark):
    rows = spark.createDataFrame([(2, "u", "x"), (1, "u", "y"), (3, None, "z"), (4, None, "w")], "o int, k string, v string")
    assert sorted(r.v for r in health.first_rows(rows, "k", "o").collect()) == ["w", "y", "z"]
    old, new = spark.createDataFrame([("v", i, i) for i in range(5)], "view_id string, entry_id long, at long"), spark.createDataFrame([("v", 1, 9), ("v", 7, 8)], "view_id string, entry_id long, at long")
    assert sorted(r.entry_id for r in health.seen_ids(old, new, 3).collect()) == [1, 4, 7]


def test_cyber_roles(spark):
    hits = spark.createDataFrame([(1, "eu", "neutral", "fr"), (1, "eu", "target", "de"), (1, "eu", "origin", "de"), (2, "eu", "neutral", "fr"), (3, "as", "neutral", None)], "item_id int, region string, role string, country string")
    got = {r.region: (r.n, r.target, r.origin, r.neutral, r.dominant, r.countries) for r in desk.cyber_regions(hits, 4).collect()}
    assert got == {"eu": (2, 1, 1, 1, "target", ["fr", "de"]), "as": (1, 0, 0, 1, "neutral", [])}


def test_fresh_enough_and_names(spark):
    rows = spark.createDataFrame([(1, NOW, NOW - timedelta(hours=48)), (2, NOW, NOW - timedelta(hours=47)), (3, NOW, None), (4, None, NOW), (5, NOW, NOW + timedelta(1))], "i int, collected_at timestamp, published_at timestamp")
    assert [r.i for r in desk.fresh_enough(rows).collect()] == [2, 3, 4, 5]
    names = spark.createDataFrame([("Şanlıurfa  Æbelø Straße",)], "n string")
    assert names.select(desk.boundary_key(F.col("n")).alias("k")).first().k == "sanliurfa aebelo strasse"
    assert names.select(desk.title_case(F.lit("needs_location-now")).alias("k"), desk.date_time(F.lit(None).cast("timestamp")).alias("d")).first() == ("Needs Location Now", "—")
    units = spark.createDataFrame([(1, "a%b", 1, "a%b"), (2, "axb", 1, "axb"), (3, "a%bc", 0, "a%bc")], "unit_id int, name string, level int, key string")
    assert [r.unit_id for r in desk.boundary_search(units, "A%b").collect()] == [1, 3] and desk.boundary_search(units, "a").count() == 0


def test_lines_and_references(spark):
    lines = spark.createDataFrame([(1, '{"id": "a", "name": "first"}'), (2, "junk"), (3, '{"id": "a", "name": "second"}'), (4, '{"name": "none"}')], "ordinal int, value string")
    assert [tuple(r) for r in desk.ndjson_units(lines, "id string, name string").collect()] == [("a", "first")]
    markers, items = spark.createDataFrame([(1, [3, 9, 2]), (2, [])], "marker_id int, item_ids array<int>"), spark.createDataFrame([(2, "b"), (3, "c")], "item_id int, name string")
    assert {r.marker_id: r["items"] and [x.name for x in r["items"]] for r in desk.rehydrate(markers, items).collect()} == {1: ["c", "b"], 2: None}
    assert desk.json_lines(spark.createDataFrame([(1, None)], "a int, b string")).first().line == '{"a":1,"b":null}'


def test_source_table_order(spark):
    kinds = "source_id int, name string, type string, method string, config string, region string, domains array<string>, runtime string, origin string, items int, accepted int, markers int, last_check_mins int"
    rows = [(1, "B", "t", "rss", "on", "eu", ["x"], "ok", "personal", 3, 1, 1, 5), (2, "a", "t", "api", "off", None, [], "error", "built_in", 1, 0, 0, None), (3, "C", "u", "rss", "on", "as", ["Sea"], "idle", "built_in", 2, 2, 2, 1)]
    table = spark.createDataFrame(rows, kinds)
    ids = lambda *a, **k: [r.source_id for r in desk.source_table(table, *a, **k).collect()]
    assert ids() == [2, 1, 3] and ids(sort="lastCheck") == [3, 1, 2] and ids(sort="items", descending=True) == [1, 3, 2] and ids(sort="runtime") == [1, 2, 3]
    assert ids("errors") == [2] and ids("personal") == [1] and ids("needsLocation") == [2] and ids(methods=("rss",), query=" SEA ") == [3]
    assert tuple(desk.source_kpis(table).first()) == (3, 1, 0, 1, 1, 1)


def test_stream_and_column_agree_on_the_next_poll(spark):
    import random

    from tidewire.streaming import cadence

    rng, rows = random.Random(8), []
    for i in range(400):
        some = lambda n: rng.choice([None, 0, rng.randrange(1, n)])
        rows.append((i, rng.randrange(50, 9000), rng.randrange(5), rng.randrange(8), some(9000), some(5000), some(5000), 300, 4000, some(400), rng.random() < 0.7, rng.choice([0, 0, rng.randrange(9)]), 10, rng.random() < 0.3, some(60000), rng.random()))
    kinds = "i long, interval_s long, streak long, failures long, observed_s long, ttl_s long, max_age_s long, min_s long, max_s long, daily_budget long, ok boolean, new_items long, parsed_items long, rate_limited boolean, retry_after_s long, chance double"
    got = {r.i: (r.interval_s, r.delay_s, r.streak, r.failures) for r in health.next_poll(spark.createDataFrame(rows, kinds)).collect()}
    for i, interval, streak, failures, observed, ttl, age, low, high, budget, ok, new, parsed, limited, after, chance in rows:
        a, b, c = cadence.next_interval(interval, streak, failures, ok, new, parsed, low, high, observed or 0, max(ttl or 0, age or 0), budget or 0)
        assert got[i] == (a, cadence.delay(a, c, low, (after or 0) if limited else 0, chance), b, c), i


def test_views_of_one_large_layer_do_not_gather_it(spark, monkeypatch):
    entries = spark.range(500).select(F.col("id").alias("entry_id"), F.when(F.col("id") >= 0, "en").alias("layer"), F.lit("s").alias("source"), F.array(F.lit("c")).alias("countries"), F.concat(F.lit("title "), F.col("id") % 7).alias("title"), F.lit("").alias("summary"), F.lit(None).cast("string").alias("tone"), F.lit(datetime(2024, 1, 1)).alias("published_at"))
    views = spark.createDataFrame([(1, ["en", "de"], None, None, "title 3", None), (2, ["en"], "s", None, "", 48), (3, ["de"], None, None, "", None)], "view_id long, layers array<string>, source string, country string, query string, hours int")
    found = desk.matches_view(entries, views, datetime(2024, 1, 2))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" in plan and "SortMergeJoin" not in plan
    want = sorted([(1, i) for i in range(500) if i % 7 == 3] + [(2, i) for i in range(500)])
    assert sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(desk, "BROADCAST_VIEWS", 1)
    dealt = desk.matches_view(entries, views, datetime(2024, 1, 2))
    assert sorted(map(tuple, dealt.collect())) == want
    assert "_part" in dealt._jdf.queryExecution().executedPlan().toString()

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.functions import text as fn
from tidewire.operators import phrases, signals, store
from tidewire.sources import feeds
from tidewire.streaming import cadence


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first().x


def test_urls(spark):
    cases = {
        "https://Example.COM/Path/?utm_source=x&id=5#top": "https://example.com/Path?id=5", "http://a.org": "http://a.org/", "https://a.org/?ref=b": "https://a.org/",
        "javascript:alert(1)": None, "ftp://a.org/x": None, "": None,
    }
    for url, want in cases.items():
        assert one(spark, fn.canonical_url(F.col("u")), u=url) == want


def test_text_functions(spark):
    assert one(spark, fn.plain_words(F.col("t")), t="  Über-größe, Été! ") == "uber gro e ete"
    assert one(spark, fn.tokens(F.col("t")), t="Missiles missile pass of glass") == ["missile", "pass", "glass"]
    a, b, c = (one(spark, fn.fingerprint(F.col("s"), F.col("t"), F.col("p")), s=s, t=t, p=p) for s, t, p in (("x", "A b!", "1"), ("x", "a  B", "1"), ("x", "a b", "2")))
    assert a == b != c and len(a) == 64
    private = {"10.1.2.3": True, "172.20.0.1": True, "100.64.0.1": True, "169.254.1.1": True, "8.8.8.8": False, "::1": True, "fd00::1": True, "2001:4860::8888": False, "::ffff:192.168.1.1": True, "junk": True}
    for ip, want in private.items():
        assert one(spark, fn.private_address(F.col("i")), i=ip) is want


def test_density(spark):
    now = datetime(2024, 1, 10)
    rows = [(True, now - timedelta(hours=h), r, d) for h, r, d in ((1, "europe", "conflict"), (2, "europe", "diplomacy"), (3, None, "conflict"), (30, "middle_east", "diplomacy"))]
    got = {(r.hours, r.kind, r.key): r for r in signals.density(spark.createDataFrame(rows, "accepted boolean, published_at timestamp, region string, primary_domain string"), now).collect()}
    assert got[6, "total", "all"].n == 3 and got[48, "total", "all"].n == 4 and got[6, "region", "unspecified"].n == 1
    assert abs(sum(r.share for k, r in got.items() if k[:2] == (48, "region")) - 1) < 1e-5


def test_phrases_are_whole_words(spark):
    texts = spark.createDataFrame([(1, "War, war! Warm peace talks; peace talks."), (2, None), (3, "")], "id long, text string")
    lexicon = spark.createDataFrame([("a", "war"), ("b", "peace talks"), ("c", "war")], "group string, phrase string")
    got = {(r.id, r.group, r.phrase): r.hits for r in phrases.phrase_hits(texts, lexicon).collect()}
    assert got == {(1, "a", "war"): 2, (1, "c", "war"): 2, (1, "b", "peace talks"): 2}


def test_new_items_and_retention(spark):
    now, cols = datetime(2024, 1, 10), "source_id string, ordinal long, fingerprint string, upstream_id string, canonical_url string"
    known = spark.createDataFrame([("s", 0, "f0", "u0", "c0")], cols)
    batch = spark.createDataFrame([("s", 1, "f0", None, None), ("s", 2, "f2", "u0", None), ("s", 3, "f3", None, "c0"), ("s", 4, "f4", "u4", None), ("s", 5, "f4", "u5", None), ("t", 6, "f0", "u0", "c0"), ("s", 7, "f7", None, None), ("s", 8, "f8", None, None)], cols)
    stones = spark.createDataFrame([("s", "f7", now + timedelta(days=1)), ("s", "f8", now - timedelta(days=1))], "source_id string, fingerprint string, expires_at timestamp")
    assert sorted(r.ordinal for r in store.new_items(batch, known, stones, now).collect()) == [4, 6, 8]
    items = spark.createDataFrame([("s", "a", now), ("s", "b", now + timedelta(hours=1)), ("s", "c", None)], "source_id string, fingerprint string, expires_at timestamp")
    stay, gone = store.expire(items, now)
    assert sorted(r.fingerprint for r in stay.collect()) == ["b", "c"] and [r.fingerprint for r in gone.collect()] == ["a"]


def test_feeds(spark):
    rss = '<rss><channel><title>C</title><ttl>15</ttl><item><title><![CDATA[One &amp; <b>two</b>]]></title><link>https://a.org/x?a=1&amp;b=2</link><guid>g1</guid><pubDate>now</pubDate></item><item><title></title></item></channel></rss>'
    atom = '<feed><entry><title>T</title><id>i</id><link rel="self" href="s"/><link rel="alternate" href="https://b.org"/><updated>u</updated><published>p</published></entry></feed>'
    rows = spark.createDataFrame([("r", rss), ("a", atom), ("h", "<html><item><title>x</title></item></html>"), ("n", None)], "source_id string, body string")
    got = {r.source_id: r for r in feeds.xml_items(rows).collect()}
    assert set(got) == {"r", "a"} and got["r"].title == "One & two" and got["r"].link == "https://a.org/x?a=1&b=2" and got["a"].link == "https://b.org" and got["a"].published == "p"
    assert rows.where("source_id = 'r'").select(feeds.ttl_seconds(F.col("body")).alias("t")).first().t == 900
    js = spark.createDataFrame([("j", '{"articles": [{"title": "A", "url": "u"}, {"url": "no title"}]}'), ("k", '{"data": {"items": [{"headline": "B"}]}}'), ("x", "junk")], "source_id string, body string")
    assert sorted((r.source_id, r.title) for r in feeds.json_items(js).collect()) == [("j", "A"), ("k", "B")]


def test_nearest_unit_of_all_units(spark, tmp_path):
    from tidewire.plans import news

    rng, names = random.Random(3), ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    people = [(k, names[rng.randrange(5)]) for k in range(300)] + [(300, None)]
    parts = [(k, rng.randrange(1, 9)) for k in range(5000)]
    spark.createDataFrame(people, "c_custkey long, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    spark.createDataFrame(parts, "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    want = {}
    for k, name in people:
        lat, lng = k % 90, k % 170
        near = [((lat - p % 90) ** 2 + (lng - p % 170) ** 2, p) for p, size in parts if names[p % 5] == name and abs(lat - p % 90) <= size and abs(lng - p % 170) <= size]
        if near:
            want[k] = min(near)[1]
    assert {r.point_id: r.unit_id for r in news.nearest_unit(spark, str(tmp_path)).collect()} == want and max(want.values()) > 2000


def test_nearest_unit_at_edges(spark):
    points = spark.createDataFrame([(1, "n", -10.0, 10.0), (2, "n", -0.5, 180.0), (2, "n", 5.0, 5.0), (3, "n", None, 1.0), (4, "m", 5.0, 5.0)], "point_id long, name string, lat double, lng double")
    units = [(7, "n", -30.0, -10.0, 10.0, 10.0), (8, "n", -10.0, 25.0, -180.0, 180.0), (9, "n", 4.0, 6.0, 4.0, 6.0), (10, "n", 4.0, 6.0, 4.0, 6.0), (11, "n", 6.0, 4.0, 4.0, 6.0), (12, "m", None, 6.0, 4.0, 6.0)]
    units = spark.createDataFrame(units, "unit_id long, name string, min_lat double, max_lat double, min_lng double, max_lng double")
    assert {r.point_id: r.unit_id for r in signals.nearest_unit(points, units).collect()} == {1: 7, 2: 9}


def test_nearest_unit_keeps_places_not_pairs(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    people = [(rng.randrange(250), rng.choice("ab"), float(rng.randrange(-9, 10)), float(rng.randrange(-20, 20))) for _ in range(300)]
    boxes = [(k, rng.choice("ab"), *sorted((float(rng.randrange(-12, 12)), float(rng.randrange(-12, 12)))), *sorted((float(rng.randrange(-25, 25)), float(rng.randrange(-25, 25))))) for k in range(400)]
    spark.createDataFrame(people, "point_id long, name string, lat double, lng double").write.parquet(f"{tmp_path}/points")
    spark.createDataFrame(boxes, "unit_id long, name string, min_lat double, max_lat double, min_lng double, max_lng double").write.parquet(f"{tmp_path}/units")
    points, units = spark.read.parquet(f"{tmp_path}/points"), spark.read.parquet(f"{tmp_path}/units")
    want, ties = {}, 0
    for p, name, lat, lng in people:  # whole degrees, so that many centres are as far, and repeated points
        near = sorted(((lat - (a + b) / 2) ** 2 + (lng - (c + d) / 2) ** 2, u) for u, n, a, b, c, d in boxes if n == name and a <= lat <= b and c <= lng <= d)
        ties += len(near) > 1 and near[0][0] == near[1][0]
        if near:
            want[p] = min(near[0], want.get(p, near[0]))
    assert ties > 5
    for most in (200_000, 10):
        monkeypatch.setattr(signals, "MAX_BROADCAST_PLACES", most, raising=False)
        got = signals.nearest_unit(points, units)
        assert {r.point_id: r.unit_id for r in got.collect()} == {p: u for p, (_, u) in want.items()}
        plan = got._jdf.queryExecution().executedPlan().toString()
        # no sort of all pairs by place, no broadcast of boxes in all of their cells
        assert "SortAggregate(key=[name" not in plan and not any("BroadcastHashJoin" in x and "lat_cell" in x for x in plan.splitlines())


def test_feed_summaries_whole_and_titled_items_counted(spark):
    block = "<item><title>{}</title><description>{}</description></item>"
    late = "<rss>" + "".join(block.format(f"t{i}" if i >= 60 else "", "s") for i in range(210)) + "</rss>"
    full = "<rss>" + "".join(block.format(f"t{i}", "s") for i in range(200)) + "</rss>"
    long = "<rss>" + block.format("t", "word " * 2000) + "</rss>"
    rows = spark.createDataFrame([("late", late), ("full", full), ("full", full), ("long", long)], "source_id string, body string")
    got = feeds.xml_items(rows).collect()
    assert [r.ordinal for r in got if r.source_id == "late"] == list(range(60, 200))
    assert sorted(r.ordinal for r in got if r.source_id == "full") == sorted([*range(150), *range(150)])
    assert [r.summary for r in got if r.source_id == "long"] == [("word " * 2000).strip()]


def test_cadence_over_batches(spark, tmp_path):
    assert cadence.next_interval(1000, 0, 0, True, 5, 10) == (700, 0, 0) and cadence.next_interval(1000, 0, 0, True, 1, 10) == (850, 0, 0)
    assert cadence.next_interval(1000, 2, 1, True, 0, 9) == (1500, 3, 0) and cadence.next_interval(1000, 2, 1, False, 0, 0) == (1000, 2, 2)
    schema = "source_id string, poll_id long, at long, ok boolean, new_items long, parsed_items long"
    polls = [("s", 1, 1, True, 5, 10), ("s", 2, 2, False, 0, 0), ("t", 3, 3, True, 0, 9), ("s", 4, 4, True, 1, 10)]
    for i, p in enumerate(polls):
        spark.createDataFrame([p], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    run = cadence.cadence(stream).writeStream.outputMode("update").format("memory").queryName("cadence").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = {r.source_id: r for r in spark.table("cadence").collect()}
    assert last["t"].interval_s == 900 and last["t"].streak == 1
    assert {r.interval_s for r in spark.table("cadence").where("source_id = 's'").collect()} == {630, 536}

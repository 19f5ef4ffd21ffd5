import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidewire.functions import text as fn
from tidewire.operators import phrases, store
from tidewire.sources import feeds


def values(spark, column, cells):
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(cells)], "i int, x string").select("i", column.alias("y")).collect()
    return [r.y for r in sorted(rows)]


def test_addresses_fail_closed(spark):
    private = ["8.8.8.999", "zz:zz", "1.2.3", "08.8.8.8", ":::", "1:2:3:4:5:6:7:8:9", "fe80::1", "fc00::", "::ffff:10.0.0.1", "::ffff:808:808", "::", "224.0.0.1", None, "", "fd12:3456::1"]
    public = ["8.8.8.8", "2001:4860:4860::8888", "::ffff:8.8.8.8", "1:2:3:4:5:6:7:8", "64:ff9b::8.8.8.8", "2001:DB8::"]
    assert values(spark, fn.private_address(F.col("x")), private + public) == [True] * len(private) + [False] * len(public)


def test_canonical_urls(spark):
    cases = {
        "HTTPS://A.org:443/x/?yclid=1&cmpid=2&ncid=3&ico=4&igshid=5#f": "https://a.org/x?igshid=5", "http://a.org:80": "http://a.org/", "http://a.org:8080/": "http://a.org:8080/",
        "https://a.org/?UTM_Source=x&utm_=1&b=x%20y&c": "https://a.org/?utm_=1&b=x+y&c=", "https://u:p@A.org/p//": "https://u:p@a.org/p", "https://": None, "http://a b/": None, "mailto:x": None, "https://a.org/?q=%zz": "https://a.org/?q=%25zz",
    }
    assert values(spark, fn.canonical_url(F.col("x")), cases) == list(cases.values())


def test_fingerprints_tell_scripts_apart(spark):
    titles = ["Новости дня", "Другая новость", "ＮＥＷＳ ﬁre", "news fire", "Été — 2024!", "ete 2024"]
    got = values(spark, fn.fingerprint(F.lit("s"), F.col("x"), F.lit(None).cast("string")), titles)
    assert got[0] != got[1] and got[2] == got[3] and got[4] == got[5]
    assert values(spark, fn.title_key(F.col("x")), ["  Ёлка-№5 ", None]) == ["елка No5", ""]  # lower case comes before the decomposition
    assert values(spark, fn.time_ago(F.col("x").cast("long")), [None, "-5", "59", "3600", "90000"]) == ["", "just now", "just now", "1h ago", "1d ago"]


COLUMNS = "source_id string, ordinal long, fingerprint string, upstream_id string, canonical_url string"


def first_come(batch, known, stones):
    seen = {(s, i, k) for s, _, *keys in known for i, k in enumerate(keys) if k is not None and s is not None}
    out = []
    for s, o, *keys in sorted(batch, key=lambda r: r[1]):
        mine = {(s, i, k) for i, k in enumerate(keys) if k is not None and s is not None}
        if not mine & seen and (s, keys[0]) not in stones:
            out.append(o)
            seen |= mine
    return out


def test_a_dropped_item_shadows_nothing(spark):
    none = spark.createDataFrame([], COLUMNS)
    stones = spark.createDataFrame([], "source_id string, fingerprint string, expires_at timestamp")
    batch = spark.createDataFrame([("s", 1, "a", "x", None), ("s", 2, "b", "x", None), ("s", 3, "b", "y", None)], COLUMNS)
    assert sorted(r.ordinal for r in store.new_items(batch, none, stones, datetime(2024, 1, 1)).collect()) == [1, 3]


def test_new_items_like_one_by_one(spark):
    rng, now = random.Random(6), datetime(2024, 1, 1)
    pick = lambda p, n: f"{p}{rng.randrange(n)}" if rng.random() < 0.8 else None
    rows = lambda n, start: [(rng.choice(["s", "s", "t", None]), start + i, pick("f", 60), pick("u", 50), pick("c", 40)) for i in range(n)]
    batch, known = rows(220, 0), rows(8, 1000)
    batch += [("chain", 500 + i, f"k{i}", f"k{i + 1}", f"k{i}") for i in range(6)] + [("chain", 600, None, None, None)]
    dead = [("s", "f1", now + timedelta(days=1)), ("s", "f2", now - timedelta(days=1)), ("t", None, now + timedelta(days=1))]
    got = store.new_items(*(spark.createDataFrame(x, COLUMNS) for x in (batch, known)), spark.createDataFrame(dead, "source_id string, fingerprint string, expires_at timestamp"), now)
    assert got.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    assert sorted(r.ordinal for r in got.collect()) == first_come(batch, known, {("s", "f1")})


def test_refresh_purge_and_upsert(spark):
    now, old = datetime(2024, 1, 2), datetime(2024, 1, 1)
    items = spark.createDataFrame([(1, "s", "a", None, None, "short", old), (2, "s", "b", "u", None, "a long summary", old), (3, "t", "a", None, None, None, old)], "item_id long, source_id string, fingerprint string, upstream_id string, canonical_url string, summary string, last_seen_at timestamp")
    repeats = spark.createDataFrame([("s", 1, "a", None, None, "longer one"), ("s", 2, "a", None, None, "longest of all"), ("s", 3, "zz", "u", None, "tiny"), ("x", 4, "a", None, None, "no")], "source_id string, ordinal long, fingerprint string, upstream_id string, canonical_url string, summary string")
    got = {r.item_id: (r.summary, r.last_seen_at) for r in store.refresh(items, repeats, now).collect()}
    assert got == {1: ("longest of all", now), 2: ("a long summary", now), 3: (None, old)}
    stones = spark.createDataFrame([("a", now), ("b", now + timedelta(1))], "fingerprint string, expires_at timestamp")
    assert [r.fingerprint for r in store.purge(stones, now).collect()] == ["b"]
    a, b = spark.createDataFrame([(1, 0, "x"), (2, 0, "y")], "k int, at int, v string"), spark.createDataFrame([(2, 1, "p"), (2, 3, "q"), (3, 2, "r")], "k int, at int, v string")
    assert sorted(map(tuple, store.upsert(a, b, "k", "at").collect())) == [(1, 0, "x"), (2, 3, "q"), (3, 2, "r")]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a "b"', 1.0, 2.0, "x"), (2, None, None, None, "y"), (3, "c", None, None, "z")], "id int, t string, lat double, lng double, country string")
    store.write_csv(rows.coalesce(1), ["id", "t"], f"{tmp_path}/csv")
    data = b"".join(f.read_bytes() for f in sorted((tmp_path / "csv").glob("part-*")))
    assert data == '﻿"id","t"\r\n"1","a ""b"""\r\n"2",""\r\n"3","c"\r\n'.encode()
    centres = spark.createDataFrame([("y", 5.0, 6.0)], "country string, country_lat double, country_lng double")
    assert sorted(r.feature for r in store.geojson_features(rows, ["id"], centres).collect()) == [
        '{"type":"Feature","geometry":{"type":"Point","coordinates":[2.0,1.0]},"properties":{"id":1}}', '{"type":"Feature","geometry":{"type":"Point","coordinates":[6.0,5.0]},"properties":{"id":2}}']
    assert store.geojson_features(rows, ["id"]).count() == 1


def test_phrases_overlap_and_share_beginnings(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "A a a ab. and the andthe and the ab"), (2, "the"), (3, None)], "id long, text string")
    lexicon = spark.createDataFrame([("g", "a a"), ("g", "and"), ("h", "and the"), ("h", "ab"), ("g", "the ab"), ("i", "the")], "group string, phrase string")
    want = {(1, "g", "a a"): 2, (1, "g", "and"): 2, (1, "h", "and the"): 2, (1, "h", "ab"): 2, (1, "g", "the ab"): 1, (1, "i", "the"): 2, (2, "i", "the"): 1}
    for limit in (100, 0):
        monkeypatch.setattr(phrases, "MAX_PATTERN_PHRASES", limit)
        assert {(r.id, r.group, r.phrase): r.hits for r in phrases.phrase_hits(texts, lexicon).collect()} == want


def test_relevance_sums_all_groups(spark):
    groups = spark.createDataFrame([("a", "one", 8, 0, False), ("b", "two", 8, 1, False), ("c", "one", 18, 2, True)], "group string, domain string, base int, place int, strong boolean")
    texts = [(1, False, False, None), (2, False, False, None), (3, True, False, None), (4, False, True, None), (5, False, False, "three"), (6, False, False, None), (7, False, False, None), (8, False, False, None)]
    hits = [(1, "a", "p"), (1, "b", "q"), (2, "a", "p"), (3, "a", "p"), (4, "b", "q"), (5, "a", "p"), (6, "a", "p"), (6, "negative", "n"), (7, "c", "r"), (7, "c", "s"), (7, "negative", "n"), *((8, "a", f"p{i}") for i in range(7))]
    got = phrases.relevance(spark.createDataFrame(texts, "id long, official boolean, aggregator boolean, context string"), spark.createDataFrame([(*h, 1) for h in hits], "id long, group string, phrase string, hits int"), groups)
    assert {r.id: (r.domain, r.score, r.accepted, r.rejected_by) for r in got.collect()} == {
        1: ("one", 26, True, None), 2: ("one", 8, False, "low_relevance"), 3: ("one", 23, False, "low_relevance"), 4: ("two", 28, True, None), 5: ("three", 36, True, None),
        6: (None, 0, False, "negative_noise"), 7: ("one", 16, False, "low_relevance"), 8: ("one", 17, False, "low_relevance"),
    }


def test_bodies_and_json_rows(spark):
    late = "<!-- " + "x" * 5000 + " --><rss><item><title>T</title><description>&#304;stanbul &#x2014; &amp;lt;</description></item><item><title>Subscribe now</title></item></rss>"
    page = "<!DOCTYPE html><p>about <rss> and <item><title>x</title></item></p>"
    kinds = {late: "rss", page: "html", "﻿ <feed>": "atom", "<rdf:RDF>": "rss", "<a/>": "xml", '{"a": 1}': "other", " ": "empty", None: "empty"}
    assert values(spark, feeds.body_kind(F.col("x")), kinds) == list(kinds.values())
    rows = spark.createDataFrame([("a", late), ("b", page)], "source_id string, body string")
    got = feeds.xml_items(rows).collect()
    assert [(r.source_id, r.title, r.summary, r.link) for r in got] == [("a", "T", "İstanbul — &lt;", None)] and feeds.xml_items(rows, notices=True).count() == 2
    body = '[{"name": "N", "web_url": "javascript:x", "publishedAt": "2024-01-02T03:04:05Z", "uuid": "u", "excerpt": "e"}, {"title": 5, "headline": "H", "external_url": "https://a.org/x", "date": "Tue, 02 Jan 2024 03:04:05 GMT"}, {"title": "D", "created_at": "never"}]'
    got = sorted(map(tuple, feeds.json_items(spark.createDataFrame([("j", body)], "source_id string, body string")).collect()))
    assert got == [("j", 0, "u", "N", None, "e", "2024-01-02T03:04:05.000Z"), ("j", 1, None, "H", "https://a.org/x", None, "2024-01-02T03:04:05.000Z"), ("j", 2, None, "D", None, None, None)]


def test_texts_are_normalised_in_pieces():
    import pyarrow as pa

    from tidewire.functions.text import AT_ONCE, compatible

    texts = ["ﬁ" * 300_000, None, "ｅ" * 300_000, "", "x" * 10] * 3
    out = list(compatible.func(iter([pa.array(texts), pa.array([], pa.string())])))
    assert pa.concat_arrays(out).to_pylist() == [x and x.replace("ﬁ", "fi").replace("ｅ", "e") for x in texts]
    assert len(out) > 3 and max(x.nbytes for x in out) < 2 * AT_ONCE

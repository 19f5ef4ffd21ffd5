from datetime import datetime

from pyspark.sql import functions as F

from tidewire.operators import registry


def test_drafts(spark):
    good = ("News", "rss", "cyber", "en", "europe", "https://a.org/feed")
    cases = {
        good: None, (" N ", *good[1:]): "invalid_name", ("x" * 121, *good[1:]): "invalid_name", ("News", "csv", *good[2:]): "invalid_connector_type", ("News", "rss", None, *good[3:]): "invalid_category", (*good[:3], "xx", *good[4:]): "invalid_language",
        (*good[:4], "mars", good[5]): "invalid_region", (*good[:5], "no url"): "invalid_url", (*good[:5], None): "invalid_url", (*good[:5], "http://a.org"): "https_required", (*good[:5], "https://u:p@a.org/"): "credentials_in_url_not_allowed",
        (*good[:5], " HTTPS://a.org/x@y "): None,
    }
    rows = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, a string, b string, c string, d string, e string, f string")
    got = {r.i: r.x for r in rows.select("i", registry.draft_error(*map(F.col, "abcdef")).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_manifest(spark):
    rows = [("a", "https://x", ["s"], 1, 2, 3, "normal", None), ("b", "http://x", [], 5, 2, 1, "quota_limited", None), ("b", None, None, 0, 2, 3, "quota_limited", 0), ("", "https://x", ["s"], 1, 2, 3, None, 5)]
    got = registry.manifest_errors(spark.createDataFrame(rows, "source_id string, endpoint string, screens array<string>, min_s int, base_s int, max_s int, mode string, daily_budget int"))
    assert sorted((r.source_id, r.error) for r in got.collect()) == sorted([
        ("b", "endpoint must use https"), ("b", "has no target screen"), ("b", "min interval exceeds base"), ("b", "base interval exceeds max"), ("b", "quota_limited source needs a dailyRequestBudget"),
        ("b", "missing endpoint"), ("b", "has no target screen"), ("b", "poll intervals must be positive"), ("b", "dailyRequestBudget must be positive"), ("b", "duplicate sourceId"), ("", "empty sourceId"),
    ])


def test_catalog_and_rules(spark):
    built, now = spark.createDataFrame([("a", "A"), ("p", "old")], "source_id string, name string"), datetime(2024, 1, 1)
    personal = spark.createDataFrame([("p", "P", True, None, now), ("q", "Q", False, None, now), ("r", "R", True, now, now)], "source_id string, name string, enabled boolean, deleted_at timestamp, created_at timestamp")
    assert sorted(map(tuple, registry.effective_catalog(built, personal).collect())) == [("a", "A"), ("p", "P")]
    assert [r.source_id for r in registry.personal_sources(personal).collect()] == ["p", "q"]
    rows = spark.createDataFrame([("a", "x", 1), ("b", "x", None), ("c", None, 9), ("d", None, 2)], "k string, v string, n int")
    assert [tuple(r) for r in registry.repeated(rows, ["v"], "u").collect()] == [("u", "x")]
    assert [r.key for r in registry.breaks(rows, "k", "b", F.col("n") < 5).collect()] == ["c"] and [r.key for r in registry.unlisted(rows, "k", "v", ["y"], "e").collect()] == ["a", "b"]
    asked, items = spark.createDataFrame([("u",), ("v",), ("w",)], "url string"), spark.createDataFrame([("u", None), (None, "v")], "a string, b string")
    assert sorted(r.url for r in registry.known_urls(asked, items, ["a", "b"]).collect()) == ["u", "v"]


def test_tags(spark):
    rows = spark.createDataFrame([(1, ["un vote", "cease-fire", "UN Vote", "nato", "eu", "x"]), (2, [])], "i int, t array<string>")
    assert {r.i: r.x for r in rows.select("i", registry.tags(F.col("t"), F.lit("Trade")).alias("x")).collect()} == {1: ["UN Vote", "Cease Fire", "Nato", "EU"], 2: ["Trade"]}

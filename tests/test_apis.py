import json

from tidewire.sources import apis


def items(spark, api, answer, names=("Mali", "Guinea", "Papua New Guinea", "France")):
    rows = spark.createDataFrame([("s", json.dumps(answer)), ("x", "junk"), ("y", None), ("z", '{"articles": 5}')], "source_id string, body string")
    return sorted(apis.api_items(rows, api, list(names)).collect(), key=lambda r: r.ordinal)


def test_first_of_repeated_addresses_and_compact_times(spark):
    got = items(spark, "gdelt", {"articles": [{"url": "u", "title": " A in Mali ", "seendate": "20240102T030405Z", "domain": "d.org"}, {"url": "u", "title": "B"}, {"url": "v"}, {"title": "C"}, {"url": "w", "title": "D", "seendate": "2024"}]})
    assert [(r.url, r.title, r.published, r.publisher, r.countries) for r in got] == [("u", "A in Mali", "2024-01-02T03:04:05.000Z", "d.org", []), ("w", "D", None, None, [])]


def test_layouts(spark):
    (a,) = items(spark, "currents", {"news": [{"id": "1", "title": "T", "url": "u", "description": "<b>Papua New Guinea</b> &amp; mali", "published": "2024-01-02 03:04:05 +0000"}]})
    assert (a.upstream_id, a.summary, a.countries, a.publisher) == ("1", "Papua New Guinea & mali", ["Papua New Guinea", "Guinea", "Mali"], "Currents API")
    (b,) = items(spark, "worldnews", {"news": [{"id": 77, "title": "T", "url": "u", "text": "", "summary": "short"}]})
    assert (b.upstream_id, b.summary) == ("77", "short")
    (c,) = items(spark, "freenews", {"data": [{"uuid": "q", "title": "T", "subtitle": "s", "publisher": "P"}]})
    assert (c.url, c.publisher) == ("https://www.freenewsapi.io/article/q", "P")
    (d,) = items(spark, "finlight", {"articles": [{"link": "l", "title": "Guinea", "summary": "x", "sentiment": "negative", "countries": ["FRANCE", "Nowhere"], "source": "S"}]})
    assert (d.summary, d.countries) == ("[Sentiment: negative] x", ["France", "Guinea"])
    (e,) = items(spark, "reliefweb", {"data": [{"id": "5", "fields": {"title": "T", "url_alias": "a", "body-html": "<p>b</p>", "date": {"created": "2024-01-02T03:04:05+00:00"}}}]})
    assert (e.url, e.summary, e.published) == ("a", "b", "2024-01-02T03:04:05.000Z")
    (f,) = items(spark, "newsdata", {"results": [{"article_id": "i", "title": "T", "link": "l", "pubDate": "2024-01-02 03:04:05", "source_name": "N"}]})
    assert (f.upstream_id, f.publisher, f.published) == ("i", "N", "2024-01-02T03:04:05.000Z")

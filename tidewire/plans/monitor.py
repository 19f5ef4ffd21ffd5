"""Rollup queries over the driver's tables, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import rollups
from tidewire.plans.news import EVENTS_SQL, as_of, events, query, table, text_of

TOPICS = ["MACHINERY", "TRADE", "BUILDING", "AUTOMOBILE", "FURNITURE", "HOUSEHOLD", "HEALTH"]


@query("segment_momentum", f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY item_id) AS p, count(*) OVER () AS total FROM e),
s AS (SELECT DISTINCT item_id, p <= total // 2 AS early, total, unnest([primary_domain, region]) AS segment FROM r),
c AS (SELECT segment, count(*) AS n, count(*) FILTER (early) AS f, any_value(total) AS t FROM s WHERE segment IS NOT NULL GROUP BY segment)
SELECT segment, n, floor((f / (t // 2) - (n - f) / (t - t // 2)) * 1000 + 0.5) / 10 AS change, row_number() OVER (ORDER BY n DESC, segment) AS rank FROM c""")  # fmt: skip
def segment_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.momentum(events(spark, sf_dir).select(F.col("item_id").alias("ordinal"), F.array("primary_domain", "region").alias("segments")))


@query("supply_pressure", """WITH c AS (SELECT o_custkey AS commodity, count(*) AS mentions, count(*) FILTER (o_orderpriority = '1-URGENT') AS stressed FROM orders GROUP BY o_custkey),
s AS (SELECT *, least(100, greatest(12, 7 * mentions + 11 * stressed)) AS score FROM c)
SELECT *, CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 55 THEN 'High' WHEN score >= 35 THEN 'Elevated' ELSE 'Moderate' END AS status FROM s""")  # fmt: skip
def supply_pressure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.pressure(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("commodity"), (F.col("o_orderpriority") == "1-URGENT").alias("stressed")))


@query("topic_metrics", f"""WITH t AS (SELECT unnest({TOPICS}) AS topic, unnest(range({len(TOPICS)})) AS place), c AS (SELECT topic, place, count(c_custkey) AS n FROM t LEFT JOIN customer ON c_mktsegment = topic GROUP BY ALL)
SELECT topic, n, round(n / greatest(1, sum(n) OVER ()), 6) AS share, row_number() OVER (ORDER BY n DESC, place) AS rank FROM c""")  # fmt: skip
def topic_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.topic_metrics(table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("topic")), TOPICS)


@query("region_metrics", """WITH c AS (SELECT n_name AS region, count(*) AS n, count(DISTINCT c_mktsegment) AS n_countries FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name ORDER BY n DESC, region LIMIT 6)
SELECT *, CAST(floor(n / max(n) OVER () * 100 + 0.5) AS BIGINT) AS pct FROM c""")  # fmt: skip
def region_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return rollups.region_metrics(c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("region"), F.col("c_mktsegment").alias("country")))


@query("consolidated_markers", f"""WITH {EVENTS_SQL}, m AS (SELECT label, primary_domain AS category, lat + length(primary_domain) AS lat, lng, count(*) AS reports FROM e WHERE lat IS NOT NULL GROUP BY ALL)
SELECT label, CAST(sum(reports) AS BIGINT) AS reports, round(sum(lat * reports) / sum(reports), 6) AS lat, round(sum(lng * reports) / sum(reports), 6) AS lng, count(DISTINCT category) AS n_categories,
(['low', 'medium', 'high'])[max(CASE WHEN reports >= 60 THEN 3 WHEN reports >= 45 THEN 2 ELSE 1 END)] AS level FROM m GROUP BY label""")  # fmt: skip
def consolidated_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).where("lat IS NOT NULL").withColumn("lat", F.col("lat") + F.length("primary_domain"))
    counts = e.groupBy("label", F.col("primary_domain").alias("category"), "lat", "lng").agg(F.count("*").alias("reports"))
    return rollups.consolidate(counts.withColumn("level", F.when(F.col("reports") >= 60, "high").when(F.col("reports") >= 45, "medium").otherwise("low")), ["low", "medium", "high"])


@query("globe_points", f"""WITH {EVENTS_SQL}, m AS (SELECT max(published_at) AS t FROM e)
SELECT label, count(*) AS n, count(DISTINCT source_id) AS n_sources, first(item_id ORDER BY priority_score DESC, item_id) AS lead, max(priority_score) AS score, strftime(max(published_at), '%Y-%m-%d %H:%M:%S.%f') AS newest
FROM e, m WHERE published_at >= t - to_hours(24) AND lat IS NOT NULL GROUP BY label""")  # fmt: skip
def globe_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return rollups.globe_points(e, as_of(e)).withColumn("newest", text_of("newest"))


@query("view_alerts", """WITH v AS (SELECT * FROM (VALUES (1, 'en', NULL, 'the'), (2, NULL, NULL, 'license'), (3, 'fr', NULL, NULL)) AS x(view_id, layer, src, q))
SELECT view_id, doc_id AS entry_id FROM documents, v WHERE (v.layer IS NULL OR lang = v.layer) AND lang IS NOT NULL AND (q IS NULL OR contains(lower(coalesce(text, '')), q)) AND NOT (view_id = 1 AND doc_id % 2 = 0)""")  # fmt: skip
def view_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    entries = docs.select(F.col("doc_id").alias("entry_id"), F.col("lang").alias("layer"), "source", "text")
    views = spark.createDataFrame([(1, "en", None, "the"), (2, None, None, "license"), (3, "fr", None, None)], "view_id int, layer string, source string, query string")
    return rollups.view_alerts(entries, views, docs.where("doc_id % 2 = 0").select(F.lit(1).alias("view_id"), F.col("doc_id").alias("entry_id")))


@query("ring_layout", """WITH p AS (SELECT n_nationkey AS place, n_name AS name, count(*) OVER () AS total FROM nation),
a AS (SELECT *, place % 2 = 0 AS o, CASE WHEN place % 2 = 0 THEN total - total // 2 ELSE total // 2 END AS size FROM p),
b AS (SELECT *, -pi() / 2 + CASE WHEN o THEN 0 ELSE pi() / size END + (place // 2) * 2 * pi() / size AS angle FROM a)
SELECT place, name, round(50 + cos(angle) * CASE WHEN o THEN 39 ELSE 25.5 END, 4) AS x, round(50 + sin(angle) * CASE WHEN o THEN 39 ELSE 26.5 END, 4) AS y FROM b""")  # fmt: skip
def ring_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.ring_layout(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place"), F.col("n_name").alias("name")))


@query("feed_state", f"""WITH {EVENTS_SQL}, m AS (SELECT max(published_at) AS t FROM e), p AS (SELECT source_id, max(published_at) AS g FROM e GROUP BY source_id),
a AS (SELECT source_id, CASE WHEN length(source_id) = 2 THEN 'previous' ELSE 'current' END AS slot, greatest(0, CAST(floor((epoch_us(t) - epoch_us(g)) / 1e6 + 0.5) AS BIGINT)) AS age_seconds FROM p, m)
SELECT *, CASE WHEN slot = 'previous' OR age_seconds > 1800 THEN 'stale' ELSE 'ready' END AS state FROM a""")  # fmt: skip
def feed_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    newest = e.groupBy("source_id").agg(F.max("published_at").alias("generated_at"))
    slots = newest.select("source_id", "generated_at", F.when(F.length("source_id") == 2, "previous").otherwise("current").alias("slot"), F.lit("ready").alias("state"))
    return rollups.feed_state(slots, as_of(e)).drop("generated_at")

"""Queries of runs, sources, payloads, monitor entries, cyber rollups and boundaries over the driver's tables, each with its SQL."""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import desk, health, registry
from tidewire.operators.stories import stories as clusters
from tidewire.operators.stories import story_cards
from tidewire.plans.news import EVENTS_SQL, QUERIES, as_of, events, query, table, text_of

STAMP = "strftime({x}, '%Y-%m-%d %H:%M:%S.%f')"

RUNS_SQL = """runs AS (SELECT l_orderkey AS run_id, count(*) AS attempted, count(*) FILTER (l_returnflag <> 'R') AS succeeded, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS new_items,
CAST(sum(CAST(l_linenumber AS BIGINT)) AS BIGINT) AS duplicates, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS duration_ms FROM lineitem GROUP BY l_orderkey),
rs AS (SELECT *, CASE WHEN succeeded = attempted THEN 'success' WHEN succeeded > 0 THEN 'partial' ELSE 'failed' END AS status FROM runs)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as the sources of an order's run."""
    results = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), (F.col("l_returnflag") != "R").alias("ok"), F.col("l_quantity").cast("long").alias("new_items"), F.col("l_linenumber").cast("long").alias("duplicates"),
        F.floor("l_extendedprice").cast("long").alias("duration_ms"))
    return health.run_results(results)


@query("run_results", f"WITH {RUNS_SQL} SELECT * FROM rs")
def run_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _runs(spark, sf_dir)


@query("run_totals", f"""WITH {RUNS_SQL} SELECT count(*) AS runs, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed,
CAST(sum(new_items) AS BIGINT) AS new_items, min(duration_ms) AS shortest_ms, max(duration_ms) AS longest_ms FROM rs WHERE attempted > 0""")
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.run_totals(_runs(spark, sf_dir))


@query("latency", """SELECT l_shipmode AS mode, count(*) AS n, CAST(floor(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(CAST(l_extendedprice AS DOUBLE), 0.95) + 0.5) AS BIGINT) AS p95,
CAST(floor(max(CAST(l_extendedprice AS DOUBLE)) + 0.5) AS BIGINT) AS longest FROM (SELECT *, l_orderkey % 7 AS l_shipmode FROM lineitem) GROUP BY l_shipmode""")
def latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") % 7).alias("mode"), F.col("l_extendedprice").cast("double").alias("ms"))
    return health.latency(samples, "mode")


#: Orders as the poll states of sources, and their latest date as now.
STATE_SQL = """st AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'personal-' ELSE 's' END || o_orderkey AS source_id, o_orderkey AS k, o_custkey % 4 <> 0 AS enabled, o_orderdate AS next_poll_at,
CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days(CAST(o_custkey % 90 AS INTEGER)) END AS backoff_until, CASE WHEN o_orderkey % 6 <> 1 THEN o_orderdate END AS last_success_at, CAST(86400 * (o_custkey % 400) AS BIGINT) AS interval_s FROM orders),
nw AS (SELECT max(o_orderdate) AS t FROM orders)"""


def _state(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, datetime]:
    o = table(spark, sf_dir, "orders")
    at = F.col("o_orderdate")
    rows = o.select(
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "personal-").otherwise("s"), F.col("o_orderkey")).alias("source_id"), F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4 != 0).alias("enabled"), at.alias("next_poll_at"),
        F.when(F.col("o_orderkey") % 3 == 0, at + F.make_dt_interval((F.col("o_custkey") % 90).cast("int"))).alias("backoff_until"), F.when(F.col("o_orderkey") % 6 != 1, at).alias("last_success_at"),
        (86400 * (F.col("o_custkey") % 400)).cast("long").alias("interval_s"))
    return rows, o.agg(F.max("o_orderdate").alias("t")).first().t or datetime(1970, 1, 1)


@query("due_sources", f"""WITH {STATE_SQL} SELECT source_id, {STAMP.format(x="next_poll_at")} AS next_poll_at FROM st, nw WHERE enabled AND next_poll_at <= t AND (backoff_until IS NULL OR backoff_until <= t) ORDER BY st.next_poll_at, source_id LIMIT 40""")
def due_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _state(spark, sf_dir)
    return health.due_sources(state, now).select("source_id", text_of("next_poll_at").alias("next_poll_at"))


@query("due_by_host", f"""WITH {STATE_SQL}, e AS (SELECT 's' || page_id AS source_id, CASE WHEN page_id % 9 = 0 THEN 'not a url' ELSE url END AS endpoint FROM pages)
SELECT coalesce(lower(nullif(regexp_extract(coalesce(endpoint, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1), '')), 'unknown') AS host, count(*) AS n, min(st.source_id) AS first_source
FROM st LEFT JOIN e USING (source_id), nw WHERE enabled AND next_poll_at <= t AND (backoff_until IS NULL OR backoff_until <= t) GROUP BY 1""")
def due_by_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _state(spark, sf_dir)
    pages = table(spark, sf_dir, "pages").select(F.concat(F.lit("s"), F.col("page_id")).alias("source_id"), F.when(F.col("page_id") % 9 == 0, "not a url").otherwise(F.col("url")).alias("endpoint"))
    return health.due_by_host(health.due_sources(state, now, most=2**31 - 1), pages)


@query("payload_coverage", f"""WITH {STATE_SQL}, ex AS (SELECT 's' || l_orderkey AS source_id FROM lineitem UNION SELECT 'personal-' || l_orderkey FROM lineitem WHERE l_orderkey % 5 = 0), it AS (SELECT DISTINCT 's' || o_custkey AS source_id FROM orders),
k AS (SELECT source_id, coalesce(epoch_us(t) - epoch_us(last_success_at) < 2000000 * interval_s, false) AS fresh, it.source_id IS NOT NULL AS filled FROM st LEFT JOIN it USING (source_id), nw WHERE enabled AND source_id IN (SELECT source_id FROM ex)),
c AS (SELECT (SELECT count(DISTINCT source_id) FROM ex) AS expected, count(*) AS enabled, count(*) FILTER (fresh) AS fresh, count(*) FILTER (filled) AS filled, bool_or(source_id = 's1' AND NOT fresh) AS a, bool_or(source_id = 's2' AND NOT fresh) AS b FROM k),
r AS (SELECT *, concat_ws(',', CASE WHEN enabled < expected THEN 'enabled_' || enabled || '_of_' || expected END, CASE WHEN a THEN 'critical_overdue_s1' END, CASE WHEN b THEN 'critical_overdue_s2' END, CASE WHEN enabled > 0 AND fresh / enabled < 0.8 THEN 'fresh_sources_below_80pct' END) AS reasons FROM c)
SELECT expected, enabled, fresh, filled, CASE WHEN reasons = '' THEN 'fresh' ELSE 'partial' END AS state, reasons FROM r""")
def payload_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _state(spark, sf_dir)
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    expected = lines.select(F.concat(F.lit("s"), F.col("l_orderkey")).alias("source_id")).union(lines.where("l_orderkey % 5 = 0").select(F.concat(F.lit("personal-"), F.col("l_orderkey"))))
    items = orders.select(F.concat(F.lit("s"), F.col("o_custkey")).alias("source_id"))
    return health.coverage(state, expected, items, now, ["s1", "s2"]).withColumn("reasons", F.array_join("reasons", ","))


@query("toggled_sources", f"WITH {STATE_SQL} SELECT source_id, CASE WHEN starts_with(source_id, 'personal-') THEN source_id IN (SELECT 'personal-' || c_custkey FROM customer) ELSE enabled END AS enabled FROM st")
def toggled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = _state(spark, sf_dir)
    listed = table(spark, sf_dir, "customer").select(F.concat(F.lit("personal-"), F.col("c_custkey")).alias("source_id"))
    return health.toggle_personal(state, listed).select("source_id", "enabled")


@query("bootstrap_state", f"WITH {STATE_SQL} SELECT 's' || p_partkey AS source_id, CAST(p_size AS BIGINT) AS interval_s FROM part WHERE NOT EXISTS (SELECT 1 FROM st WHERE st.source_id = 's' || p_partkey)")
def bootstrap_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, now = _state(spark, sf_dir)
    profiles = table(spark, sf_dir, "part").select(F.concat(F.lit("s"), F.col("p_partkey")).alias("source_id"), F.col("p_size").cast("long").alias("base_s"))
    return health.bootstrap(state, profiles, now).select("source_id", "interval_s")


SLOTS_SQL = """sl AS (SELECT 'p' || s_suppkey AS payload_type, CASE WHEN k = 0 THEN 'current' ELSE 'previous' END AS slot, s_suppkey * 10 + k AS body FROM supplier, (SELECT unnest([0, 1]) AS k) WHERE s_suppkey % 4 <> k * 3 - 1),
pn AS (SELECT 'p' || c_custkey AS payload_type, c_custkey * 1000 AS body FROM customer WHERE c_custkey % 3 = 0),
sw AS (SELECT payload_type, slot, body FROM sl WHERE payload_type NOT IN (SELECT payload_type FROM pn) UNION ALL SELECT payload_type, 'previous', body FROM sl WHERE slot = 'current' AND payload_type IN (SELECT payload_type FROM pn) UNION ALL SELECT payload_type, 'current', body FROM pn)"""


def _swapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    sup, cust = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    k = F.col("k")
    slots = sup.select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k")).where(F.col("s_suppkey") % 4 != k * 3 - 1)
    slots = slots.select(F.concat(F.lit("p"), F.col("s_suppkey")).alias("payload_type"), F.when(k == 0, "current").otherwise("previous").alias("slot"), (F.col("s_suppkey") * 10 + k).alias("body"))
    new = cust.where("c_custkey % 3 = 0").select(F.concat(F.lit("p"), F.col("c_custkey")).alias("payload_type"), (F.col("c_custkey") * 1000).alias("body"))
    return health.swap_slots(slots, new)


@query("slot_swap", f"WITH {SLOTS_SQL} SELECT * FROM sw")
def slot_swap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _swapped(spark, sf_dir)


@query("served_payloads", f"WITH {SLOTS_SQL} SELECT payload_type, first(slot ORDER BY slot) AS slot, first(body ORDER BY slot) AS body FROM sw GROUP BY payload_type")
def served_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.served(_swapped(spark, sf_dir))


#: Orders as one poll each: state, profile and outcome by remainders of the key.
POLL = {
    "interval_s": "o_custkey % 5000 + 60", "streak": "o_orderkey % 5", "failures": "o_orderkey % 8", "observed_s": "CASE WHEN o_orderkey % 3 = 0 THEN o_custkey % 9000 + 1 END", "ttl_s": "CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 3000 END",
    "max_age_s": "CASE WHEN o_orderkey % 7 = 0 THEN o_custkey % 2000 END", "min_s": "CAST(300 AS BIGINT)", "max_s": "CAST(4000 AS BIGINT)", "daily_budget": "CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 300 + 1 END", "ok": "o_orderkey % 9 <> 0",
    "new_items": "CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 6 ELSE 0 END", "parsed_items": "CAST(6 AS BIGINT)", "rate_limited": "o_orderkey % 18 = 0", "retry_after_s": "CASE WHEN o_orderkey % 36 = 0 THEN CAST(50000 AS BIGINT) END", "chance": "CAST(o_custkey % 64 AS DOUBLE) / 64",
}


@query("next_poll", f"""WITH p AS (SELECT o_orderkey AS source_id, {", ".join(f"{v} AS {k}" for k, v in POLL.items())} FROM orders),
a AS (SELECT *, least(max_s, greatest(min_s, interval_s)) AS start, CASE WHEN NOT ok THEN streak WHEN new_items > 0 THEN 0 ELSE streak + 1 END AS streak2, CASE WHEN ok THEN 0 ELSE failures + 1 END AS failures2 FROM p),
b AS (SELECT *, CASE WHEN new_items > 0 THEN least(max_s, greatest(min_s, CAST(floor(start * CAST(CASE WHEN new_items / parsed_items >= 0.5 THEN 0.7 ELSE 0.85 END AS DOUBLE) + 0.5) AS BIGINT)))
  WHEN streak2 >= 3 THEN least(max_s, greatest(min_s, CAST(floor(start * CAST(1.5 AS DOUBLE) + 0.5) AS BIGINT))) ELSE start END AS moved FROM a),
c AS (SELECT *, CASE WHEN observed_s > 0 THEN CAST(floor((moved + least(max_s, greatest(min_s, CAST(floor(observed_s / 2 + 0.5) AS BIGINT)))) / 2 + 0.5) AS BIGINT) ELSE moved END AS pulled,
  greatest(CASE WHEN ttl_s > 0 THEN ttl_s END, CASE WHEN max_age_s > 0 THEN max_age_s END) AS hint, CAST(ceil(86400 / (daily_budget * CAST(0.8 AS DOUBLE))) AS BIGINT) AS quota FROM b),
d AS (SELECT *, CASE WHEN pulled < hint THEN least(max_s, greatest(min_s, hint)) ELSE pulled END AS held FROM c),
e AS (SELECT *, CASE WHEN held < quota THEN least(greatest(max_s, quota), greatest(min_s, quota)) ELSE held END AS final, least(21600, greatest(start, min_s) * pow(2, least(failures2, 6))) AS wait FROM d)
SELECT source_id, CAST(CASE WHEN ok THEN final ELSE start END AS BIGINT) AS interval_s,
  greatest(1, CAST(floor((CASE WHEN ok THEN final WHEN rate_limited AND retry_after_s > 0 THEN greatest(wait, retry_after_s) ELSE wait END) * (1 + (chance * 2 - 1) * CAST(0.1 AS DOUBLE)) + 0.5) AS BIGINT)) AS delay_s,
  CASE WHEN NOT ok THEN 'backoff' WHEN held < quota THEN 'quota' WHEN pulled < hint THEN 'rss_hint' ELSE 'observed_cadence' END AS reason, CAST(streak2 AS BIGINT) AS streak, CAST(failures2 AS BIGINT) AS failures FROM e""")  # fmt: skip
def next_poll(spark: SparkSession, sf_dir: str) -> DataFrame:
    polls = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("source_id"), *(F.expr(v).alias(k) for k, v in POLL.items()))
    return health.next_poll(polls).select("source_id", "interval_s", "delay_s", "reason", "streak", "failures")


@query("map_clusters", """WITH m AS (SELECT CAST(c_custkey % 150 AS DOUBLE) - 75 AS lat, CAST(c_custkey % 360 AS DOUBLE) - 180 AS lng, c_custkey % 7 + 1 AS reports FROM customer)
SELECT CAST(floor((lng + 180) / 360 * 4096 / 54) AS BIGINT) AS cell_x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096 / 54) AS BIGINT) AS cell_y, count(*) AS n, CAST(sum(reports) AS BIGINT) AS reports FROM m GROUP BY 1, 2""")
def map_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    markers = table(spark, sf_dir, "customer").select(((k % 150).cast("double") - 75).alias("lat"), ((k % 360).cast("double") - 180).alias("lng"), (k % 7 + 1).alias("reports"))
    return health.map_clusters(markers, 3)


@query("top_markers", "SELECT s_suppkey AS place, s_acctbal AS score FROM supplier ORDER BY s_acctbal DESC NULLS LAST, s_suppkey LIMIT 120")
def top_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.top_markers(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("place"), F.col("s_acctbal").alias("score")))


@query("level_rollup", "SELECT CAST(p_size % 5 AS BIGINT) AS level, count(*) AS n, count(DISTINCT p_partkey % 40) AS countries FROM part GROUP BY 1")
def level_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return health.level_rollup(table(spark, sf_dir, "part").select((F.col("p_size") % 5).cast("long").alias("level"), (F.col("p_partkey") % 40).alias("country")))


@query("first_pages", "SELECT min(page_id) AS page_id, regexp_extract(url, '^(https?://[^/]+/[^/]?)', 1) AS url FROM pages GROUP BY 2")
def first_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^(https?://[^/]+/[^/]?)", 1).alias("url"))
    return health.first_rows(pages, "url", "page_id")


@query("seen_entries", f"""WITH {EVENTS_SQL}, s AS (SELECT primary_domain AS view_id, item_id // 3 AS entry_id, epoch_us(published_at) AS t FROM e), d AS (SELECT view_id, entry_id, max(t) AS t FROM s GROUP BY view_id, entry_id),
r AS (SELECT *, row_number() OVER (PARTITION BY view_id ORDER BY t DESC, entry_id DESC) AS rank FROM d) SELECT view_id, entry_id, t AS "at" FROM r WHERE rank <= 600""")
def seen_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select(F.col("primary_domain").alias("view_id"), F.floor(F.col("item_id") / 3).alias("entry_id"), F.unix_micros(F.col("published_at").cast("timestamp")).alias("at"), "item_id")
    return health.seen_ids(rows.where("item_id % 2 = 0").drop("item_id"), rows.where("item_id % 2 = 1").drop("item_id"))


@query("fresh_enough", f"WITH {EVENTS_SQL}, m AS (SELECT max(published_at) AS t FROM e) SELECT item_id FROM e, m WHERE coalesce(epoch_us(t) - epoch_us(published_at) < 172800000000, true)")
def fresh_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return desk.fresh_enough(e.withColumn("collected_at", F.lit(as_of(e)))).select("item_id")


ENTRIES_SQL = """en AS (SELECT doc_id AS entry_id, coalesce(lang, 'none') AS layer, coalesce(source, '') AS source, list_value('c' || (doc_id % 5), 'c' || (doc_id % 7)) AS countries, substr(coalesce(text, ''), 1, 90) AS title, substr(coalesce(text, ''), 91) AS summary,
CASE WHEN doc_id % 3 = 0 THEN 'calm' END AS tone, CASE WHEN doc_id % 11 <> 0 THEN TIMESTAMP '2024-01-01' + to_hours(CAST(doc_id % 200 AS INTEGER)) END AS published_at, CASE WHEN doc_id % 4 = 0 THEN doc_id % 9 END AS reports FROM documents)"""


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as entries, whose titles are the first 90 characters of the text and whose summaries the rest."""
    d, text = F.col("doc_id"), F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select(
        d.alias("entry_id"), F.coalesce("lang", F.lit("none")).alias("layer"), F.coalesce("source", F.lit("")).alias("source"), F.array(F.concat(F.lit("c"), d % 5), F.concat(F.lit("c"), d % 7)).alias("countries"),
        F.substring(text, 1, 90).alias("title"), F.substring(text, F.lit(91), F.length(text)).alias("summary"), F.when(d % 3 == 0, "calm").alias("tone"),
        F.when(d % 11 != 0, F.lit(datetime(2024, 1, 1)) + F.make_dt_interval(F.lit(0), (d % 200).cast("int"))).alias("published_at"), F.when(d % 4 == 0, d % 9).alias("reports"))


VIEWS = ((1, ["de", "en", "fr"], None, "c3", "the", 48), (2, ["es", "none"], "src1", None, "", None), (3, ["en"], None, None, "CALM", 72), (4, [], None, None, None, None), (5, ["de", "fr", "es"], "src2", "c1", None, None))
VIEWS_SQL = "vw AS (SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else (str(x) if isinstance(x, (int, list)) else f"'{x}'") for x in v) + ")" for v in VIEWS if v[1]) + ") AS t(view_id, layers, v_source, v_country, v_query, v_hours))"


@query("saved_views", f"""WITH {ENTRIES_SQL}, {VIEWS_SQL} SELECT CAST(view_id AS BIGINT) AS view_id, entry_id FROM en JOIN vw ON list_contains(layers, layer) WHERE (coalesce(v_source, '') = '' OR source = v_source) AND (v_country IS NULL OR list_contains(countries, v_country))
AND contains(lower(title || ' ' || summary || ' ' || source || ' ' || coalesce(tone, '')), lower(trim(coalesce(v_query, '')))) AND (v_hours IS NULL OR coalesce(published_at >= TIMESTAMP '2024-01-08' - to_hours(v_hours), false))""")
def saved_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    views = spark.createDataFrame(list(VIEWS), "view_id long, layers array<string>, source string, country string, query string, hours int")
    return desk.matches_view(_entries(spark, sf_dir), views, datetime(2024, 1, 8))


@query("report_search", f"WITH {ENTRIES_SQL} SELECT entry_id FROM en WHERE contains(lower(title || ' ' || summary || ' ' || source), 'and the') AND published_at >= TIMESTAMP '2024-01-03'")
def report_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = desk.within_window(_entries(spark, sf_dir), ["published_at"], datetime(2024, 1, 8), 120)
    return recent.where(desk.contains_query(F.lit(" And the"), "title", "summary", "source")).select("entry_id")


@query("country_stats", f"""WITH {ENTRIES_SQL}, x AS (SELECT unnest(countries) AS country, layer, coalesce(reports, 1) AS n FROM en) SELECT country, CAST(sum(n) AS BIGINT) AS reports, CAST(coalesce(sum(n) FILTER (layer = 'de'), 0) AS BIGINT) AS de, CAST(coalesce(sum(n) FILTER (layer = 'en'), 0) AS BIGINT) AS en FROM x GROUP BY country""")
def country_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.country_stats(_entries(spark, sf_dir), ["de", "en"])


@query("visible_markers", f"""WITH {ENTRIES_SQL}, x AS (SELECT unnest(countries) AS country, coalesce(reports, 1) AS n FROM en WHERE layer = 'en'), s AS (SELECT country, CAST(sum(n) AS BIGINT) AS reports FROM x GROUP BY country)
SELECT s_suppkey AS marker_id, reports FROM supplier JOIN s ON 'c' || (s_suppkey % 9) = country""")
def visible_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    markers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("marker_id"), F.concat(F.lit(" C"), F.col("s_suppkey") % 9).alias("label"))
    return desk.visible_markers(markers, desk.country_stats(_entries(spark, sf_dir).where("layer = 'en'"), [])).select("marker_id", "reports")


@query("export_rows", f"""WITH {ENTRIES_SQL} SELECT entry_id, title, summary, source, '' AS url, coalesce(strftime(published_at, '%Y-%m-%d %H:%M:%S'), '') AS published_at, layer, coalesce(tone, '') AS tone, array_to_string(countries, ' | ') AS countries,
CAST(coalesce(reports, 1) AS BIGINT) AS reports, CAST(1 AS BIGINT) AS sources, source AS source_names FROM en""")
def export_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = {"url": F.lit(None).cast("string"), "sources": F.lit(None).cast("long"), "source_names": F.array().cast("array<string>")}
    return desk.export_rows(_entries(spark, sf_dir).withColumns(more))


@query("source_activity", f"""WITH {EVENTS_SQL}, a AS (SELECT source_id, count(*) AS accepted, array_to_string(list_sort(list(DISTINCT primary_domain)), ',') AS domains FROM e WHERE accepted GROUP BY source_id),
m AS (SELECT source_id, count(DISTINCT label) AS markers FROM e WHERE lat IS NOT NULL GROUP BY source_id)
SELECT source_id, coalesce(a.accepted, 0) AS accepted, coalesce(markers, 0) AS markers, coalesce(domains, '') AS domains FROM a FULL JOIN m USING (source_id)""")
def source_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    out = desk.source_activity(e.where("accepted").select("source_id", F.col("primary_domain").alias("domain")), e.where("lat IS NOT NULL").select(F.col("label").alias("marker_id"), "source_id"))
    return out.withColumn("domains", F.array_join("domains", ","))


SOURCES_SQL = """so AS (SELECT s_suppkey AS source_id, s_name AS name, 'type ' || (s_suppkey % 3) AS type, 'm' || (s_suppkey % 4) AS method, 'k' || (s_suppkey % 2) AS config, CASE WHEN s_suppkey % 5 <> 0 THEN 'r' || (s_suppkey % 6) END AS region,
list_value('d' || (s_suppkey % 8)) AS domains, (['ok', 'warn', 'error', 'idle'])[CAST(s_suppkey % 4 + 1 AS BIGINT)] AS runtime, CASE WHEN s_suppkey % 9 = 0 THEN 'personal' ELSE 'built_in' END AS origin, s_suppkey % 50 AS items, s_suppkey % 13 AS accepted, s_suppkey % 3 AS markers, CASE WHEN s_suppkey % 10 <> 0 THEN s_suppkey % 600 END AS last_check_mins FROM supplier)"""


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        k.alias("source_id"), F.col("s_name").alias("name"), F.concat(F.lit("type "), k % 3).alias("type"), F.concat(F.lit("m"), k % 4).alias("method"), F.concat(F.lit("k"), k % 2).alias("config"), F.when(k % 5 != 0, F.concat(F.lit("r"), k % 6)).alias("region"),
        F.array(F.concat(F.lit("d"), k % 8)).alias("domains"), F.element_at(F.array(*map(F.lit, ("ok", "warn", "error", "idle"))), (k % 4 + 1).cast("int")).alias("runtime"), F.when(k % 9 == 0, "personal").otherwise("built_in").alias("origin"),
        (k % 50).alias("items"), (k % 13).alias("accepted"), (k % 3).alias("markers"), F.when(k % 10 != 0, k % 600).alias("last_check_mins"))


@query("source_kpis", f"WITH {SOURCES_SQL} SELECT count(*) AS total, count(*) FILTER (runtime = 'ok') AS ok, count(*) FILTER (runtime = 'warn') AS warn, count(*) FILTER (runtime = 'error') AS errors, count(*) FILTER (region IS NULL) AS without_region, min(last_check_mins) AS last_sweep FROM so WHERE method = 'm1' OR method = 'm2'")
def source_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return desk.source_kpis(desk.source_table(_sources(spark, sf_dir), methods=("m1", "m2")))


@query("source_table", f"""WITH {SOURCES_SQL} SELECT source_id, name, runtime, CASE WHEN runtime = 'error' THEN 'Needs review' WHEN items = 0 THEN 'Unrated' WHEN accepted = 0 THEN 'Low yield' WHEN runtime = 'ok' AND accepted / items >= 0.25 AND markers > 0 THEN 'Strong now' ELSE 'Usable now' END AS quality
FROM so WHERE region IS NULL AND config = 'k1' AND (contains(lower(name), '1') OR contains(type, '1') OR contains(method, '1') OR contains(domains[1], '1'))""")
def source_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = desk.source_table(_sources(spark, sf_dir), "needsLocation", configs=("k1",), query=" 1", sort="lastCheck", descending=True)
    return rows.select("source_id", "name", "runtime", health.signal_quality(F.col("runtime"), F.col("items"), F.col("accepted"), F.col("markers")).alias("quality"))


HITS_SQL = """ht AS (SELECT l_orderkey AS item_id, 'r' || (l_suppkey % 6) AS region, (['target', 'origin', 'neutral', 'neutral'])[CAST(l_partkey % 4 + 1 AS BIGINT)] AS role, CASE WHEN l_partkey % 5 <> 0 THEN 'c' || (l_suppkey % 30) END AS country FROM lineitem),
nn AS (SELECT count(*) AS items FROM orders)"""


def _region_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.element_at(F.array(*map(F.lit, ("target", "origin", "neutral", "neutral"))), (F.col("l_partkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("item_id"), F.concat(F.lit("r"), F.col("l_suppkey") % 6).alias("region"), role.alias("role"), F.when(F.col("l_partkey") % 5 != 0, F.concat(F.lit("c"), F.col("l_suppkey") % 30)).alias("country"))


@query("cyber_regions", f"""WITH {HITS_SQL}, g AS (SELECT item_id, region, max(role = 'target')::INT AS t, max(role = 'origin')::INT AS o FROM ht GROUP BY ALL),
c AS (SELECT region, count(*) AS n, CAST(sum(t) AS BIGINT) AS target, CAST(sum(o) AS BIGINT) AS origin, count(*) FILTER (t = 0 AND o = 0) AS neutral FROM g GROUP BY region),
k AS (SELECT region, country, count(DISTINCT item_id) AS m FROM ht WHERE country IS NOT NULL GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY region ORDER BY m DESC, country) AS rank FROM k),
nm AS (SELECT region, string_agg(country, ',' ORDER BY rank) AS countries FROM tk WHERE rank <= 3 GROUP BY region)
SELECT region, n, round(n / items, 6) AS share, target, origin, neutral, CASE WHEN target >= greatest(origin, neutral) THEN 'target' WHEN origin >= neutral THEN 'origin' ELSE 'neutral' END AS dominant, coalesce(countries, '') AS countries FROM c LEFT JOIN nm USING (region), nn""")
def cyber_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "orders").count()
    return desk.cyber_regions(_region_hits(spark, sf_dir), items).withColumn("countries", F.array_join("countries", ","))


@query("cyber_sectors", """WITH h AS (SELECT l_orderkey AS item_id, 's' || (l_partkey % 9) AS sector, 't' || (l_partkey % 63) AS term FROM lineitem), c AS (SELECT sector, count(DISTINCT item_id) AS n FROM h GROUP BY sector),
k AS (SELECT sector, term, count(DISTINCT item_id) AS m FROM h GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY sector ORDER BY m DESC, term) AS rank FROM k), nm AS (SELECT sector, string_agg(term, ',' ORDER BY rank) AS terms FROM tk WHERE rank <= 3 GROUP BY sector)
SELECT sector, n, round(n / (SELECT count(*) FROM orders), 6) AS share, terms FROM c JOIN nm USING (sector)""")
def cyber_sectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("item_id"), F.concat(F.lit("s"), F.col("l_partkey") % 9).alias("sector"), F.concat(F.lit("t"), F.col("l_partkey") % 63).alias("term"))
    return desk.cyber_sectors(hits, table(spark, sf_dir, "orders").count()).withColumn("terms", F.array_join("terms", ","))


@query("cyber_totals", """WITH i AS (SELECT DISTINCT o_orderkey AS item_id FROM orders), r AS (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_suppkey % 3 = 0), s AS (SELECT DISTINCT l_orderkey AS item_id FROM lineitem WHERE l_partkey % 4 = 0)
SELECT count(*) AS total, count(*) FILTER (r.item_id IS NOT NULL OR s.item_id IS NOT NULL) AS analyzed, count(*) FILTER (r.item_id IS NULL) AS without_region FROM i LEFT JOIN r USING (item_id) LEFT JOIN s USING (item_id)""")
def cyber_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, hits = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("item_id")), table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "item_id")
    return desk.cyber_totals(items, hits.where("l_suppkey % 3 = 0"), hits.where("l_partkey % 4 = 0"))


@query("derived_markers", """WITH h AS (SELECT l_orderkey, l_linenumber, 'c' || (l_suppkey % 25) AS country, CASE WHEN l_partkey % 3 = 0 THEN 'buyer' ELSE 'seller' END AS role, (['low', 'medium', 'high', 'critical'])[CAST(l_partkey % 4 + 1 AS BIGINT)] AS level FROM lineitem),
p AS (SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'cyber' ELSE 'defense' END AS category, first(country ORDER BY (l_orderkey % 2 = 1 AND role = 'buyer') DESC, l_linenumber, country, role, level) AS country, first(level ORDER BY (l_orderkey % 2 = 1 AND role = 'buyer') DESC, l_linenumber, country, role, level) AS level FROM h GROUP BY l_orderkey),
k AS (SELECT category, country, count(*) AS n, max(list_position(['low', 'medium', 'high', 'critical'], level)) AS rank FROM p GROUP BY ALL)
SELECT category, country, CAST(substr(country, 2) AS DOUBLE) AS lat, n, (['low', 'medium', 'high', 'critical'])[rank] AS level FROM k WHERE CAST(substr(country, 2) AS INT) <> 7""")
def derived_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    level = F.element_at(F.array(*map(F.lit, desk.LEVELS)), (F.col("l_partkey") % 4 + 1).cast("int"))
    hit = F.struct(F.col("l_linenumber").alias("place"), F.concat(F.lit("c"), F.col("l_suppkey") % 25).alias("country"), F.when(F.col("l_partkey") % 3 == 0, "buyer").otherwise("seller").alias("role"), level.alias("level"))
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(hit)).alias("countries"))
    odd = F.col("l_orderkey") % 2 == 1
    items = items.select(F.when(odd, "defense").otherwise("cyber").alias("category"), F.when(odd, "buyer").alias("role"), "countries")
    places = spark.range(25).where("id <> 7").select(F.concat(F.lit("c"), F.col("id")).alias("country"), F.col("id").cast("double").alias("lat"), F.col("id").cast("double").alias("lng"))
    return desk.derived_markers(items, places).drop("lng")


@query("boundary_search", """WITH u AS (SELECT p_partkey AS unit_id, p_name AS name, p_size % 5 AS level, trim(regexp_replace(strip_accents(lower(p_name)), '\\s+', ' ', 'g')) AS key FROM part)
SELECT unit_id, name, CAST(level AS BIGINT) AS level FROM u WHERE starts_with(key, 'blue b') ORDER BY key = 'blue b' DESC, level, length(key), name, unit_id LIMIT 12""")
def boundary_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    units = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("unit_id"), F.col("p_name").alias("name"), (F.col("p_size") % 5).cast("long").alias("level"))
    return desk.boundary_search(units.withColumn("key", desk.boundary_key(F.col("name"))), " Blüe  b").select("unit_id", "name", "level")


@query("geometry_stats", """WITH v AS (SELECT l_orderkey AS unit_id, CAST(l_suppkey % 360 AS DOUBLE) - 180 AS lng, CAST(l_partkey % 180 AS DOUBLE) - 90 AS lat FROM lineitem)
SELECT unit_id, count(*) AS vertices, min(lng) AS min_lng, min(lat) AS min_lat, max(lng) AS max_lng, max(lat) AS max_lat, round(avg(lng), 6) AS lng, round(avg(lat), 6) AS lat FROM v GROUP BY unit_id""")
def geometry_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(((F.col("l_suppkey") % 360).cast("double") - 180).alias("lng"), ((F.col("l_partkey") % 180).cast("double") - 90).alias("lat"))
    return desk.geometry_stats(table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("unit_id")).agg(F.collect_list(point).alias("points")))


@query("marker_items", """WITH r AS (SELECT o_custkey AS marker_id, o_orderkey % 900 AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS place FROM orders)
SELECT marker_id, string_agg(s_name, ',' ORDER BY place) AS items FROM r LEFT JOIN supplier ON s_suppkey = item_id GROUP BY marker_id""")
def marker_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("marker_id")).agg(F.transform(F.array_sort(F.collect_list("o_orderkey")), lambda k: k % 900).alias("item_ids"))
    items = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item_id"), F.col("s_name").alias("name"))
    out = desk.rehydrate(refs, items)
    return out.select("marker_id", F.nullif(F.array_join(F.transform("items", lambda x: x["name"]), ","), F.lit("")).alias("items"))


def stories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as reports of one story a segment, nation and account, hour by hour. Order decides, so SQL has no short form: see tests/test_stories.py."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    k = F.col("c_custkey")
    title = F.concat_ws(" ", "c_mktsegment", F.lower("n_name"), F.lit("reports account"), F.concat(F.lit("no"), k % 7 + 100))
    reports = c.join(n, c.c_nationkey == n.n_nationkey).select(
        k.alias("item_id"), k.alias("ordinal"), F.concat(F.lit("d"), k % 3).alias("domain"), title.alias("title"), F.col("n_name").alias("country"), F.timestamp_seconds(F.lit(1704067200) + k * 600).alias("at"),
        (k % 11).alias("score"), (k % 13).cast("string").alias("source_id"), F.concat(F.lit("source "), k % 13).alias("source_name"))
    found = clusters(reports).join(reports.drop("ordinal"), "item_id")
    return story_cards(found).withColumn("sources", F.array_join("sources", ","))


QUERIES["stories"] = stories


@query("data_rules", f"""WITH {STATE_SQL}, i AS (SELECT o_orderkey AS k, 's' || (o_custkey % 20) AS source_id, 'f' || (o_orderkey % 9000) AS fp, CASE WHEN o_orderkey % 2 = 0 THEN 'u' || (o_orderkey % 11000) END AS up FROM orders)
SELECT 'effective_bounds' AS rule, source_id AS key FROM st WHERE NOT (3600 <= interval_s AND interval_s <= 34000000)
UNION ALL SELECT 'unique_fingerprint', source_id || '|' || fp FROM i GROUP BY source_id, fp HAVING count(*) > 1
UNION ALL SELECT 'unique_upstream', source_id || '|' || up FROM i WHERE up IS NOT NULL GROUP BY source_id, up HAVING count(*) > 1
UNION ALL SELECT 'completed_when_not_running', CAST(o_orderkey AS VARCHAR) FROM orders WHERE (o_orderstatus = 'O') <> (o_custkey % 3 = 0) UNION ALL SELECT 'status', CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')""")
def data_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    state, _ = _state(spark, sf_dir)
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    items = o.select(F.concat(F.lit("s"), F.col("o_custkey") % 20).alias("source_id"), F.concat(F.lit("f"), k % 9000).alias("fp"), F.when(k % 2 == 0, F.concat(F.lit("u"), k % 11000)).alias("up"))
    parts = [
        registry.breaks(state, "source_id", "effective_bounds", F.col("interval_s").between(3600, 34000000)), registry.repeated(items, ["source_id", "fp"], "unique_fingerprint"),
        registry.repeated(items, ["source_id", "up"], "unique_upstream"), registry.breaks(o, "o_orderkey", "completed_when_not_running", (F.col("o_orderstatus") == "O") == (F.col("o_custkey") % 3 == 0)),
        registry.unlisted(o, "o_orderkey", "o_orderstatus", ["O", "F"], "status"),
    ]
    return reduce(DataFrame.unionByName, parts)


@query("effective_catalog", """WITH b AS (SELECT s_suppkey AS source_id, s_name AS name FROM supplier), p AS (SELECT c_custkey AS source_id, c_name AS name FROM customer WHERE c_custkey % 3 = 0 AND c_nationkey <> 5)
SELECT * FROM b WHERE source_id NOT IN (SELECT source_id FROM p) UNION ALL SELECT * FROM p""")
def effective_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    built_in = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("name"))
    personal = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("source_id"), F.col("c_name").alias("name"), (F.col("c_custkey") % 3 == 0).alias("enabled"), F.when(F.col("c_nationkey") == 5, F.current_timestamp()).alias("deleted_at"))
    return registry.effective_catalog(built_in, personal)

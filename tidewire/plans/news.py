"""Queries over the driver's tables as news tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import text as fn
from tidewire.operators import phrases, signals, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Regions by remainder; the sixth is missing.
REGIONS = ("europe", "middle_east", "asia", "africa", "americas")
#: A small lexicon of words that the texts have: group, phrase; and each group's domain and base.
LEXICON = (("core", "that"), ("core", "with"), ("core", "and the"), ("care", "from"), ("care", "und der"), ("care", "que"), ("law", "license"), ("law", "the"), ("law", "la"), ("negative", "les"), ("negative", "for and"))
GROUPS = (("core", "conflict", 18, True), ("care", "humanitarian", 12, False), ("law", "diplomacy", 9, False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as processed news events."""
    e = table(spark, sf_dir, "events")
    region = F.element_at(F.array(*map(F.lit, REGIONS), F.lit(None).cast("string")), (F.col("user_id") % 6 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("item_id"), F.col("ts").alias("published_at"), F.col("event_type").alias("primary_domain"), F.concat(F.lit("u"), F.col("user_id")).alias("source_id"),
        F.floor("value").alias("priority_score"), region.alias("region"), (F.col("event_type") != "error").alias("accepted"), F.concat(F.lit("place "), F.col("user_id") % 40).alias("label"),
        F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 40) * 2.25 - 40).alias("lat"), F.when(F.col("user_id") % 7 != 0, (F.col("user_id") % 40) * 4.5 - 90).alias("lng"), "props",
    )


EVENTS_SQL = """e AS (SELECT event_id AS item_id, ts AS published_at, event_type AS primary_domain, 'u' || user_id AS source_id, CAST(floor(value) AS BIGINT) AS priority_score,
  (['europe', 'middle_east', 'asia', 'africa', 'americas', NULL])[CAST(user_id % 6 + 1 AS BIGINT)] AS region, event_type <> 'error' AS accepted, 'place ' || (user_id % 40) AS label,
  CASE WHEN user_id % 7 <> 0 THEN (user_id % 40) * CAST(2.25 AS DOUBLE) - 40 END AS lat, CASE WHEN user_id % 7 <> 0 THEN (user_id % 40) * CAST(4.5 AS DOUBLE) - 90 END AS lng, props FROM events)"""


def as_of(e: DataFrame) -> datetime:
    return e.agg(F.max("published_at").alias("t")).first().t or datetime(1970, 1, 1)


def text_of(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def query(name: str, sql: str) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@query("density", f"""WITH {EVENTS_SQL}, m AS (SELECT max(published_at) AS t FROM e), w AS (SELECT unnest([6, 12, 24, 48]) AS hours),
r AS (SELECT w.hours, e.region, e.primary_domain FROM e, m, w WHERE e.accepted AND e.published_at >= m.t - to_hours(w.hours)),
k AS (SELECT hours, 'total' AS kind, 'all' AS key FROM r UNION ALL SELECT hours, 'region', coalesce(region, 'unspecified') FROM r UNION ALL SELECT hours, 'domain', coalesce(primary_domain, 'unspecified') FROM r),
c AS (SELECT hours, kind, key, count(*) AS n FROM k GROUP BY ALL)
SELECT hours, kind, key, n, round(n / sum(n) OVER (PARTITION BY hours, kind), 6) AS share FROM c""")  # fmt: skip
def density(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir)
    return signals.density(e, as_of(e))


@query("publish_gap", f"""WITH {EVENTS_SQL}, g AS (SELECT source_id, published_at, epoch_us(published_at) - epoch_us(lag(published_at) OVER (PARTITION BY source_id ORDER BY published_at)) AS gap FROM e WHERE published_at IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY published_at DESC) AS rank FROM g)
SELECT source_id, CAST(floor(quantile_cont(CASE WHEN gap > 0 THEN gap / 1e6 END, 0.5) + 0.5) AS BIGINT) AS gap_seconds FROM r WHERE rank <= 50 GROUP BY source_id""")  # fmt: skip
def publish_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.publish_gap(events(spark, sf_dir))


@query("markers", f"""WITH {EVENTS_SQL} SELECT label, round(lat, 2) AS lat, round(lng, 2) AS lng, count(*) AS n_items, count(DISTINCT source_id) AS n_sources,
first(item_id ORDER BY priority_score DESC, published_at, item_id) AS lead, strftime(max(published_at), '%Y-%m-%d %H:%M:%S.%f') AS newest FROM e WHERE lat IS NOT NULL AND lng IS NOT NULL GROUP BY label, round(lat, 2), round(lng, 2)""")  # fmt: skip
def markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.markers(events(spark, sf_dir)).withColumn("newest", text_of("newest"))


@query("relative_levels", """WITH s AS (SELECT user_id AS key, CAST(floor(sum(value)) AS BIGINT) AS score FROM events GROUP BY user_id),
q AS (SELECT list_sort(list(score)) AS v, count(*) AS n FROM s), t AS (SELECT v[least(n - 1, CAST(floor(n * 0.55) AS BIGINT)) + 1] AS high, v[least(n - 1, CAST(floor(n * 0.25) AS BIGINT)) + 1] AS mid FROM q)
SELECT key, score, CASE WHEN score >= high THEN 'high' WHEN score >= mid THEN 'medium' ELSE 'low' END AS level FROM s, t""")  # fmt: skip
def relative_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.floor(F.sum("value")).alias("score"))
    return signals.relative_levels(scored)


@query("facets", """WITH s AS (SELECT s_suppkey, n_name, r_name, CASE WHEN s_acctbal < 0 THEN 'idle' WHEN s_acctbal < 5000 THEN 'warn' ELSE 'ok' END AS status FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
f AS (SELECT *, r_name IN ('ASIA', 'EUROPE') AS a, status IN ('ok', 'warn') AS b FROM s)
SELECT 'r_name' AS facet, r_name AS value, count(*) AS n FROM f WHERE b GROUP BY r_name UNION ALL SELECT 'status', status, count(*) FROM f WHERE a GROUP BY status UNION ALL SELECT 'n_name', n_name, count(*) FROM f WHERE a AND b GROUP BY n_name""")  # fmt: skip
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n, r = (table(spark, sf_dir, t) for t in ("supplier", "nation", "region"))
    rows = s.join(n, s.s_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    rows = rows.withColumn("status", F.when(F.col("s_acctbal") < 0, "idle").when(F.col("s_acctbal") < 5000, "warn").otherwise("ok"))
    return signals.facet_counts(rows, {"r_name": {"ASIA", "EUROPE"}, "status": {"ok", "warn"}, "n_name": set()})


@query("source_statistics", """SELECT l_suppkey AS source_id, count(*) AS attempts, count(*) FILTER (l_returnflag <> 'R') AS ok, round(avg(l_quantity), 6) AS mean_duration,
round(quantile_cont(l_quantity, 0.95), 6) AS p95_duration, strftime(max(l_shipdate) FILTER (l_returnflag = 'R'), '%Y-%m-%d %H:%M:%S.%f') AS last_error_at FROM lineitem GROUP BY l_suppkey""")  # fmt: skip
def source_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("source_id"), F.col("l_quantity").alias("duration"), F.when(F.col("l_returnflag") == "R", "timeout").otherwise("ok").alias("status"), F.col("l_shipdate").alias("created_at"))
    return signals.source_statistics(runs).withColumn("last_error_at", text_of("last_error_at"))


@query("interleaved_pages", f"""WITH {EVENTS_SQL}, t AS (SELECT item_id, primary_domain AS layer, priority_score, row_number() OVER (PARTITION BY primary_domain ORDER BY priority_score DESC, item_id) AS turn FROM e),
p AS (SELECT *, row_number() OVER (ORDER BY turn, layer) - 1 AS place FROM t) SELECT item_id, layer, turn, CAST(place // 12 AS BIGINT) AS page FROM p""")  # fmt: skip
def interleaved_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = events(spark, sf_dir).select("item_id", F.col("primary_domain").alias("layer"), "priority_score")
    return signals.interleave(rows).select("item_id", "layer", "turn", "page")


@query("source_counts", """WITH c AS (SELECT o_custkey, count(*) AS n, max(o_orderdate) AS t FROM orders GROUP BY o_custkey)
SELECT c_custkey AS source_id, coalesce(n, 0) AS items, strftime(t, '%Y-%m-%d %H:%M:%S.%f') AS newest FROM customer LEFT JOIN c ON c_custkey = o_custkey""")  # fmt: skip
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("t"))
    rows = table(spark, sf_dir, "customer").join(counts, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("source_id"), F.coalesce("n", F.lit(0)).alias("items"), text_of("t").alias("newest"))


@query("nearest_unit", """WITH p AS (SELECT c_custkey AS point_id, c_mktsegment AS name, CAST(c_custkey % 90 AS DOUBLE) AS lat, CAST(c_custkey % 170 AS DOUBLE) AS lng FROM customer),
u AS (SELECT p_partkey AS unit_id, (['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY'])[CAST(p_partkey % 5 + 1 AS BIGINT)] AS name, p_partkey % 90 - p_size * 1.0 AS a, p_partkey % 90 + p_size * 1.0 AS b, p_partkey % 170 - p_size * 1.0 AS c, p_partkey % 170 + p_size * 1.0 AS d FROM part)
SELECT point_id, first(unit_id ORDER BY pow(lat - (a + b) / 2, 2) + pow(lng - (c + d) / 2, 2), unit_id) AS unit_id FROM p JOIN u USING (name) WHERE lat BETWEEN a AND b AND lng BETWEEN c AND d GROUP BY point_id""")  # fmt: skip
def nearest_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, size, names = F.col("p_partkey"), F.col("p_size").cast("double"), F.array(*map(F.lit, ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")))
    points = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("point_id"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 90).cast("double").alias("lat"), (F.col("c_custkey") % 170).cast("double").alias("lng"))
    units = table(spark, sf_dir, "part").select(
        key.alias("unit_id"), F.element_at(names, (key % 5 + 1).cast("int")).alias("name"), (key % 90 - size).alias("min_lat"), (key % 90 + size).alias("max_lat"), (key % 170 - size).alias("min_lng"), (key % 170 + size).alias("max_lng"))
    return signals.nearest_unit(points, units)


ACCENTS = "strip_accents(lower(coalesce({x}, '')))"
PLAIN = "trim(regexp_replace(" + ACCENTS + ", '[^a-z0-9]+', ' ', 'g'))"


@query("fingerprints", f"""SELECT doc_id, sha256(concat_ws(chr(10), coalesce(source, ''), trim(regexp_replace({ACCENTS.format(x="text")}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), '')) AS fingerprint FROM documents""")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", fn.fingerprint(F.coalesce("source", F.lit("")), F.col("text"), F.lit(None).cast("string")).alias("fingerprint"))


#: Variants of the pages' addresses, by page_id, that canonical forms must treat alike or apart; the second argument is the address.
VARIANTS = ("upper(split_part({x}, ':', 1)) || substr({x}, length(split_part({x}, ':', 1)) + 1)", "{x} || '/?utm_source=a&id=' || page_id || '#top'", "{x} || '?yclid=1&b=x+y&igshid=2'", "{x} || '?REF=1&utm_=2'", "replace({x}, 'http', 'ftp')", "{x} || '///'")
VARIANTS_SQL = "CASE page_id % 7 " + " ".join(f"WHEN {i} THEN {v.format(x='url')}" for i, v in enumerate(VARIANTS)) + " ELSE url END"


@query("canonical_urls", f"""WITH v AS (SELECT page_id, trim({VARIANTS_SQL}) AS url FROM pages), u AS (SELECT page_id, regexp_extract(url, '(?i)^(https?)://([^/?#]+)([^?#]*)(?:\\?([^#]*))?(?:#.*)?$', ['a', 'b', 'c', 'd']) AS x FROM v),
p AS (SELECT page_id, x, regexp_replace(x.c, '/+$', '') AS path, list_filter(string_split(x.d, '&'), lambda p: p <> '' AND NOT regexp_full_match(string_split(p, '=')[1], '(?i)utm_\\w+|fbclid|gclid|yclid|mc_cid|mc_eid|ref|cmpid|ncid|ico')) AS ps FROM u),
q AS (SELECT *, array_to_string(list_transform(ps, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), '&') AS query FROM p)
SELECT page_id, CASE WHEN x.a <> '' THEN lower(x.a) || '://' || lower(x.b) || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN query = '' THEN '' ELSE '?' || query END END AS url FROM q""")  # fmt: skip
def canonical_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    varied = table(spark, sf_dir, "pages").select("page_id", F.expr(VARIANTS_SQL).alias("url"))
    return varied.select("page_id", fn.canonical_url(F.col("url")).alias("url"))


LEXICON_SQL = f"""lex AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{p}')" for g, p in LEXICON)}) AS v(grp, phrase)),
ws AS (SELECT doc_id AS id, string_split({PLAIN.format(x="text")}, ' ') AS w FROM documents),
gr AS (SELECT id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrase FROM ws),
hits AS (SELECT id, grp, phrase, count(*) AS hits FROM gr JOIN lex USING (phrase) GROUP BY ALL)"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return phrases.phrase_hits(docs, spark.createDataFrame(list(LEXICON), "group string, phrase string"))


@query("phrase_hits", f'WITH {LEXICON_SQL} SELECT id, grp AS "group", phrase, hits FROM hits')
def phrase_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir)


RELEVANCE_TEXTS = ("CASE WHEN lang = 'de' AND doc_id % 3 = 0 THEN 'diplomacy' END AS context", "coalesce(source = 'src1', false) AS official", "coalesce(source = 'src2', false) AS aggregator", "CASE WHEN source = 'src3' THEN 'sports_or_non_relevant_domain' END AS guard")


@query("relevance", f"""WITH {LEXICON_SQL}, gs AS (SELECT * FROM (VALUES {", ".join(f"('{g}', '{d}', {b}, {i}, {s})" for i, (g, d, b, s) in enumerate(GROUPS))}) AS v(grp, domain, base, place, strong)),
bg AS (SELECT id, grp, domain, place, strong, base + 3 * least(count(DISTINCT phrase) - 1, 3) AS points FROM hits JOIN gs USING (grp) GROUP BY id, grp, domain, place, strong, base),
t AS (SELECT doc_id AS id, {", ".join(RELEVANCE_TEXTS)} FROM documents),
bd AS (SELECT id, domain, sum(points) AS points, min(place) AS place FROM (SELECT id, domain, points, place FROM bg UNION ALL SELECT id, context, 28, {len(GROUPS)} FROM t WHERE context IS NOT NULL) GROUP BY ALL),
best AS (SELECT id, first(domain ORDER BY points DESC, place) AS domain FROM bd GROUP BY id),
w AS (SELECT id, sum(points) AS points, count(DISTINCT domain) AS domains, bool_or(strong) AS strong FROM bg GROUP BY id), noisy AS (SELECT DISTINCT id FROM hits WHERE grp = 'negative'),
r AS (SELECT t.id, best.domain, (noisy.id IS NOT NULL AND NOT coalesce(strong, false) OR guard IS NOT NULL) AND context IS NULL AS barred,
  CASE WHEN noisy.id IS NULL THEN coalesce(points, 0) ELSE greatest(coalesce(points, 0) - 5, 0) END + CASE WHEN official THEN 15 ELSE 0 END + CASE WHEN aggregator THEN 20 ELSE 0 END + CASE WHEN domains > 1 THEN 10 ELSE 0 END + CASE WHEN context IS NULL THEN 0 ELSE 28 END AS score
  FROM t LEFT JOIN w ON w.id = t.id LEFT JOIN best ON best.id = t.id LEFT JOIN noisy ON noisy.id = t.id)
SELECT id, CASE WHEN NOT barred THEN domain END AS domain, CAST(CASE WHEN barred THEN 0 ELSE score END AS BIGINT) AS score, NOT barred AND score >= 25 AND domain IS NOT NULL AS accepted,
CASE WHEN barred THEN 'negative_noise' WHEN NOT (score >= 25 AND domain IS NOT NULL) THEN 'low_relevance' END AS rejected_by FROM r""")  # fmt: skip
def relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), *map(F.expr, RELEVANCE_TEXTS))
    groups = spark.createDataFrame([(g, d, b, i, s) for i, (g, d, b, s) in enumerate(GROUPS)], "group string, domain string, base int, place int, strong boolean")
    return phrases.relevance(texts, _hits(spark, sf_dir), groups)


def _rounds(n: int) -> str:
    """SQL of so many rounds of first-come dedupe; the driver's tables need fewer."""
    out, left = [], "x"
    for i in range(n):
        out.append(f"""f{i} AS (SELECT *, doc_id = min(doc_id) OVER (PARTITION BY source, fp) AND doc_id = min(doc_id) OVER (PARTITION BY source, up) AND doc_id = min(doc_id) OVER (PARTITION BY source, coalesce(url, 'none of ' || doc_id)) AS stays FROM {left}),
s{i} AS (SELECT * FROM f{i} WHERE stays), l{i} AS (SELECT doc_id, source, fp, up, url FROM f{i} WHERE NOT stays AND (source, fp) NOT IN (SELECT (source, fp) FROM s{i}) AND (source, up) NOT IN (SELECT (source, up) FROM s{i}) AND (url IS NULL OR (source, url) NOT IN (SELECT (source, url) FROM s{i} WHERE url IS NOT NULL)))""")
        left = f"l{i}"
    return ",\n".join(out) + "\n" + " UNION ALL ".join(f"SELECT doc_id, source FROM s{i}" for i in range(n))


ITEM_KEYS = ("sha256(coalesce(text, '')) AS fp", "CAST(doc_id // 2 % 700 AS BIGINT) AS up", "CASE WHEN doc_id % 4 = 1 THEN 'u' || (doc_id // 3 % 400) END AS url")


@query("new_items", f"""WITH d AS (SELECT doc_id, coalesce(source, 'none') AS source, {", ".join(ITEM_KEYS)} FROM documents),
k AS (SELECT * FROM d WHERE doc_id % 9 = 0), b AS (SELECT * FROM d WHERE doc_id % 9 <> 0), t AS (SELECT DISTINCT source, fp FROM d WHERE doc_id % 13 = 5),
x AS (SELECT * FROM b WHERE (source, fp) NOT IN (SELECT (source, fp) FROM k) AND (source, up) NOT IN (SELECT (source, up) FROM k) AND (url IS NULL OR (source, url) NOT IN (SELECT (source, url) FROM k WHERE url IS NOT NULL)) AND (source, fp) NOT IN (SELECT (source, fp) FROM t)),
{_rounds(12)}""")  # fmt: skip
def new_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as items with all three keys; one of nine is known, one of thirteen has a live tombstone."""
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.coalesce("source", F.lit("none")).alias("source_id"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("fingerprint"), F.floor(F.col("doc_id") / 2) % 700,
        F.when(F.col("doc_id") % 4 == 1, F.concat(F.lit("u"), F.floor(F.col("doc_id") / 3) % 400)), F.col("doc_id").alias("ordinal")).toDF("doc_id", "source_id", "fingerprint", "upstream_id", "canonical_url", "ordinal")
    stones = rows.where("doc_id % 13 = 5").select("source_id", "fingerprint", F.lit(datetime(2024, 1, 2)).alias("expires_at"))
    got = store.new_items(rows.where("doc_id % 9 <> 0"), rows.where("doc_id % 9 = 0"), stones, datetime(2024, 1, 1))
    return got.select("doc_id", F.col("source_id").alias("source"))


@query("latest_by_source", f"""WITH {EVENTS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY priority_score DESC, published_at DESC, item_id) AS rank FROM e) SELECT source_id, item_id, priority_score FROM r WHERE rank = 1""")
def latest_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [F.col("priority_score"), F.col("published_at"), -F.col("item_id")]
    return store.latest(events(spark, sf_dir), "source_id", order).select("source_id", "item_id", "priority_score")


@query("csv_export", """SELECT s_suppkey AS id, '"' || s_suppkey || '","' || replace(s_name, '"', '""') || '"' AS line FROM supplier""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.csv_lines(table(spark, sf_dir, "supplier"), ["s_suppkey", "s_name"]).select(F.col("s_suppkey").alias("id"), "line")


@query("json_field", f"WITH {EVENTS_SQL} SELECT CAST(props->>'k' AS BIGINT) AS k, count(*) AS n FROM e GROUP BY 1")
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"))


@query("constraint_violations", f"""WITH {EVENTS_SQL} SELECT 'poll_bounds' AS rule, CAST(p_partkey AS VARCHAR) AS key FROM part WHERE NOT (p_size <= 30 AND 30 <= p_size + 25)
UNION ALL SELECT 'eligible_without_place', CAST(item_id AS VARCHAR) FROM e WHERE primary_domain = 'purchase' AND (lat IS NULL OR lng IS NULL)""")  # fmt: skip
def constraint_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("source_id"), F.col("p_size").alias("min_s"), F.lit(30).alias("base_s"), (F.col("p_size") + 25).alias("max_s"))
    return store.violations(state, events(spark, sf_dir).withColumn("eligible", F.col("primary_domain") == "purchase"))

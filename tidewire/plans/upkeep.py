"""Queries of the store's upkeep: attempts of sources, a table published in versions, outlines within a budget."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.operators import health, outlines
from tidewire.operators.lineage import folder
from tidewire.operators.publish import Published
from tidewire.plans.news import QUERIES, query, table

_AT = "TIMESTAMP '2024-01-01 00:00:00' + to_seconds(l_orderkey * 7 + l_linenumber)"


@query("source_attempts", f"""WITH a AS (SELECT l_suppkey AS source_id, l_orderkey, l_linenumber, {_AT} AS t, l_returnflag <> 'R' AS ok, l_linestatus = 'F' AS changed, CAST(l_quantity AS BIGINT) * 60 AS delay_s, CASE WHEN l_returnflag = 'R' THEN 'backoff' ELSE 'observed_cadence' END AS reason,
CASE WHEN l_returnflag = 'A' THEN 'e' || l_partkey END AS etag, CASE WHEN l_linenumber = 7 THEN l_partkey END AS ttl_s FROM lineitem WHERE l_suppkey % 5 <> 0),
g AS (SELECT source_id, max(t) AS t, max(t) FILTER (ok) AS ok_at, max(t) FILTER (changed) AS changed_at, arg_max(delay_s, t) AS delay_s, arg_max(reason, t) AS reason, arg_max(etag, t) FILTER (etag IS NOT NULL) AS etag, arg_max(ttl_s, t) FILTER (ttl_s IS NOT NULL) AS ttl_s FROM a GROUP BY source_id)
SELECT s_suppkey AS source_id, strftime(g.t, '%Y-%m-%d %H:%M:%S') AS attempted_at, coalesce(strftime(ok_at, '%Y-%m-%d %H:%M:%S'), '2023-01-01 00:00:00') AS succeeded_at, strftime(changed_at, '%Y-%m-%d %H:%M:%S') AS changed_at,
strftime(g.t + to_seconds(delay_s), '%Y-%m-%d %H:%M:%S') AS next_poll_at, CASE WHEN g.t IS NOT NULL AND reason = 'backoff' THEN strftime(g.t + to_seconds(delay_s), '%Y-%m-%d %H:%M:%S') END AS backoff_until,
reason, coalesce(etag, 'e0') AS etag, CAST(ttl_s AS BIGINT) AS ttl_s, CASE WHEN g.t IS NULL THEN CAST(900 AS BIGINT) ELSE delay_s END AS interval_s FROM supplier LEFT JOIN g ON source_id = s_suppkey""")
def source_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    none, times = lambda kind: F.lit(None).cast(kind), ("attempted_at", "changed_at", "next_poll_at", "backoff_until", "updated_at")
    numbers, words = ("streak", "failures", "http_status", "duration_ms", "new_items", "max_age_s", "observed_s"), ("error", "last_modified")
    rest = [*(none("long").alias(c) for c in (*numbers, "ttl_s")), *(none("string").alias(c) for c in (*words, "reason"))]
    state = table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("source_id"), *(none("timestamp").alias(c) for c in times), F.lit("2023-01-01").cast("timestamp").alias("succeeded_at"), F.lit(900).cast("long").alias("interval_s"), F.lit("e0").alias("etag"), *rest)
    wait = F.col("l_quantity").cast("long") * 60
    attempts = table(spark, sf_dir, "lineitem").where("l_suppkey % 5 <> 0").select(
        F.col("l_suppkey").alias("source_id"), F.timestamp_seconds(F.lit(1704067200) + F.col("l_orderkey") * 7 + F.col("l_linenumber")).alias("at"), (F.col("l_returnflag") != "R").alias("ok"),
        (F.col("l_linestatus") == "F").alias("changed"), wait.alias("delay_s"), wait.alias("interval_s"), F.when(F.col("l_returnflag") == "R", "backoff").otherwise("observed_cadence").alias("reason"),
        F.when(F.col("l_returnflag") == "A", F.concat(F.lit("e"), F.col("l_partkey"))).alias("etag"), F.when(F.col("l_linenumber") == 7, F.col("l_partkey")).alias("ttl_s"),
        *(none("long").alias(c) for c in numbers), *(none("string").alias(c) for c in words))
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)
    return health.record_attempts(state, attempts).select("source_id", *map(shown, ("attempted_at", "succeeded_at", "changed_at", "next_poll_at", "backoff_until")), "reason", "etag", "ttl_s", "interval_s")


@query("published_orders", """WITH n AS (SELECT o_custkey AS k, arg_max(o_orderkey, o_orderkey) AS o FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT c_custkey AS customer, coalesce(o, -1) AS last_order, CAST(2 AS BIGINT) AS version FROM customer LEFT JOIN n ON k = c_custkey UNION ALL SELECT k, o, 2 FROM n WHERE k NOT IN (SELECT c_custkey FROM customer)""")
def published_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers published without orders, then merged with their last finished order."""
    store = Published(spark, f"{folder(spark)}/published-{uuid.uuid4().hex}")
    store.publish(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("customer"), F.lit(-1).cast("long").alias("last_order")))
    finished = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("customer"), F.col("o_orderkey").cast("long").alias("last_order"))
    version = store.merge(finished, "customer", "last_order", batch=0)
    return store.read().withColumn("version", F.lit(version).cast("long"))


def simplified_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rings of line items, a unit for each return flag and line status, within 4,000 vertices. Rounds decide, so SQL has no short form: see tests/test_outlines.py."""
    place = F.struct((F.col("l_orderkey") * 0.0001).alias("lng"), (F.col("l_extendedprice") * 0.000001).alias("lat"))
    ordered = F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber", place.alias("at"))))
    rings = table(spark, sf_dir, "lineitem").groupBy(
        F.concat("l_returnflag", "l_linestatus").alias("unit_id"), F.col("l_suppkey").alias("polygon"), (F.col("l_linenumber") - 1).alias("ring")).agg(F.transform(ordered, lambda x: x["at"]).alias("points"))
    out = outlines.simplified(rings)
    return out.select("unit_id", "polygon", "ring", F.size("points").alias("vertices"), F.sha2(F.to_json("points"), 256).alias("points_sha256"))


QUERIES["simplified_outlines"] = simplified_outlines

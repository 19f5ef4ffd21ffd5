"""Rollups of analyzed items: momentum, pressure, topics and regions, consolidated markers, globe points, alerts, layout."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Lower bounds of the pressure bands, seconds until a payload is stale, cards on one ring.
BANDS = ((75, "Critical"), (55, "High"), (35, "Elevated"))
STALE_SECONDS = 1800
ONE_RING = 12
#: Buckets of one pass of ``kth_smallest``; the driver reads one row.
BUCKETS = 4096


def rounded(x: Column, digits: int = 0) -> Column:
    """Half up to so many digits, for negative numbers too."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def kth_smallest(rows: DataFrame, column: str, k: int) -> int | None:
    """The k-th smallest (from 1) value of an integer column, nulls left out; null if there are fewer values.

    Each pass counts values in BUCKETS ranges and goes on inside the one that holds the place, so no task sorts all rows.
    """
    rows = rows.select(F.col(column).cast("long").alias("v")).where("v IS NOT NULL")
    low, high, n = rows.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        width = -(-(high - low + 1) // BUCKETS)
        bucket = F.floor((F.col("v") - low) / F.lit(width)).cast("long") if width > 1 else F.col("v") - low
        counts = rows.where(F.col("v").between(low, high)).groupBy(bucket.alias("b")).agg(F.count("*").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"))
        upto = counts.withColumn("upto", F.sum("c").over(W.orderBy("b")))
        found = upto.where(F.col("upto") >= k).orderBy("b").first()
        k -= found.upto - found.c
        low, high = found.low, found.high
    return low


def momentum(items: DataFrame) -> DataFrame:
    """Rows (segment, n, change, rank): a segment's share among the first half of items less that among the rest, in points.

    items: ordinal (distinct), segments (array). An item counts once in a segment. Ties of counts rank by name.
    """
    total = items.count()
    half = total // 2
    last = kth_smallest(items, "ordinal", half)
    early = F.col("ordinal") <= F.lit(last) if last is not None else F.lit(False)
    flat = items.select(F.explode(F.array_distinct("segments")).alias("segment"), early.alias("early")).where("segment IS NOT NULL")
    counts = flat.groupBy("segment").agg(F.count("*").alias("n"), F.count_if("early").alias("first"))
    change = rounded((F.col("first") / max(half, 1) - (F.col("n") - F.col("first")) / max(total - half, 1)) * 1000) / 10
    return counts.select("segment", "n", change.alias("change"), F.row_number().over(W.orderBy(F.desc("n"), "segment")).cast("long").alias("rank"))


def pressure(mentions: DataFrame) -> DataFrame:
    """Rows (commodity, mentions, stressed, score, status). mentions: commodity, stressed (boolean)."""
    counts = mentions.groupBy("commodity").agg(F.count("*").alias("mentions"), F.count_if(F.coalesce("stressed", F.lit(False))).alias("stressed"))
    score = F.least(F.lit(100), F.greatest(F.lit(12), 7 * F.col("mentions") + 11 * F.col("stressed"))).cast("long")
    status = F.lit("Moderate")
    for least, name in reversed(BANDS):
        status = F.when(F.col("score") >= least, name).otherwise(status)
    return counts.withColumn("score", score).withColumn("status", status)


def topic_metrics(items: DataFrame, topics: list[str]) -> DataFrame:
    """Rows (topic, n, share, rank) of all topics, those without items too; ties keep the topics' order. items: topic."""
    names = items.sparkSession.createDataFrame([(t, i) for i, t in enumerate(topics)], "topic string, place int")
    counts = items.where(F.col("topic").isin(*topics)).groupBy("topic").agg(F.count("*").alias("n"))
    rows = names.join(counts, "topic", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))
    total = F.greatest(F.sum("n").over(W.partitionBy()), F.lit(1))
    return rows.select("topic", "n", F.round(F.col("n") / total, 6).alias("share"), F.row_number().over(W.orderBy(F.desc("n"), "place")).cast("long").alias("rank"))


def region_metrics(items: DataFrame, most: int = 6) -> DataFrame:
    """Rows (region, n, n_countries, pct) of the regions with most items, pct of the largest; ties by name. items: region, country."""
    top = items.groupBy("region").agg(F.count("*").alias("n"), F.count_distinct("country").alias("n_countries")).orderBy(F.desc("n"), "region").limit(most)
    return top.withColumn("pct", rounded(F.col("n") / F.greatest(F.max("n").over(W.partitionBy()), F.lit(1)) * 100).cast("long"))


def consolidate(markers: DataFrame, levels: list[str]) -> DataFrame:
    """Rows (label, reports, level, lat, lng, n_categories): markers of a label as one, its centre weighted by reports.

    markers: label, category, level, reports, lat, lng. ``levels`` ascend; unknown ones are the least.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, levels)), F.col("level")), F.lit(0))
    n = F.coalesce("reports", F.lit(1))
    centre = lambda c: F.round(F.sum(F.col(c) * n) / F.sum(n), 6).alias(c)
    out = markers.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("label").agg(F.sum(n).alias("reports"), F.max(rank).alias("_rank"), centre("lat"), centre("lng"), F.count_distinct("category").alias("n_categories"))
    level = F.element_at(F.array(*map(F.lit, levels)), F.greatest("_rank", F.lit(1)).cast("int"))
    return out.withColumn("level", level).drop("_rank")


def globe_points(events: DataFrame, as_of: datetime, hours: int = 24) -> DataFrame:
    """Rows (label, n, n_sources, lead, score, newest) of places with events of the last hours; the lead has top priority, then least id."""
    recent = events.where((F.col("published_at") >= F.lit(as_of - timedelta(hours=hours))) & F.col("lat").isNotNull() & F.col("lng").isNotNull())
    return recent.groupBy("label").agg(
        F.count("*").alias("n"), F.count_distinct("source_id").alias("n_sources"), F.max_by("item_id", F.struct("priority_score", -F.col("item_id"))).alias("lead"),
        F.max("priority_score").alias("score"), F.max("published_at").alias("newest"),
    )


def view_alerts(entries: DataFrame, views: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows (view_id, entry_id): entries that match a saved view and were not seen in it. A null condition matches all.

    entries: entry_id, layer, source, text; views: view_id, layer, source, query; seen: view_id, entry_id. The layer is the key
    of an equi join; a view of all layers becomes one of each. Layers are a few screens, so the driver may list them; entries
    without a layer match nothing.
    """
    layers = [r.layer for r in entries.select("layer").distinct().where("layer IS NOT NULL").collect()]
    own = F.when(F.col("layer").isNull(), F.array(*map(F.lit, layers)).cast("array<string>")).otherwise(F.array("layer"))
    wide = views.select("view_id", F.explode(own).alias("layer"), "source", "query")
    wide = wide.withColumnRenamed("source", "_source")
    same = F.coalesce(F.col("_source") == F.col("source"), F.col("_source").isNull())
    found = F.col("query").isNull() | F.contains(F.lower(F.coalesce("text", F.lit(""))), F.lower("query"))
    return entries.join(wide, "layer").where(same & found).select("view_id", "entry_id").join(seen, ["view_id", "entry_id"], "left_anti")


def ring_layout(cards: DataFrame) -> DataFrame:
    """Add ``x`` and ``y``: one card at the top, up to twelve on one ring, more on two rings in turn. cards: place (from 0)."""
    total = cards.count()
    place = F.col("place")
    if total <= 1:
        return cards.withColumn("x", F.lit(50.0)).withColumn("y", F.lit(15.0))
    if total <= ONE_RING:
        angle = (math.pi if total == 2 else -math.pi / 2) + place * (2 * math.pi / total)
        wide, high = F.lit(33.0), F.lit(34.0)
    else:
        outer, many, few = place % 2 == 0, -(-total // 2), total // 2
        size = F.when(outer, many).otherwise(few)
        angle = F.when(outer, -math.pi / 2).otherwise(-math.pi / 2 + math.pi / few) + F.floor(place / 2) * 2 * math.pi / size
        wide, high = F.when(outer, 39.0).otherwise(25.5), F.when(outer, 39.0).otherwise(26.5)
    return cards.withColumn("x", F.round(50 + F.cos(angle) * wide, 4)).withColumn("y", F.round(50 + F.sin(angle) * high, 4))


def feed_state(payloads: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``age_seconds`` and ``state``: stale if from the previous slot or too old. payloads: slot, generated_at, state."""
    age = F.greatest(F.lit(0), F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("generated_at").cast("timestamp"))) / 1e6 + 0.5)).cast("long")
    rows = payloads.withColumn("age_seconds", age)
    return rows.withColumn("state", F.when((F.col("slot") == "previous") | (F.col("age_seconds") > STALE_SECONDS), "stale").otherwise(F.col("state")))

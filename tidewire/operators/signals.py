"""Density, markers, levels, facets, cadence and source statistics of news events."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WINDOWS = (6, 12, 24, 48)
#: Side of the grid cells by which points meet boxes.
CELL_DEGREES = 10
#: Most places whose nearest units are broadcast to the points; with more, points are joined by shuffle.
MAX_BROADCAST_PLACES = 200_000


def density(events: DataFrame, as_of: datetime, hours: tuple[int, ...] = WINDOWS) -> DataFrame:
    """Rows (hours, kind, key, n, share) for totals, regions and domains of all rolling windows, in one scan.

    events: accepted, published_at, region, primary_domain. Null keys are ``unspecified``; null times are in no window.
    """
    recent = events.where(F.col("accepted") & (F.col("published_at") >= F.lit(as_of - timedelta(hours=max(hours)))))
    inside = F.filter(F.array(*(F.when(F.col("published_at") >= F.lit(as_of - timedelta(hours=h)), F.lit(h)) for h in hours)), lambda h: h.isNotNull())
    keys = F.array(*(F.struct(F.lit(k).alias("kind"), F.coalesce(c, F.lit("unspecified")).alias("key")) for k, c in (("total", F.lit("all")), ("region", F.col("region")), ("domain", F.col("primary_domain")))))
    rows = recent.select(F.explode(inside).alias("hours"), keys.alias("keys")).select("hours", F.inline("keys"))
    counts = rows.groupBy("hours", "kind", "key").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(W.partitionBy("hours", "kind")), 6))


def publish_gap(items: DataFrame, newest: int = 50) -> DataFrame:
    """Rows (source_id, gap_seconds): median of the positive gaps before a source's newest items, null if there is none.

    Only a source's newest ``newest`` + 1 times are needed, which Spark finds before it shuffles. items: source_id, published_at.
    """
    order = W.partitionBy("source_id").orderBy(F.desc("published_at"))
    last = items.where("published_at IS NOT NULL").select("source_id", "published_at", F.row_number().over(order).alias("rank")).where(F.col("rank") <= newest + 1)
    micros = F.unix_micros(F.col("published_at").cast("timestamp"))
    gaps = last.withColumn("gap", micros - F.lead(micros).over(order)).where(F.col("rank") <= newest)
    positive = F.when(F.col("gap") > 0, F.col("gap") / 1e6)
    return gaps.groupBy("source_id").agg(F.floor(F.percentile(positive, F.lit(0.5)) + 0.5).cast("long").alias("gap_seconds"))


def markers(events: DataFrame) -> DataFrame:
    """Rows (label, lat, lng, n_items, n_sources, lead, newest): events at one place to two decimals.

    The lead is the event of highest priority, the first by time and id on ties. events: item_id, source_id, label, lat, lng,
    priority_score, published_at. Events without a place are in no marker.
    """
    first = F.struct(F.col("priority_score"), -F.unix_micros(F.col("published_at").cast("timestamp")), -F.col("item_id"))
    return events.where("lat IS NOT NULL AND lng IS NOT NULL").groupBy("label", F.round("lat", 2).alias("lat"), F.round("lng", 2).alias("lng")).agg(
        F.count("*").alias("n_items"), F.count_distinct("source_id").alias("n_sources"), F.max_by("item_id", first).alias("lead"), F.max("published_at").alias("newest"),
    )


def relative_levels(scored: DataFrame) -> DataFrame:
    """Add ``level``: a score against the nearest-rank 55 % and 25 % quantiles of all scores.

    The quantiles come from counts of distinct scores, so no task sorts all rows. scored: key, score.
    """
    counts = scored.groupBy("score").agg(F.count("*").alias("c"))
    order = W.orderBy("score")
    ranked = counts.select("score", F.sum("c").over(order).alias("upto"), F.sum("c").over(W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))
    cut = lambda q: F.min(F.when(F.col("upto") > F.least(F.col("n") - 1, F.floor(F.col("n") * q)), F.col("score")))
    row = ranked.agg(cut(0.55).alias("high"), cut(0.25).alias("mid")).first()
    level = F.when(F.col("score") >= F.lit(row.high), "high").when(F.col("score") >= F.lit(row.mid), "medium").otherwise("low")
    return scored.withColumn("level", level)


def facet_counts(rows: DataFrame, facets: dict[str, set]) -> DataFrame:
    """Rows (facet, value, n): each facet counted over rows that pass all *other* facets' selections, in one scan.

    facets: columns and the values selected in each; an empty selection passes all.
    """
    passes = {c: F.col(c).isin(*v) if v else F.lit(True) for c, v in facets.items()}

    def others(name: str) -> Column:
        out = F.lit(True)
        for c, ok in passes.items():
            if c != name:
                out &= F.coalesce(ok, F.lit(False))
        return out

    cells = F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value"), others(c).alias("ok")) for c in facets))
    return rows.select(F.inline(cells)).where("ok").groupBy("facet", "value").agg(F.count("*").alias("n"))


def source_statistics(results: DataFrame) -> DataFrame:
    """Attempts, successes, failures, mean and 95 % duration, and the last error of each source.

    results: source_id, duration, status ('ok' or an error code), created_at.
    """
    failed = F.col("status") != "ok"
    return results.groupBy("source_id").agg(
        F.count("*").alias("attempts"), F.count_if(~failed).alias("ok"), F.round(F.avg("duration"), 6).alias("mean_duration"),
        F.round(F.percentile("duration", F.lit(0.95)), 6).alias("p95_duration"), F.max(F.when(failed, F.col("created_at"))).alias("last_error_at"),
    )


def interleave(entries: DataFrame, page_size: int = 12) -> DataFrame:
    """Add ``turn`` and ``page``: layers take turns, each in order of priority. entries: layer, item_id, priority_score.

    Positions follow from counts: a row's turn is its place among rows of its layer's score after those of higher scores,
    so no task sorts a layer; its place is the number of rows of earlier turns and of its turn's earlier layers.
    """
    scores = entries.groupBy("layer", "priority_score").agg(F.count("*").alias("_same"))
    above = F.sum("_same").over(W.partitionBy("layer").orderBy(F.desc("priority_score"))) - F.col("_same")
    scores = scores.select(F.col("layer").alias("_layer"), F.col("priority_score").alias("_score"), above.alias("_above"))
    within = F.row_number().over(W.partitionBy("layer", "priority_score").orderBy("item_id"))
    turns = entries.withColumn("_within", within).join(scores, F.col("layer").eqNullSafe(F.col("_layer")) & F.col("priority_score").eqNullSafe(F.col("_score")))
    turns = turns.withColumn("turn", F.col("_above") + F.col("_within")).select(*entries.columns, "turn")
    sizes = [(r.layer, r.n) for r in entries.groupBy("layer").agg(F.count("*").alias("n")).orderBy("layer").collect()]  # a row for each layer
    before = F.lit(0).cast("long")
    for layer, n in sizes:
        before = before + F.least(F.col("turn") - 1, F.lit(n)) + F.when((F.lit(layer) < F.col("layer")) & (F.col("turn") <= n), 1).otherwise(0)
    return turns.withColumn("page", F.floor(before / page_size).cast("long"))


def nearest_unit(points: DataFrame, units: DataFrame) -> DataFrame:
    """Rows (point_id, unit_id): of the units of a point's name whose box holds it, the one with the nearest centre.

    points: point_id, name, lat, lng; units: unit_id, name, min_lat, max_lat, min_lng, max_lng, in degrees. An equi join on
    names and grid cells, each box in every cell that it covers, with the box test on top. Points of one place are asked
    for once, and of units with the same name and box only the least unit_id can be nearest. Pairs of a place and a box are
    looked at twice, for the least distance and for the least unit_id at it: both are sums that a task keeps by place,
    whereas the least pair of both would have it sort all of its pairs. Points without a unit are left out.
    """
    cell = lambda c: F.floor(F.col(c) / CELL_DEGREES)
    place, box = ["name", "lat", "lng"], ["min_lat", "max_lat", "min_lng", "max_lng"]
    boxes = units.where("min_lat <= max_lat AND min_lng <= max_lng").groupBy("name", *box).agg(F.min("unit_id").alias("unit_id"))
    for axis in ("lat", "lng"):
        boxes = boxes.withColumn(f"{axis}_cell", F.explode(F.sequence(cell(f"min_{axis}"), cell(f"max_{axis}"))))
    boxes = boxes.hint("merge")  # Spark takes them for as few as the units and would broadcast them
    far = F.pow(F.col("lat") - (F.col("min_lat") + F.col("max_lat")) / 2, 2) + F.pow(F.col("lng") - (F.col("min_lng") + F.col("max_lng")) / 2, 2)

    def inside(places: DataFrame) -> DataFrame:
        dealt = places.withColumn("lat_cell", cell("lat")).withColumn("lng_cell", cell("lng"))
        return dealt.join(boxes, ["name", "lat_cell", "lng_cell"]).where("lat BETWEEN min_lat AND max_lat AND lng BETWEEN min_lng AND max_lng")

    places = points.select(*place).distinct()
    least = inside(places).groupBy(*place).agg(F.min(far).alias("far"))
    nearest = inside(least).where(far == F.col("far")).groupBy(*place, "far").agg(F.min("unit_id").alias("unit_id"))
    few = places.count() <= MAX_BROADCAST_PLACES
    found = points.join(F.broadcast(nearest), place) if few else points.hint("merge").join(nearest, place)
    return found.repartition("point_id").groupBy("point_id").agg(F.min(F.struct("far", "unit_id")).getField("unit_id").alias("unit_id"))

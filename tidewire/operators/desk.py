"""Entries of the monitor and the source table: filters, searches, groups by country, exports; cyber rollups; boundary search."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import fold

#: Hours within which a report counts as fresh, levels of a marker from weak to strong, roles from the one
#: that wins ties to the last.
FRESH_HOURS, LEVELS, ROLES = 48, ("low", "medium", "high", "critical"), ("target", "origin", "neutral")

#: Most rows (view, layer) that are sent to all entries; least parts of a layer's entries if there are more. The result is the same.
BROADCAST_VIEWS, VIEW_PARTS = 10_000, 64


def fresh_enough(items: DataFrame, hours: int = FRESH_HOURS) -> DataFrame:
    """Items collected less than so many hours after publication; missing times pass. items: collected_at, published_at."""
    age = F.unix_micros(F.col("collected_at").cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))
    return items.where(F.coalesce(age < hours * 3_600_000_000, F.lit(True)))


def within_window(entries: DataFrame, times: list[str], as_of: datetime, hours: int | None) -> DataFrame:
    """Entries whose first time that is there lies in the last hours; none without any; all if hours is null."""
    return entries if hours is None else entries.where(F.coalesce(*times) >= F.lit(as_of - timedelta(hours=hours)))


def contains_query(query: Column, *columns: str) -> Column:
    """Whether a query occurs in the columns' text, case apart; an empty query does."""
    wanted = F.lower(F.trim(F.coalesce(query, F.lit(""))))
    return (wanted == "") | F.contains(F.lower(F.concat_ws(" ", *(F.coalesce(c, F.lit("")) for c in columns))), wanted)


def matches_view(entries: DataFrame, views: DataFrame, as_of: datetime) -> DataFrame:
    """Rows (view_id, entry_id) of entries that a saved view shows.

    entries: entry_id, layer, source, countries (array), title, summary, tone, published_at; views: view_id, layers (array), source, country, query, hours; null
    or empty conditions match all, but for layers. Layers are the join key, so each view meets its layers' entries only. A layer has a large
    part of all entries: up to BROADCAST_VIEWS rows of views go to the entries, beyond that a layer's entries are dealt out and each part gets the views.
    """
    wide = views.select("view_id", F.explode("layers").alias("layer"), *(F.col(c).alias(f"v_{c}") for c in ("source", "country", "query", "hours"))).distinct()
    ok = (F.coalesce("v_source", F.lit("")) == "") | (F.col("source") == F.col("v_source"))
    ok &= (F.coalesce("v_country", F.lit("")) == "") | F.coalesce(F.array_contains("countries", F.col("v_country")), F.lit(False))
    ok &= contains_query(F.col("v_query"), "title", "summary", "source", "tone")
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("published_at").cast("timestamp"))
    ok &= F.col("v_hours").isNull() | F.coalesce(age <= F.col("v_hours") * 3_600_000_000, F.lit(False))
    if wide.limit(BROADCAST_VIEWS + 1).count() <= BROADCAST_VIEWS:
        met = entries.join(F.broadcast(wide), "layer")
    else:
        parts = max(VIEW_PARTS, int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = wide.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
        met = entries.withColumn("_part", F.pmod(F.xxhash64("entry_id"), F.lit(parts).cast("long"))).join(dealt, ["layer", "_part"])
    return met.where(F.coalesce(ok, F.lit(False))).select("view_id", "entry_id")


def report_order(entries: DataFrame, country: str | None = None, newest: bool = True) -> list[Column]:
    """Order of reports: those of a country first, then by time, missing times as the earliest, then by id."""
    first = [F.desc(F.coalesce(F.array_contains("countries", F.lit(country)), F.lit(False)))] if country else []
    at = F.coalesce(F.unix_micros(F.col("published_at").cast("timestamp")), F.lit(0))
    return [*first, F.desc(at) if newest else F.asc(at), F.asc("entry_id")]


def derived_markers(items: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Rows (category, country, lat, lng, n, level): one marker of each layer and country, at the strongest level.

    items: category, countries (array of country, role, level); an item counts for the first country with the layer's wanted ``role`` (null: any), else for
    its first. coordinates: country, lat, lng; countries without any are left out.
    """
    wanted = F.get(F.filter("countries", lambda c: c["role"] == F.col("role")), F.lit(0))
    rows = items.select("category", F.coalesce(wanted, F.get("countries", F.lit(0))).alias("hit")).select("category", "hit.country", "hit.level")
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, LEVELS)), F.col("level")), F.lit(1)).cast("int")
    groups = rows.where("country IS NOT NULL").groupBy("category", "country").agg(F.count("*").alias("n"), F.max(rank).alias("rank"))
    return groups.join(coordinates, "country").select("category", "country", "lat", "lng", "n", F.element_at(F.array(*map(F.lit, LEVELS)), F.greatest("rank", F.lit(1))).alias("level"))


def country_stats(entries: DataFrame, layers: list[str]) -> DataFrame:
    """Rows (country, reports, and a column for each layer) of entries (countries, layer, reports)."""
    n = F.coalesce("reports", F.lit(1))
    rows = entries.select(F.explode("countries").alias("country"), "layer", n.alias("n"))
    per = [F.coalesce(F.sum(F.when(F.col("layer") == x, F.col("n"))), F.lit(0)).cast("long").alias(x) for x in layers]
    return rows.groupBy("country").agg(F.sum("n").cast("long").alias("reports"), *per)


def visible_markers(markers: DataFrame, stats: DataFrame) -> DataFrame:
    """Markers of countries that the filtered entries name, with their reports. markers: label; stats: country, reports."""
    return markers.drop("reports").join(stats.select("country", "reports"), F.lower(F.trim("label")) == F.col("country")).drop("country")


def source_activity(events: DataFrame, markers: DataFrame) -> DataFrame:
    """Rows (source_id, accepted, markers, domains): accepted events, markers that a source is in, and its domains in order of name.

    events: source_id, domain; markers: marker_id, source_id (a row for each item).
    """
    accepted = events.groupBy("source_id").agg(F.count("*").alias("accepted"), F.sort_array(F.collect_set("domain")).alias("domains"))
    placed = markers.groupBy("source_id").agg(F.count_distinct("marker_id").alias("markers"))
    rows = accepted.join(placed, "source_id", "full")
    return rows.select("source_id", F.coalesce("accepted", F.lit(0)).alias("accepted"), F.coalesce("markers", F.lit(0)).alias("markers"), F.coalesce("domains", F.array().cast("array<string>")).alias("domains"))


def source_kpis(sources: DataFrame) -> DataFrame:
    """One row: sources by runtime, without a region, and the least minutes since a check. sources: runtime, region, last_check_mins."""
    of = lambda s: F.count_if(F.col("runtime") == s)
    return sources.agg(
        F.count("*").alias("total"), of("ok").alias("ok"), of("warn").alias("warn"), of("error").alias("errors"),
        F.count_if(F.coalesce("region", F.lit("")) == "").alias("without_region"), F.min("last_check_mins").alias("last_sweep"),
    )


def source_table(sources: DataFrame, tab: str = "all", methods: tuple[str, ...] = (), configs: tuple[str, ...] = (), query: str = "", sort: str = "name", descending: bool = False) -> DataFrame:
    """Sources that a tab, sets of methods and configurations (empty: all) and a query let through, sorted by a key and id.

    A missing last check sorts as the longest ago. sources: source_id, name, type, method, config, region, domains (array), runtime,
    origin, items, accepted, markers, last_check_mins.
    """
    tabs = {"all": F.lit(True), "errors": F.col("runtime") == "error", "needsLocation": F.coalesce("region", F.lit("")) == "", "personal": F.col("origin") == "personal"}
    runtimes = F.array_position(F.array(*map(F.lit, ("ok", "warn", "error", "idle"))), F.col("runtime"))
    keys = {"lastCheck": F.coalesce(F.col("last_check_mins").cast("double"), F.lit(float("inf"))), "runtime": runtimes, **{k: F.lower(k) for k in ("name", "type", "method")}, **{k: F.col(k) for k in ("items", "accepted", "markers")}}
    rows = sources.where(tabs[tab])
    for column, some in (("method", methods), ("config", configs)):
        rows = rows.where(F.col(column).isin(*some)) if some else rows
    found = F.lit(False)
    for column in (F.col("name"), F.col("type"), F.col("method"), F.col("region"), F.array_join("domains", " ")):
        found = found | F.contains(F.lower(F.coalesce(column, F.lit(""))), F.lit(query.strip().lower()))
    key = keys[sort]
    return rows.where(found).orderBy(key.desc() if descending else key.asc(), "source_id")


def cyber_regions(hits: DataFrame, items: int, most_names: int = 3) -> DataFrame:
    """Rows (region, n, share, target, origin, neutral, dominant, countries) of hits (item_id, region, role, country).

    An item counts once in a region, and once for each role that it gives the region; neutral only if it gives no other. On ties target
    wins, then origin. ``countries`` are the most frequent, by name on ties. A hit may name no country.
    """
    roles = hits.groupBy("item_id", "region").agg(*(F.max((F.col("role") == r).cast("int")).alias(r) for r in ROLES))
    neutral = F.when((F.col("target") == 0) & (F.col("origin") == 0), 1).otherwise(0)
    counts = roles.groupBy("region").agg(F.count("*").alias("n"), F.sum("target").alias("target"), F.sum("origin").alias("origin"), F.sum(neutral).alias("neutral"))
    best = F.greatest(*ROLES)
    dominant = F.when(F.col("target") == best, "target").when(F.col("origin") == best, "origin").otherwise("neutral")
    named = hits.where("country IS NOT NULL").select("item_id", "region", "country").distinct()
    return counts.join(top_names(named, "region", "country", "countries", most_names), "region", "left").select(
        "region", "n", F.round(F.col("n") / max(items, 1), 6).alias("share"), *ROLES, dominant.alias("dominant"), F.coalesce("countries", F.array().cast("array<string>")).alias("countries"))


def top_names(rows: DataFrame, key: str, name: str, out: str, most: int = 3) -> DataFrame:
    """Rows (key, out): the names that occur most often with each key, by name on ties."""
    counts = rows.groupBy(key, name).agg(F.count("*").alias("_n"))
    first = counts.withColumn("_rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("_n"), name))).where(F.col("_rank") <= most)
    ordered = F.array_sort(F.collect_list(F.struct("_rank", name)))
    return first.groupBy(key).agg(F.transform(ordered, lambda x: x[name]).alias(out))


def cyber_sectors(hits: DataFrame, items: int, most_terms: int = 3) -> DataFrame:
    """Rows (sector, n, share, terms) of hits (item_id, sector, term); an item counts once in a sector."""
    counts = hits.groupBy("sector").agg(F.count_distinct("item_id").alias("n"))
    terms = top_names(hits.select("item_id", "sector", "term").distinct(), "sector", "term", "terms", most_terms)
    return counts.join(terms, "sector", "left").select("sector", "n", F.round(F.col("n") / max(items, 1), 6).alias("share"), "terms")


def cyber_totals(items: DataFrame, regions: DataFrame, sectors: DataFrame) -> DataFrame:
    """One row (total, analyzed, without_region): items, those with a region or sector, and those without a region. All: item_id."""
    marks = items.select("item_id").distinct()
    for name, hits in (("r", regions), ("s", sectors)):
        marks = marks.join(hits.select("item_id").distinct().withColumn(name, F.lit(True)), "item_id", "left")
    return marks.agg(F.count("*").alias("total"), F.count_if(F.coalesce("r", "s").isNotNull()).alias("analyzed"), F.count_if(F.col("r").isNull()).alias("without_region"))


def boundary_key(name: Column) -> Column:
    """A place name folded for search: lower case, no accents, letters beyond a-z by their usual spelling."""
    plain = fold(name)
    for char, by in (("ı", "i"), ("ø", "o"), ("æ", "ae"), ("ß", "ss")):
        plain = F.replace(plain, F.lit(char), F.lit(by))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def boundary_search(units: DataFrame, query: str, most: int = 12) -> DataFrame:
    """Units whose name begins with a query of two letters or more: exact ones first, then by level, length and name.

    units: unit_id, name, level and ``key``, the folded name. The query's own wildcards mean themselves.
    """
    wanted = boundary_key(F.lit(query))
    hits = units.where((F.length(wanted) >= 2) & F.col("key").startswith(wanted))
    return hits.orderBy(F.desc(F.col("key") == wanted), "level", F.length("key"), "name", "unit_id").limit(most)


def ndjson_units(lines: DataFrame, schema: str) -> DataFrame:
    """Boundary units of NDJSON lines (value); lines that are no object with an id are left out, the first of an id stays."""
    rows = lines.select(F.from_json("value", schema).alias("u"), F.col("ordinal")).where("u.id IS NOT NULL")
    return rows.groupBy("u.id").agg(F.min_by("u", "ordinal").alias("u")).select("u.*")


def geometry_stats(units: DataFrame) -> DataFrame:
    """Rows (unit_id, vertices, min_lng, min_lat, max_lng, max_lat, lng, lat) of units (unit_id, points: array of lng, lat): box and mean of vertices."""
    flat = units.select("unit_id", F.inline("points"))
    mean = lambda c: F.round(F.avg(c), 6).alias(c)
    return flat.groupBy("unit_id").agg(F.count("*").alias("vertices"), F.min("lng").alias("min_lng"), F.min("lat").alias("min_lat"), F.max("lng").alias("max_lng"), F.max("lat").alias("max_lat"), mean("lng"), mean("lat"))


def export_rows(entries: DataFrame) -> DataFrame:
    """Entries as rows for an export: lists joined by `` | ``, missing texts empty, missing counts 1."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    names = F.when(F.size("source_names") > 0, F.col("source_names")).otherwise(F.array("source"))
    return entries.select(
        "entry_id", *map(text, ("title", "summary", "source", "url", "published_at", "layer", "tone")), F.array_join("countries", " | ").alias("countries"),
        F.coalesce("reports", F.lit(1)).cast("long").alias("reports"), F.coalesce("sources", F.lit(1)).cast("long").alias("sources"), F.array_join(names, " | ").alias("source_names"),
    )


def json_lines(rows: DataFrame) -> DataFrame:
    """Rows with ``line``: all columns as a JSON object, in their order."""
    return rows.withColumn("line", F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}))


def rehydrate(markers: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (marker_id, items): the items that a marker refers to, in its order; missing ones are left out. markers: marker_id, item_ids."""
    refs = markers.select("marker_id", F.posexplode("item_ids").alias("place", "item_id"))
    met = refs.join(items.select("item_id", F.struct(*items.columns).alias("item")), "item_id")
    lists = met.groupBy("marker_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "item"))), lambda x: x["item"]).alias("items"))
    return markers.select("marker_id").join(lists, "marker_id", "left")


def title_case(name: Column) -> Column:
    """``snake_case`` as words that begin with a capital; the rest of a word stays as it is."""
    words = F.split(F.regexp_replace(name, "[_-]+", " "), " ")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, F.lit(2), F.length(w)))), " ")


def date_time(at: Column) -> Column:
    """``yyyy-MM-dd HH:mm UTC``, a dash if missing."""
    return F.coalesce(F.concat(F.date_format(at, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("—"))

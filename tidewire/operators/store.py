"""Dedupe, retention, upserts and exports of collected items."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.functions.text import csv_cell
from tidewire.operators.lineage import cut

DEDUPE_KEYS = ("fingerprint", "upstream_id", "canonical_url")


def _keys(items: DataFrame, *more: str) -> DataFrame:
    """A row (source_id, key, ...) for each key that an item has; a null key or source matches nothing and gives none."""
    named = F.array_compact(F.array(*(F.when(F.col(k).isNotNull(), F.concat(F.lit(f"{k}:"), F.col(k).cast("string"))) for k in DEDUPE_KEYS)))
    return items.where("source_id IS NOT NULL").select("source_id", *more, F.explode(named).alias("key"))


def new_items(batch: DataFrame, known: DataFrame, tombstones: DataFrame, as_of: datetime) -> DataFrame:
    """Items of a batch that share no fingerprint, upstream id or URL with a known item of their source, nor a fingerprint with a live tombstone.

    Inside the batch items are taken by ``ordinal`` (distinct): an item stays unless an earlier one that stayed shares a key,
    so a dropped item shadows nothing. In each round those stay that come first for all their keys among the undecided, and
    those that share a key with them go; rounds end with the longest chain of items that displace one another. Sums by key
    combine before they are shuffled, so one hot key is no hot task.
    """
    live = tombstones.where(F.col("expires_at") > F.lit(as_of)).select("source_id", "fingerprint").distinct()
    keys = _keys(batch, "ordinal")
    gone = batch.join(live, ["source_id", "fingerprint"], "left_semi").select("ordinal")
    gone = cut(gone.union(keys.join(_keys(known).distinct(), ["source_id", "key"], "left_semi").select("ordinal")).distinct())
    left = cut(keys.join(gone, "ordinal", "left_anti"))
    while not left.isEmpty():
        ranked = left.join(left.groupBy("source_id", "key").agg(F.min("ordinal").alias("first")), ["source_id", "key"])
        stay = cut(ranked.groupBy("ordinal").agg(F.bool_and(F.col("ordinal") == F.col("first")).alias("stays")).where("stays").select("ordinal"))
        taken = left.join(stay, "ordinal", "left_semi").select("source_id", "key")
        displaced = cut(left.join(stay, "ordinal", "left_anti").join(taken, ["source_id", "key"], "left_semi").select("ordinal").distinct())
        left = cut(left.join(stay.union(displaced), "ordinal", "left_anti"))
        gone = gone.union(displaced)
    return batch.join(gone, "ordinal", "left_anti").select(batch.columns)


def refresh(items: DataFrame, repeats: DataFrame, as_of: datetime) -> DataFrame:
    """Items with last_seen_at and the longest summary after repeats of them were met.

    A repeat belongs to the item of least item_id that shares a key. items: item_id, source_id, keys, summary, last_seen_at.
    """
    met = _keys(repeats, F.col("summary").alias("_summary"), "ordinal").join(_keys(items, "item_id"), ["source_id", "key"])
    own = met.groupBy("ordinal").agg(F.min("item_id").alias("item_id"), F.first("_summary").alias("_summary"))
    size = F.length(F.coalesce("_summary", F.lit("")))
    best = own.groupBy("item_id").agg(F.max_by("_summary", F.struct(size, -F.col("ordinal"))).alias("_summary"))
    longer = F.length(F.coalesce("_summary", F.lit(""))) > F.length(F.coalesce("summary", F.lit("")))
    rows = items.join(best.withColumn("_met", F.lit(True)), "item_id", "left")
    rows = rows.withColumn("summary", F.when(longer, F.col("_summary")).otherwise(F.col("summary")))
    return rows.withColumn("last_seen_at", F.when(F.col("_met"), F.lit(as_of)).otherwise(F.col("last_seen_at"))).select(items.columns)


def expire(items: DataFrame, as_of: datetime, memory: timedelta = timedelta(days=7)) -> tuple[DataFrame, DataFrame]:
    """Items that stay, and tombstones without content of those that expired."""
    gone = F.col("expires_at") <= F.lit(as_of)
    stones = items.where(gone).select("source_id", "fingerprint", F.lit(as_of + memory).alias("expires_at"))
    return items.where(~F.coalesce(gone, F.lit(False))), stones


def purge(tombstones: DataFrame, as_of: datetime) -> DataFrame:
    """Tombstones that have not expired."""
    return tombstones.where(F.col("expires_at") > F.lit(as_of))


def upsert(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Rows of both tables, those of ``new`` in place of old ones with their key.

    Of a key's rows in ``new`` the one of greatest ``order`` stays; without ``order`` keys there must be distinct.
    """
    if order:
        rest = [c for c in new.columns if c != key]
        new = new.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(new.columns)
    return old.join(new.select(key), key, "left_anti").select(new.columns).unionByName(new)


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The greatest row of each key by ``order``, values that have no ties together. It combines before the shuffle, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*(c for c in rows.columns if c != key)), F.struct(*order)).alias("_row")).select(key, "_row.*").select(rows.columns)


def csv_lines(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with ``line``: all columns as quoted cells."""
    return rows.withColumn("line", F.concat_ws(",", *(csv_cell(F.col(c)) for c in columns)))


def write_csv(rows: DataFrame, columns: list[str], path: str) -> None:
    """CSV files with CRLF line ends, all cells quoted and quotes doubled; each file starts with a byte order mark and the header."""
    header = ",".join('"' + c.replace('"', '""') + '"' for c in columns)

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            got = [f"{x}\r" for x in batch.column("line").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([f"\ufeff{header}\r"] * first + got, pa.string())], ["value"])
            first = False

    csv_lines(rows, columns).select("line").mapInArrow(lines, "value string").write.text(path)


def geojson_features(rows: DataFrame, properties: list[str], countries: DataFrame | None = None) -> DataFrame:
    """Rows with ``feature``: a GeoJSON point; rows without coordinates take their country's, or are left out.

    countries: country, country_lat, country_lng, one row for each.
    """
    if countries is not None:
        rows = rows.join(countries, "country", "left").withColumn("lat", F.coalesce("lat", "country_lat")).withColumn("lng", F.coalesce("lng", "country_lng")).drop("country_lat", "country_lng")
    point = F.struct(F.lit("Point").alias("type"), F.array("lng", "lat").alias("coordinates"))
    feature = F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*properties).alias("properties")))
    return rows.where("lat IS NOT NULL AND lng IS NOT NULL").withColumn("feature", feature)


def violations(state: DataFrame, items: DataFrame) -> DataFrame:
    """Rows (rule, key) that break a constraint of the data model; expected to be empty."""
    bounds = ~((F.col("min_s") <= F.col("base_s")) & (F.col("base_s") <= F.col("max_s")))
    place = F.col("eligible") & (F.col("lat").isNull() | F.col("lng").isNull())
    out = F.coalesce(~F.col("lat").between(-90, 90) | ~F.col("lng").between(-180, 180), F.lit(False))
    rules = F.array_compact(F.array(F.when(place, "eligible_without_place"), F.when(out, "place_out_of_range")))
    return state.where(bounds).select(F.lit("poll_bounds").alias("rule"), F.col("source_id").cast("string").alias("key")).unionByName(
        items.select(F.explode(rules).alias("rule"), F.col("item_id").cast("string").alias("key")))

"""Runs, source states and payloads: totals, due sources, freshness, coverage, slots and the next poll."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Due sources taken at once; share of fresh sources below which a payload is partial; seconds after which a
#: current payload is built anew.
DUE, FRESH_SHARE, REBUILD_SECONDS = 40, 0.8, 900
#: Fixed values of the scheduler: shrink after many and few new items, growth from so many unchanged polls on, longest
#: backoff and most doublings, jitter, and the share of a daily budget that may be used.
SHRINK, SHRINK_LITTLE, GROW, UNCHANGED, MAX_BACKOFF, DOUBLINGS, JITTER, BUDGET_SHARE = 0.7, 0.85, 1.5, 3, 6 * 3600, 6, 0.1, 0.8


def nearest(x: Column) -> Column:
    """Rounded half up, for negative numbers too."""
    return F.floor(x + 0.5).cast("long")


def run_results(results: DataFrame) -> DataFrame:
    """A row for each run: attempted, succeeded, new_items, duplicates, duration_ms and status.

    results: run_id, ok, new_items, duplicates, duration_ms. A run is a success if all its sources (or none) were tried with success,
    partial if some were, else failed.
    """
    rows = results.groupBy("run_id").agg(
        F.count("*").alias("attempted"), F.count_if(F.coalesce("ok", F.lit(False))).alias("succeeded"),
        *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("new_items", "duplicates", "duration_ms")),
    )
    status = F.when(F.col("succeeded") == F.col("attempted"), "success").when(F.col("succeeded") > 0, "partial").otherwise("failed")
    return rows.withColumn("status", status)


def run_totals(runs: DataFrame) -> DataFrame:
    """One row over all runs that tried a source: counts by status, items, and the shortest and longest run."""
    of = lambda s: F.count_if(F.col("status") == s).alias(s)
    return runs.where("attempted > 0").agg(
        F.count("*").alias("runs"), of("success"), of("partial"), of("failed"), F.coalesce(F.sum("new_items"), F.lit(0)).cast("long").alias("new_items"),
        F.min("duration_ms").alias("shortest_ms"), F.max("duration_ms").alias("longest_ms"),
    )


def latency(samples: DataFrame, key: str) -> DataFrame:
    """Rows (key, n, p50, p95, longest): interpolated and rounded quantiles of ``ms``."""
    p = lambda q: nearest(F.percentile("ms", F.lit(q)))
    return samples.where("ms IS NOT NULL").groupBy(key).agg(F.count("*").alias("n"), p(0.5).alias("p50"), p(0.95).alias("p95"), nearest(F.max("ms")).alias("longest"))


def due_sources(state: DataFrame, as_of: datetime, most: int = DUE) -> DataFrame:
    """The ``most`` enabled sources whose time has come first, out of backoff; ties by id. state: source_id, enabled, next_poll_at, backoff_until."""
    now = F.lit(as_of)
    due = F.col("enabled") & (F.col("next_poll_at") <= now) & (F.col("backoff_until").isNull() | (F.col("backoff_until") <= now))
    return state.where(due).orderBy("next_poll_at", "source_id").limit(most)


def due_by_host(due: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Rows (host, n, first_source) of due sources by their endpoint's host; unknown without a readable one. endpoints: source_id, endpoint."""
    host = F.coalesce(F.lower(F.nullif(F.regexp_extract(F.coalesce("endpoint", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1), F.lit(""))), F.lit("unknown"))
    return due.join(endpoints, "source_id", "left").groupBy(host.alias("host")).agg(F.count("*").alias("n"), F.min("source_id").alias("first_source"))


def with_freshness(state: DataFrame, as_of: datetime) -> DataFrame:
    """Add ``is_fresh``: the last success is within two poll intervals."""
    age = F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("last_success_at").cast("timestamp"))
    return state.withColumn("is_fresh", F.coalesce(age < 2_000_000 * F.col("interval_s"), F.lit(False)))


def coverage(state: DataFrame, expected: DataFrame, items: DataFrame, as_of: datetime, critical: list[str] | None = None) -> DataFrame:
    """One row: expected, enabled, fresh and filled sources, the payload's state and the reasons for a partial one.

    state: source_id, enabled, last_success_at, interval_s; expected: source_id; items: source_id. ``critical`` names sources
    whose delay is a reason of its own, in their order.
    """
    known = with_freshness(state.where("enabled"), as_of).join(expected.distinct(), "source_id", "left_semi")
    filled = items.select("source_id").distinct().withColumn("filled", F.lit(True))
    rows = known.select("source_id", "is_fresh").join(filled, "source_id", "left")
    late = [F.bool_or((F.col("source_id") == F.lit(c)) & ~F.col("is_fresh")).alias(f"_late{i}") for i, c in enumerate(critical or [])]
    counts = rows.agg(F.count("*").alias("enabled"), F.count_if("is_fresh").alias("fresh"), F.count_if("filled").alias("filled"), *late)
    total = expected.select(F.count_distinct("source_id").alias("expected"))
    one = total.join(F.broadcast(counts))  # two tables of one row
    reasons = [F.when(F.col("enabled") < F.col("expected"), F.concat(F.lit("enabled_"), F.col("enabled"), F.lit("_of_"), F.col("expected")))]
    reasons += [F.when(F.col(f"_late{i}"), F.lit(f"critical_overdue_{c}")) for i, c in enumerate(critical or [])]
    reasons += [F.when((F.col("enabled") > 0) & (F.col("fresh") / F.greatest("enabled", F.lit(1)) < FRESH_SHARE), F.lit("fresh_sources_below_80pct"))]
    out = one.withColumn("reasons", F.array_compact(F.array(*reasons)))
    return out.select("expected", "enabled", "fresh", "filled", F.when(F.size("reasons") == 0, "fresh").otherwise("partial").alias("state"), "reasons")


def swap_slots(slots: DataFrame, payloads: DataFrame) -> DataFrame:
    """Slots after new payloads: the new one is current, the current one previous, the previous one goes; other types stay.

    Both tables: payload_type, generated_at, body; slots also slot. A type has one new payload at most. Write the result as a
    new version of the table.
    """
    touched = payloads.select("payload_type").distinct()
    moved = slots.join(touched, "payload_type", "left_semi").where("slot = 'current'").withColumn("slot", F.lit("previous"))
    return slots.join(touched, "payload_type", "left_anti").unionByName(moved).unionByName(payloads.withColumn("slot", F.lit("current")).select(slots.columns))


def served(slots: DataFrame) -> DataFrame:
    """Each type's payload to serve: the current one, else the previous one."""
    rank = F.when(F.col("slot") == "current", 0).otherwise(1)
    rest = [c for c in slots.columns if c != "payload_type"]
    return slots.where(F.col("slot").isin("current", "previous")).groupBy("payload_type").agg(F.min_by(F.struct(*rest), rank).alias("_row")).select("payload_type", "_row.*")


def to_rebuild(slots: DataFrame, fresh_items: DataFrame, types: DataFrame, as_of: datetime) -> DataFrame:
    """Rows (payload_type) to build anew: with new items, or whose current payload is missing or older than REBUILD_SECONDS.

    fresh_items: payload_type of new items; types: payload_type, all that there are.
    """
    young = slots.where((F.col("slot") == "current") & (F.col("generated_at") > F.lit(as_of - timedelta(seconds=REBUILD_SECONDS)))).select("payload_type")
    idle = young.join(fresh_items.select("payload_type").distinct(), "payload_type", "left_anti")
    return types.select("payload_type").distinct().join(idle, "payload_type", "left_anti")


def bootstrap(state: DataFrame, profiles: DataFrame, as_of: datetime) -> DataFrame:
    """State rows that sources without one start with: due at once, at their base interval. profiles: source_id, base_s."""
    new = profiles.join(state.select("source_id"), "source_id", "left_anti")
    return new.select("source_id", F.col("base_s").alias("interval_s"), F.lit(0).cast("long").alias("streak"), F.lit(0).cast("long").alias("failures"), F.lit(as_of).alias("next_poll_at"))


def toggle_personal(state: DataFrame, enabled: DataFrame, prefix: str = "personal-") -> DataFrame:
    """``enabled`` of personal sources is whether they are listed; other sources keep theirs. enabled: source_id."""
    listed = enabled.select("source_id").distinct().withColumn("_listed", F.lit(True))
    rows = state.join(listed, "source_id", "left")
    return rows.withColumn("enabled", F.when(F.col("source_id").startswith(prefix), F.coalesce("_listed", F.lit(False))).otherwise(F.col("enabled"))).select(state.columns)


def fetch_outcome(status: Column, code: Column, unmodified: Column, new_items: Column) -> Column:
    """Outcome of one fetch for the scheduler: ``new_items``, ``unchanged``, ``not_modified``, or ``error:`` and its category.

    ``code`` is the fetcher's own error where no answer came; ``status`` is the answer's.
    """
    return (
        F.when(code.isNotNull(), F.when(code.isin("timeout", "network_error", "unexpected_error"), "error:temporary").otherwise("error:blocked"))
        .when(unmodified, "not_modified").when(status == 429, "error:rate_limited").when(status == 403, "error:blocked").when(~status.between(200, 299), "error:temporary")
        .when(new_items > 0, "new_items").otherwise("unchanged")
    )


def signal_quality(runtime: Column, items: Column, accepted: Column, markers: Column) -> Column:
    """How a source does: by its runtime, what of its items is accepted, and whether it has markers."""
    return (
        F.when(runtime == "error", "Needs review").when(items == 0, "Unrated").when(accepted == 0, "Low yield")
        .when((runtime == "ok") & (accepted / items >= 0.25) & (markers > 0), "Strong now").otherwise("Usable now")
    )


def changed(fetches: DataFrame, known: DataFrame) -> DataFrame:
    """Fetches whose body is new: not answered as unmodified, and neither etag nor time of change as known. fetches, known: source_id, etag, last_modified."""
    old = known.select("source_id", F.col("etag").alias("_etag"), F.col("last_modified").alias("_modified"))
    same = (F.col("status") == 304) | (F.col("etag") == F.col("_etag")) | (F.col("etag").isNull() & (F.col("last_modified") == F.col("_modified")))
    return fetches.join(old, "source_id", "left").where(~F.coalesce(same, F.lit(False))).select(fetches.columns)


def next_poll(attempts: DataFrame) -> DataFrame:
    """Add the scheduler's decision to one attempt a row: interval_s, delay_s, reason, streak, failures.

    attempts: state (interval_s, streak, failures, observed_s, ttl_s, max_age_s), profile (min_s, max_s, daily_budget), outcome
    (ok, new_items, parsed_items, rate_limited, retry_after_s) and ``chance`` in [0, 1) for the jitter.

    A failure waits the interval doubled for each failure, up to MAX_BACKOFF or what the server asks, and keeps the cadence. New items shorten the interval,
    unchanged polls lengthen it from the third on; half of the observed rhythm pulls it; hints and then the budget bound it.
    """
    c, low, high = F.col, F.col("min_s"), F.col("max_s")
    clamp = lambda x, a=low, b=high: F.least(b, F.greatest(a, x))
    start = clamp(c("interval_s"))
    fresh = c("new_items") > 0
    ratio = F.when(c("parsed_items") > 0, c("new_items") / c("parsed_items")).otherwise(0.0)
    streak = F.when(~c("ok"), c("streak")).when(fresh, 0).otherwise(c("streak") + 1)
    failures = F.when(c("ok"), 0).otherwise(c("failures") + 1)
    moved = F.when(fresh, clamp(nearest(start * F.when(ratio >= 0.5, SHRINK).otherwise(SHRINK_LITTLE)))).when(streak >= UNCHANGED, clamp(nearest(start * GROW))).otherwise(start)
    pulled = F.when(c("observed_s") > 0, nearest((moved + clamp(nearest(c("observed_s") / 2))) / 2)).otherwise(moved)
    hint = F.greatest(F.when(c("ttl_s") > 0, c("ttl_s")), F.when(c("max_age_s") > 0, c("max_age_s")))
    held = F.when(pulled < hint, clamp(hint)).otherwise(pulled)
    quota = F.when(c("daily_budget") > 0, F.ceil(86_400 / (c("daily_budget") * BUDGET_SHARE)))
    final = F.when(held < quota, clamp(quota, low, F.greatest(high, quota))).otherwise(held)
    reason = F.when(~c("ok"), "backoff").when(held < quota, "quota").when(pulled < hint, "rss_hint").otherwise("observed_cadence")
    wait = F.least(F.lit(MAX_BACKOFF), F.greatest(start, low) * F.pow(F.lit(2), F.least(failures, F.lit(DOUBLINGS))))
    wait = F.when(c("rate_limited") & (c("retry_after_s") > 0), F.greatest(wait, c("retry_after_s"))).otherwise(wait)
    interval = F.when(c("ok"), final).otherwise(start)
    delay = F.when(c("ok"), final).otherwise(wait)
    return attempts.withColumns({
        "_interval": interval.cast("long"), "_delay": F.greatest(F.lit(1), nearest(delay * (1 + (c("chance") * 2 - 1) * JITTER))).cast("long"), "reason": reason,
        "_streak": streak.cast("long"), "_failures": failures.cast("long"),
    }).drop("interval_s", "streak", "failures").withColumnsRenamed({"_interval": "interval_s", "_delay": "delay_s", "_streak": "streak", "_failures": "failures"})


def heat_weight(reports: Column) -> Column:
    """Weight of a place on a heat map: 0.15 for one report to 1 for fifty, linear between."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.15), 0.15 + (reports - 1) / 49 * 0.85))


def map_clusters(markers: DataFrame, zoom: int, radius: int = 54) -> DataFrame:
    """Rows (cell_x, cell_y, n, reports): markers in one cell of ``radius`` pixels at a zoom level of the web mercator map."""
    pixels = 512 * 2**zoom
    rad = F.radians(F.least(F.lit(85.051129), F.greatest(F.lit(-85.051129), F.col("lat"))))
    x = F.floor((F.col("lng") + 180) / 360 * pixels / radius)
    y = F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / math.pi) / 2 * pixels / radius)
    placed = markers.where("lat IS NOT NULL AND lng IS NOT NULL")
    return placed.groupBy(x.cast("long").alias("cell_x"), y.cast("long").alias("cell_y")).agg(F.count("*").alias("n"), F.sum(F.coalesce("reports", F.lit(1))).cast("long").alias("reports"))


def top_markers(markers: DataFrame, most: int = 120) -> DataFrame:
    """All markers if there are at most ``most``, else those of highest score, the first by ``place`` on ties. markers: place, score."""
    return markers.orderBy(F.desc_nulls_last("score"), "place").limit(most)


def level_rollup(units: DataFrame) -> DataFrame:
    """Rows (level, n, countries) of boundary units. units: level, country."""
    return units.groupBy("level").agg(F.count("*").alias("n"), F.count_distinct("country").alias("countries"))


def first_rows(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key by ``order`` (distinct), combined before the shuffle; rows with a null key all stay."""
    rest = [c for c in rows.columns if c != key]
    named = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*").select(rows.columns)
    return named.unionByName(rows.where(F.col(key).isNull()))


def seen_ids(old: DataFrame, new: DataFrame, most: int = 600) -> DataFrame:
    """Rows (view_id, entry_id, at): each view's last ``most`` seen entries after new ones. Repeats keep their latest place; ties by id."""
    rows = old.unionByName(new).groupBy("view_id", "entry_id").agg(F.max("at").alias("at"))
    order = W.partitionBy("view_id").orderBy(F.desc("at"), F.desc("entry_id"))
    return rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most).drop("_rank")


#: Fixed names: columns that an attempt replaces, and those that it replaces only by a value.
REPLACED = ("interval_s", "reason", "streak", "failures", "http_status", "error", "duration_ms", "new_items")
KEPT = ("etag", "last_modified", "ttl_s", "max_age_s", "observed_s")


def record_attempts(state: DataFrame, attempts: DataFrame) -> DataFrame:
    """State of sources after their attempts; a source without one stays as it is, and an attempt of an unknown source adds none.

    attempts: source_id, at, ok, changed, delay_s, and the columns of REPLACED and KEPT. The first five and REPLACED are taken from a source's
    last attempt by ``at`` (distinct for a source); success, change of content and each of KEPT from its last attempt that has one. A wait
    is a backoff if its reason is ``backoff``. state: source_id, attempted_at, succeeded_at, changed_at, next_poll_at, backoff_until, updated_at,
    REPLACED and KEPT; further columns stay. All maxima combine before the shuffle.
    """
    last = lambda c, when=None: F.max_by(c, F.when(when, F.col("at")) if when is not None else F.col("at")).alias(f"_{c}")
    seen = attempts.where("at IS NOT NULL").groupBy("source_id").agg(
        F.max("at").alias("_at"), F.max(F.when(F.col("ok"), F.col("at"))).alias("_ok_at"), F.max(F.when(F.col("changed"), F.col("at"))).alias("_changed_at"),
        last("delay_s"), *(last(c) for c in REPLACED), *(last(c, F.col(c).isNotNull()) for c in KEPT),
    )
    tried, wait = F.col("_at").isNotNull(), F.col("_at") + F.make_dt_interval(secs=F.col("_delay_s"))
    values = {
        "attempted_at": F.coalesce("_at", "attempted_at"), "succeeded_at": F.coalesce("_ok_at", "succeeded_at"), "changed_at": F.coalesce("_changed_at", "changed_at"),
        "next_poll_at": F.when(tried, wait).otherwise(F.col("next_poll_at")), "backoff_until": F.when(~tried, F.col("backoff_until")).when(F.col("_reason") == "backoff", wait),
        "updated_at": F.coalesce("_at", "updated_at"),
    } | {c: F.when(tried, F.col(f"_{c}")).otherwise(F.col(c)) for c in REPLACED} | {c: F.coalesce(f"_{c}", c) for c in KEPT}
    return state.join(seen, "source_id", "left").select(*(values[c].alias(c) if c in values else F.col(c) for c in state.columns))

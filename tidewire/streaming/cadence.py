"""Poll cadence of sources as a keyed state, and rolling density of a stream."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewire.operators.health import BUDGET_SHARE, DOUBLINGS, GROW, JITTER, MAX_BACKOFF, SHRINK, SHRINK_LITTLE, UNCHANGED

#: Bounds of the cadence of sources without a profile, and the interval that they start with, in seconds.
SHORTEST, LONGEST, START = 300, 86_400, 900
OUTPUT = "source_id string, interval_s long, streak long, failures long, delay_s long, reason string"
STATE = "interval_s double, streak long, failures long"
#: Columns of polls that may be missing, and what stands for them: a source's profile, hints of the server and its rhythm, and
#: a number in [0, 1) for the jitter.
OPTIONAL = {"min_s": float(SHORTEST), "max_s": float(LONGEST), "base_s": float(START), "daily_budget": 0.0, "observed_s": 0.0, "ttl_s": 0.0, "max_age_s": 0.0, "rate_limited": 0.0, "retry_after_s": 0.0, "chance": 0.5}


def _round(x: float) -> int:
    return math.floor(x + 0.5)


def next_interval(
    interval: float, streak: int, failures: int, ok: bool, new: int, parsed: int, low: float = SHORTEST, high: float = LONGEST, observed: float = 0, hint: float = 0, budget: float = 0
) -> tuple[float, int, int]:
    """Cadence after one poll: shorter after new items, longer from the third poll without any, kept after a failure.

    Half of the observed rhythm pulls it; a hint of the server and then a daily budget of requests bound it from below.
    """
    start = min(high, max(low, interval))
    if not ok:
        return start, streak, failures + 1
    if new > 0:
        streak, start = 0, min(high, max(low, _round(start * (SHRINK if parsed and new / parsed >= 0.5 else SHRINK_LITTLE))))
    else:
        streak += 1
        start = min(high, max(low, _round(start * GROW))) if streak >= UNCHANGED else start
    if observed > 0:
        start = _round((start + min(high, max(low, _round(observed / 2)))) / 2)
    if start < hint:
        start = min(high, max(low, hint))
    quota = math.ceil(86_400 / (budget * BUDGET_SHARE)) if budget > 0 else 0
    return min(max(high, quota), max(low, quota)) if start < quota else start, streak, 0


def delay(interval: float, failures: int, low: float, retry_after: float = 0, chance: float = 0.5) -> int:
    """Seconds to the next poll, with jitter: the interval, or after failures its backoff or what the server asks for."""
    wait = interval
    if failures:
        wait = max(min(MAX_BACKOFF, max(interval, low) * 2 ** min(failures, DOUBLINGS)), retry_after)
    return max(1, _round(wait * (1 + (chance * 2 - 1) * JITTER)))


def backoff_seconds(interval: Column, failures: Column) -> Column:
    """Wait after failures: doubled for each up to the sixth, at most six hours; 0 without failures."""
    return F.when(failures > 0, F.least(F.lit(MAX_BACKOFF), interval * F.pow(F.lit(2), F.least(failures, F.lit(DOUBLINGS))))).otherwise(0).cast("long")


def _advance(key: tuple, polls: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(list(polls)).sort_values(["at", "poll_id"]).fillna(OPTIONAL)
    interval, streak, failures = state.get if state.exists else (float(rows.base_s.iloc[0]), 0, 0)
    wait, reason = 0, ""
    for r in rows.itertuples():
        hint = max(r.ttl_s, r.max_age_s)
        args = (interval, streak, failures, bool(r.ok), int(r.new_items), int(r.parsed_items), r.min_s, r.max_s, r.observed_s)
        free, held = next_interval(*args), next_interval(*args, hint)
        interval, streak, failures = next_interval(*args, hint, r.daily_budget)
        reason = "backoff" if not r.ok else "quota" if interval != held[0] else "rss_hint" if held != free else "observed_cadence"
        wait = delay(interval, failures, r.min_s, r.retry_after_s if r.rate_limited else 0, r.chance)
    state.update((float(interval), streak, failures))
    yield pd.DataFrame({"source_id": [key[0]], "interval_s": [_round(interval)], "streak": [streak], "failures": [failures], "delay_s": [wait], "reason": [reason]})


def cadence(polls: DataFrame) -> DataFrame:
    """A row for each source and micro-batch: its cadence, next poll and the reason after the batch's polls in order of time.

    polls (a stream): source_id, poll_id, at, ok, new_items, parsed_items, and any of OPTIONAL. A source's polls of one batch are held together;
    they are bounded by the shortest interval.
    """
    for name, value in OPTIONAL.items():
        polls = polls.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(value)) if name in polls.columns else F.lit(value))
    return polls.groupBy("source_id").applyInPandasWithState(_advance, OUTPUT, STATE, "update", GroupStateTimeout.NoTimeout)


def rolling_density(events: DataFrame, late: str = "48 hours", size: str = "48 hours", slide: str = "6 hours") -> DataFrame:
    """Counts by sliding window and domain of an event stream; events later than ``late`` are dropped by the watermark."""
    timed = events.withColumn("published_at", F.col("published_at").cast("timestamp")).withWatermark("published_at", late)
    return timed.where("accepted").groupBy(F.window("published_at", size, slide), "primary_domain").agg(F.count("*").alias("n"))


def first_seen(items: DataFrame, late: str = "7 days") -> DataFrame:
    """A stream without repeats of (source_id, fingerprint) within the dedupe memory."""
    return items.withWatermark("collected_at", late).dropDuplicatesWithinWatermark(["source_id", "fingerprint"])

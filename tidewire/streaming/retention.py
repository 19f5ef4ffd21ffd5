"""Dedupe and retention of collected items as one keyed state of a stream, with timers for expiry and for the memory after it."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewire.operators.store import DEDUPE_KEYS

#: How long an item is kept, and how long its fingerprint is remembered without content after that.
LIFE, MEMORY = timedelta(hours=48), timedelta(days=7)
CHANGES = "source_id string, action string, item_id long, fingerprint string, summary string, at timestamp, expires_at timestamp"
_OUT = CHANGES.replace("timestamp", "long")  # milliseconds
_HELD = "item_id long, expires long, forgotten long"
_ITEM = "fingerprint string, keys array<string>, summary string, expires long"


def _change(source: str, action: str, item_id: int, fingerprint: str | None, summary: str | None, at: int, expires: int | None) -> Row:
    return Row(source_id=source, action=action, item_id=item_id, fingerprint=fingerprint, summary=summary, at=at, expires_at=expires)


class Retention(StatefulProcessor):
    """State of one source: what holds each key, the live items, and the items that each timer is for."""

    def __init__(self, life: timedelta = LIFE, memory: timedelta = MEMORY):
        self.life, self.memory = int(life.total_seconds() * 1000), int(memory.total_seconds() * 1000)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "key string", _HELD)
        self.items = handle.getMapState("items", "item_id long", _ITEM)
        self.due = handle.getMapState("due", "at long", "item_ids array<long>")

    def _remind(self, at: int, item_id: int) -> None:
        waiting = list(self.due.getValue((at,))[0]) if self.due.containsKey((at,)) else []
        self.due.updateValue((at,), (waiting + [item_id],))
        if not waiting:
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        source = key[0]
        for row in sorted(rows, key=lambda r: (r.at, r.ordinal)):
            now = row.at
            keys = [f"{name}:{row[name]}" for name in DEDUPE_KEYS if row[name] is not None]
            holders = [self.held.getValue((k,)) for k in keys if self.held.containsKey((k,))]
            live = [h.item_id for h in holders if now < h.expires]
            if live:
                yield self._met(source, min(live), row)
            elif not any(k.startswith("fingerprint:") and self.held.containsKey((k,)) and now < self.held.getValue((k,)).forgotten for k in keys):
                expires = now + self.life
                for k in keys:
                    self.held.updateValue((k,), (row.item_id, expires, expires + self.memory if k.startswith("fingerprint:") else expires))
                self.items.updateValue((row.item_id,), (row.fingerprint, keys, row.summary, expires))
                self._remind(expires, row.item_id)
                yield _change(source, "insert", row.item_id, row.fingerprint, row.summary, now, expires)

    def _met(self, source: str, item_id: int, row: Row) -> Row:
        fingerprint, keys, summary, expires = self.items.getValue((item_id,))
        if len(row.summary or "") > len(summary or ""):
            summary = row.summary
            self.items.updateValue((item_id,), (fingerprint, list(keys), summary, expires))
        return _change(source, "refresh", item_id, fingerprint, summary, row.at, expires)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        at = expiredTimerInfo.getExpiryTimeInMs()
        for item_id in self.due.getValue((at,))[0] if self.due.containsKey((at,)) else []:
            fingerprint, keys, _, expires = self.items.getValue((item_id,))
            mine = [k for k in keys if self.held.containsKey((k,)) and self.held.getValue((k,)).item_id == item_id]
            stone = at == expires and fingerprint is not None  # a later item may hold the fingerprint by now: both are told
            for k in mine:
                if not (stone and k.startswith("fingerprint:")):
                    self.held.removeKey((k,))
            if stone:
                self.items.updateValue((item_id,), (fingerprint, [f"fingerprint:{fingerprint}"], None, expires))
                self._remind(expires + self.memory, item_id)
                yield _change(key[0], "tombstone", item_id, fingerprint, None, at, expires + self.memory)
            else:
                self.items.removeKey((item_id,))
                yield _change(key[0], "purge" if at > expires else "expire", item_id, fingerprint, None, at, None)
        self.due.removeKey((at,))

    def close(self) -> None:
        pass


def retained(items: DataFrame, late: str = "1 hour", life: timedelta = LIFE, memory: timedelta = MEMORY) -> DataFrame:
    """Changes of the item store by a stream of items: ``insert``, ``refresh``, ``tombstone``, ``expire`` (an item without fingerprint) and ``purge``.

    items (a stream): source_id, item_id (distinct), ordinal, fingerprint, upstream_id, canonical_url, summary, collected_at; further columns
    are not read. An item that shares any of its three keys with a live item of its source refreshes the live one of least item_id, whose
    summary becomes the longer one; it inserts nothing and holds no key. One whose fingerprint is still remembered is dropped. Rows without
    source or time are dropped, null keys match nothing, and an item without any key is always new.

    Time is ``collected_at`` in whole milliseconds: expiry is exact for each row even before a timer has fired, and replays give the same changes. State TTL counts
    the machine's clock and cannot be used with event time; timers behind the watermark delete instead. A source's rows of one micro-batch
    are sorted in one task, so bound the batch (``maxFilesPerTrigger``, ``maxOffsetsPerTrigger``); its state lies in RocksDB, not in memory.
    Needs ``spark.sql.streaming.stateStore.providerClass`` to name the RocksDB provider.
    """
    columns = ("source_id", "item_id", "ordinal", *DEDUPE_KEYS, "summary", "collected_at")
    rows = items.select(*columns).where("source_id IS NOT NULL AND collected_at IS NOT NULL")
    rows = rows.withColumn("source_id", F.col("source_id").cast("string")).withColumn("at", F.unix_millis("collected_at")).withWatermark("collected_at", late)
    changes = rows.groupBy("source_id").transformWithState(Retention(life, memory), _OUT, "Append", "EventTime")
    return changes.withColumn("at", F.timestamp_millis("at")).withColumn("expires_at", F.timestamp_millis("expires_at"))

import os
import random
from datetime import datetime, timedelta

from tidewire.operators.store import DEDUPE_KEYS
from tidewire.streaming import retention

LIFE, MEMORY, START = timedelta(hours=4), timedelta(hours=10), datetime(2024, 1, 1)
SCHEMA = "source_id string, item_id long, ordinal long, fingerprint string, upstream_id string, canonical_url string, summary string, collected_at timestamp, extra string"


def model(rows):
    """Inserts and refreshes one by one, from a plain list of all items so far."""
    kept, out = [], []
    for r in sorted((r for r in rows if r[0] is not None and r[7] is not None), key=lambda r: (r[7], r[2])):
        now, mine = r[7], dict(zip(DEDUPE_KEYS, r[3:6], strict=True))
        shared = [k for k in kept if k["source"] == r[0] and now < k["at"] + LIFE and any(v is not None and k["keys"][n] == v for n, v in mine.items())]
        known = [k for k in kept if k["source"] == r[0] and mine["fingerprint"] is not None and k["keys"]["fingerprint"] == mine["fingerprint"] and now < k["at"] + LIFE + MEMORY]
        if shared:
            first = min(shared, key=lambda k: k["id"])
            first["summary"] = max(first["summary"], r[6], key=lambda s: len(s or ""))
            out.append(("refresh", first["id"], first["summary"], now))
        elif not known:
            kept.append({"source": r[0], "at": now, "keys": mine, "id": r[1], "summary": r[6]})
            out.append(("insert", r[1], r[6], now))
    return sorted(out, key=str), kept


def run(spark, folder, batches):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for i, batch in enumerate(batches):
            path = f"{folder}/in/b{i}"
            spark.createDataFrame(batch, SCHEMA).coalesce(1).write.parquet(path)
            for name in os.listdir(path):
                os.utime(f"{path}/{name}", (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in/*")
        job = retention.retained(stream, "0 seconds", LIFE, MEMORY).writeStream.option("checkpointLocation", f"{folder}/ck").format("parquet").option("path", f"{folder}/out").trigger(availableNow=True).start()
        job.awaitTermination()
        return spark.read.schema(retention.CHANGES).parquet(f"{folder}/out").collect()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_like_a_list_of_items(spark, tmp_path):
    rng, rows = random.Random(4), []
    for i in range(120):
        pick = lambda p, n: rng.choice([None, f"{p}{rng.randrange(n)}"])  # noqa: E731, B023
        at = START + timedelta(minutes=20 * i + rng.randrange(20))
        rows.append((rng.choice(["hot", "hot", "b"]), i, i, pick("f", 12), pick("u", 12), pick("c", 12), "x" * rng.randrange(6), at, "e"))
    rows += [(None, 900, 900, "f1", None, None, "s", rows[0][7], "e"), ("b", 901, 901, "f1", None, None, None, None, "e")]
    batches = [rows[-2:] + rows[:40], rows[40:80], rows[80:120], *([("late", 990 + i, 990 + i, None, None, None, None, START + timedelta(days=i), "e")] for i in (8, 9))]
    got = run(spark, str(tmp_path), batches)
    expected, kept = model([r for b in batches for r in b])
    changes = sorted(((r.action, r.item_id, r.summary, r.at) for r in got if r.action in ("insert", "refresh")), key=str)
    assert changes == expected and sum(c[0] == "refresh" for c in changes) > 10
    stones = {(r.item_id, r.fingerprint, r.expires_at) for r in got if r.action == "tombstone"}
    wanted = {(k["id"], k["keys"]["fingerprint"], k["at"] + LIFE + MEMORY) for k in kept if k["id"] < 900 and k["keys"]["fingerprint"]}
    assert stones == wanted
    assert all(r.summary is None for r in got if r.action in ("tombstone", "expire", "purge"))
    assert {r.item_id for r in got if r.action == "expire" and r.item_id < 900} == {k["id"] for k in kept if k["id"] < 900 and not k["keys"]["fingerprint"]}
    assert {r.item_id for r in got if r.action == "purge"} == {x[0] for x in stones}

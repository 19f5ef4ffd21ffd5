from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewire.operators import health
from tidewire.operators.publish import Published


def rows_of(df):
    return sorted(map(tuple, df.collect()))


def test_versions_and_a_failed_write(spark, tmp_path):
    table = Published(spark, str(tmp_path))
    assert table.read() is None and table.commits().count() == 0
    one = spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string")
    assert table.publish(one) == 1 and rows_of(table.read()) == [(1, "a"), (2, "b")] and table.read(1) is None
    assert table.merge(spark.createDataFrame([(2, "c"), (3, None), (2, "b")], "k long, v string"), "k", "v") == 2
    assert rows_of(table.read(1)) == [(1, "a"), (2, "b")]
    now = sorted(table.read().collect())
    assert [tuple(r) for r in now] == [(1, "a"), (2, "c"), (3, None)]
    broken = table.read().withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="lost"):
        table.publish(broken)
    assert [tuple(r) for r in sorted(Published(spark, str(tmp_path)).read().collect())] == [(1, "a"), (2, "c"), (3, None)]
    assert table.publish(one.limit(0)) == 3 and table.read().count() == 0
    assert [r.version for r in table.superseded().collect()] == [1]


def test_a_stream_merges_each_batch_once(spark, tmp_path):
    table, schema = Published(spark, f"{tmp_path}/t"), "k long, v string"
    spark.createDataFrame([(1, "a"), (1, "b"), (2, "x")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/1")
    def run():
        spark.readStream.schema(schema).parquet(f"{tmp_path}/in/*").writeStream.foreachBatch(table.sink("k", "v")).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()  # noqa: E306
    run()
    assert rows_of(table.read()) == [(1, "b"), (2, "x")]
    spark.createDataFrame([(2, "y"), (3, "z")], schema).coalesce(1).write.parquet(f"{tmp_path}/in/2")
    run()
    assert rows_of(table.read()) == [(1, "b"), (2, "y"), (3, "z")]
    before = table.commits().count()
    assert table.merge(spark.createDataFrame([(2, "again")], schema), "k", "v", batch=1) == before and table.commits().count() == before


def test_attempts(spark):
    t = datetime(2024, 1, 1)
    times = "attempted_at timestamp, succeeded_at timestamp, changed_at timestamp, next_poll_at timestamp, backoff_until timestamp, updated_at timestamp"
    rest = "interval_s long, reason string, streak long, failures long, http_status int, error string, duration_ms long, new_items long, etag string, last_modified string, ttl_s long, max_age_s long, observed_s long"
    old = (t, t, t, t, t, t, 900, "base", 0, 0, 200, "old", 5, 1, "e0", "m0", 60, 70, 80)
    state = spark.createDataFrame([("a", *old, "extra"), ("b", *old, None), ("c", *old, "x")], f"source_id string, {times}, {rest}, note string")
    attempts = [
        ("a", t + timedelta(hours=1), True, True, 600, 600, "observed_cadence", 0, 0, 200, None, 9, 4, "e1", None, None, 75, None),
        ("a", t + timedelta(hours=2), False, None, 1200, 600, "backoff", 0, 1, 500, "http_500", 7, None, None, None, None, None, None),
        ("c", t + timedelta(hours=3), True, False, 60, 60, "quota", 1, 0, 304, None, 2, 0, None, "m1", 61, None, None),
        ("unknown", t, True, True, 60, 60, "quota", 1, 0, 200, None, 2, 0, None, None, None, None, None), ("b", None, True, True, 60, 60, "quota", 1, 0, 200, None, 2, 0, None, None, None, None, None),
    ]
    given = spark.createDataFrame(attempts, f"source_id string, at timestamp, ok boolean, changed boolean, delay_s long, {rest}")
    got = {r.source_id: tuple(r)[1:] for r in health.record_attempts(state, given).collect()}
    h = lambda n, s=0: t + timedelta(hours=n, seconds=s)
    assert got == {
        "a": (h(2), h(1), h(1), h(2, 1200), h(2, 1200), h(2), 600, "backoff", 0, 1, 500, "http_500", 7, None, "e1", "m0", 60, 75, 80, "extra"),
        "b": (*old, None),
        "c": (h(3), h(3), t, h(3, 60), None, h(3), 60, "quota", 1, 0, 304, None, 2, 0, "e0", "m1", 61, 70, 80, "x"),
    }

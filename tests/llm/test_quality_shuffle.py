import numpy as np

from tidewire.llm import bloom, quality


def test_ngrams_are_packed_small_and_read_back():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.choice(np.frombuffer(b"etaoinshrdlu ", np.uint8), (60_000, 5)).astype(np.uint64) @ (1 << (8 * np.arange(4, -1, -1, dtype=np.uint64))))
    for some in (codes, codes[:0], codes[:1], np.array([0, 1, 2**64 - 1], np.uint64)):
        assert (quality.large(quality.small(some)) == some).all() and len(quality.large(quality.small(some))) == len(some)
    assert len(quality.small(codes)) < 3 * len(codes)


def test_texts_are_told_by_id_without_a_shuffle(spark, tmp_path, monkeypatch):
    ids = spark.range(40_000).selectExpr("id % 30000 AS doc_id", "concat('text ', id) AS text")
    ids.union(spark.sql("SELECT CAST(NULL AS BIGINT), 'none'")).write.parquet(f"{tmp_path}/docs")
    docs, wanted = spark.read.parquet(f"{tmp_path}/docs"), spark.range(0, 90_000, 7).toDF("doc_id")
    want = sorted((i % 30000, f"text {i}") for i in range(40_000) if i % 30000 % 7 == 0)
    passed = bloom.may_have(docs, "doc_id", bloom.membership(wanted, "doc_id", wanted.count())).count()
    assert passed > len(want)  # some pass the filter wrongly
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for many ids
    try:
        got = bloom.having(docs, "doc_id", wanted)
        assert sorted(tuple(r) for r in got.collect()) == want
        assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
        assert sorted(tuple(r) for r in bloom.having(docs, "doc_id", wanted, most=10).collect()) == want
        monkeypatch.setattr(bloom, "MAX_WRONG", 0)
        assert sorted(tuple(r) for r in bloom.having(docs, "doc_id", wanted).collect()) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")

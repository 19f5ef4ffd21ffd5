import random
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import passages
from tidewire.llm.blocks import cuts, expand_marked, in_order, shrink_marked
from tidewire.llm.textkit import run_hashes


def test_a_block_does_not_work_through_its_windows_for_each_range():
    rng = random.Random(8)
    words = ["w%d" % i for i in range(1000)]
    table = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": [" ".join(rng.choices(words, k=1000)) for _ in range(300)]})
    w, took, rows = passages.Windows(table, 13), {}, {}
    for n_shards in (64, 4096):
        may, took[n_shards] = np.ones(len(w.fingers(n_shards)[0]), bool), float("inf")
        for _ in range(3):
            began = time.process_time()
            rows[n_shards] = passages.asked_about(5, w, may, n_shards)
            took[n_shards] = min(took[n_shards], time.process_time() - began)
    for name in ("hashes", "checks", "ids"):
        few, many = (np.frombuffer(b"".join(rows[n].column(name).to_pylist()), "u8") for n in (64, 4096))
        assert len(few) == len(w.distinct) and (np.sort(few) == np.sort(many)).all()
    assert took[4096] < 3 * took[64] + 0.3, took


def test_many_ranges_give_the_same(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    common = [" ".join("c%d" % rng.randrange(50) for _ in range(40)) for _ in range(9)]
    rows = [(i, " ".join([rng.choice(common), *("w%d" % rng.randrange(10**6) for _ in range(35)), rng.choice(common)])) for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(2).write.parquet(f"{tmp_path}/docs")
    got = []
    for size in (passages.SHARD_BYTES, 150):
        monkeypatch.setattr(passages, "SHARD_BYTES", size)
        got.append(sorted(passages.drop_repeated_passages(spark.read.parquet(f"{tmp_path}/docs"), 5).select("doc_id", "n_removed", "text").collect()))
    assert got[0] == got[1] and sum(r.n_removed for r in got[0]) > 3000


@pytest.mark.parametrize("vocabulary, k", [(2, 13), (3, 8), (5, 5), (2, 3)])
def test_runs_of_few_words_have_hashes_of_their_own(vocabulary, k):
    words = np.random.default_rng(1).integers(0, 2**64, vocabulary, dtype=np.uint64)
    runs = words[np.arange(vocabulary**k)[:, None] // vocabulary ** np.arange(k) % vocabulary]
    hashes = run_hashes(runs.ravel(), k)
    assert len(hashes) == runs.size - k + 1 and len(np.unique(hashes[::k])) == len(runs)
    assert (run_hashes(runs[-1], k) == hashes[-1]).all() and len(run_hashes(runs[-1][1:], k)) == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 2**26 - 1) | st.integers(0, 300), st.booleans(), min_size=1, max_size=30), min_size=1, max_size=5))
def test_marked_places_round_trip(runs):
    at = np.concatenate([sorted(r) for r in runs]).astype(np.int64)
    marks = np.array([r[x] for r in runs for x in sorted(r)])
    shard = np.repeat(np.arange(len(runs)), [len(r) for r in runs])
    a, b = cuts(shard)
    places, got = expand_marked(shrink_marked(at, marks, a, b), b - a)
    assert (places == at).all() and (got == marks).all()


def test_order_of_hashes_that_differ_in_any_bit():
    rng = np.random.default_rng(2)
    for high in (1, 2, 300, 2**20, 2**40, 2**64):
        for n in (0, 1, 2, 3, 1000):
            hashes = rng.integers(0, high, n, dtype=np.uint64) + np.uint64(0 if high > 2**40 else 2**63)
            assert (in_order(hashes) == np.argsort(hashes, kind="stable")).all()
    near = np.r_[rng.integers(0, 2**64, 5000, dtype=np.uint64), np.arange(5, 0, -1, dtype=np.uint64)]
    assert (in_order(near) == np.argsort(near, kind="stable")).all()


def test_layout_that_is_kept(spark):
    words = [f"w{i}" for i in range(20)]
    rows = [(1, "  " + "\t".join(words)), (2, " ".join(words) + "  é  zwei \n"), (3, " a  b\n"), (4, None), (5, ""), (6, " x\t" + "  ".join(words[:7]) + " y "), (None, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: (r.text, r.n_words, r.n_removed) for r in passages.drop_repeated_passages(docs, 5, keep_layout=True).collect()}
    assert got == {1: (rows[0][1], 20, 0), 2: ("é zwei", 22, 20), 3: (" a  b\n", 2, 0), 4: (None, 0, 0), 5: ("", 0, 0), 6: ("x y", 9, 7), None: ("", 20, 20)}
    assert {r.doc_id: r.text for r in passages.drop_repeated_passages(docs, 5).collect()}[3] == "a b"

import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import sketch
from tidewire.llm.blocks import expand, pack, read, shrink
from tidewire.llm.passages import drop_repeated_passages
from tidewire.llm.textkit import buffers, word_hashes, word_spans


def brute(rows, k):
    words = [(t or "").encode().split() for _, t in rows]
    rank = [2**63 - 1 if i is None else i for i, _ in rows]
    first = {}
    for r, ws in zip(rank, words):
        for j in range(len(ws) - k + 1):
            w = tuple(ws[j : j + k])
            first[w] = min(first.get(w, r), r)
    out = []
    for r, ws in zip(rank, words):
        gone = set()
        for j in range(len(ws) - k + 1):
            if first[tuple(ws[j : j + k])] < r:
                gone |= set(range(j, j + k))
        out.append((len(ws), len(gone), b" ".join(w for j, w in enumerate(ws) if j not in gone).decode()))
    return out


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 3_000_000), max_size=40))
def test_gaps_round_trip(values):
    at = np.array(sorted(values), np.int64)
    assert (expand(shrink(at)) == at).all()


def sample(seed, n=150):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["É", "x,", "A", "a"]
    passages = [[rng.choice(vocabulary) for _ in range(rng.randint(3, 40))] for _ in range(12)]
    rows = []
    for i in range(n):
        body = []
        for _ in range(rng.randint(0, 5)):
            body += rng.choice(passages) if rng.random() < 0.5 else [rng.choice(vocabulary) for _ in range(rng.randint(1, 20))]
        rows.append((rng.choice([i, i, i, i - 1]), rng.choice([" ", "\n", " \t "]).join(body)))
    rows += [(500 + i, " ".join(passages[0] * 4)) for i in range(50)] + [(3, None), (4, ""), (5, "  \n"), (None, " ".join(passages[1])), (None, " ".join(passages[1])), (900, "same " * 40000), (901, "same " * 20)]
    return rows


def test_like_brute_force(spark):
    for seed, block, bits, k in ((1, 1 << 20, 22, 13), (2, 3000, 22, 13), (3, 2000, 4, 5)):
        rows = sample(seed)
        docs = spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, block string, nth int").repartition(4, "nth")
        path = spark.conf.get("spark.checkpoint.dir") + f"/passages{seed}"
        docs.write.parquet(path)
        got = {r.nth: r for r in drop_repeated_passages(spark.read.parquet(path), k, block, bits).collect()}
        assert len(got) == len(rows)
        for n, (size, gone, kept) in enumerate(brute(rows, k)):
            r = got[n]
            assert (r.n_words, r.n_removed, r.text or "") == (size, gone, kept), (seed, n)
            assert (r.text is None) == (rows[n][1] is None) and r.block == "clash" and r.doc_id == rows[n][0]


def test_blocks_keep_all_rows(spark):
    docs = spark.createDataFrame([(i, "x" * (i * 37 % 500) if i % 7 else None) for i in range(400)], "doc_id long, text string")
    for limit in (1, 300, 5000):
        tables = [read(r.payload) for r in pack(docs, limit=limit).collect()]
        assert sorted(i for t in tables for i in t.column("doc_id").to_pylist()) == list(range(400))
        assert all(t.num_rows == 1 or sum(len(x or "") for x in t.column("text").to_pylist()) <= limit for t in tables)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert drop_repeated_passages(docs).count() == 0


def test_places_keep_order_and_ranges():
    rng = np.random.default_rng(8)
    hashes = np.sort(np.r_[rng.integers(0, 2**64, 2000, dtype=np.uint64), np.array([0, 2**64 - 1], np.uint64)])
    for n in (1, 3, 12345, 2**31):
        shard, place = sketch.places(hashes, n)
        assert shard.tolist() == [int(h) * n >> 64 for h in hashes]
        assert place.tolist() == [(int(h) * n % 2**64) >> (64 - sketch.FINGER_BITS) for h in hashes]


def test_sketch_loses_no_repeated_window_and_filters_most_others():
    rng = np.random.default_rng(2)
    once, twice = np.split(rng.choice(1 << sketch.FINGER_BITS, 1_200_000, replace=False), [1_100_000])
    fingers = np.r_[once, twice[:50_000], twice[:50_000], twice[50_000:]]
    shared = np.arange(len(fingers)) >= len(fingers) - 50_000
    got = sketch.estimated_repeated(fingers, shared)
    assert got[len(once) :].all() and got[: len(once)].mean() < 0.15


def thue_morse(n):
    return "".join("ab"[i.bit_count() & 1] for i in range(n))


def test_words_made_to_collide_in_linear_hashes():
    one = thue_morse(1024)
    words = [one, one.translate(str.maketrans("ab", "ba")), one[:512], one[512:], one[:200], one[56:256], "a" * 16, "a" * 8 + "b" * 8, "b" * 8 + "a" * 8]
    for fold in (False, True):
        data, offs = buffers(pa.array([" ".join(words)]))
        starts, ends, _ = word_spans(data, offs)
        for second in (False, True):
            assert len(set(word_hashes(data, starts, ends, fold, second).tolist())) == len(set(words))
    data, offs = buffers(pa.array(["Ab aB ÄB äb x" + "Y" * 300, "ab ab Äb äb x" + "y" * 300]))
    starts, ends, rows = word_spans(data, offs)
    folded = word_hashes(data, starts, ends, fold=True)
    assert (folded[:5] == folded[5:]).sum() == 5 and len(set(word_hashes(data, starts, ends).tolist())) == 8


def test_a_word_that_only_looks_repeated_stays(spark):
    one = thue_morse(1024)
    rest = ["w%d" % i for i in range(12)]
    rows = [(1, " ".join([*rest, one])), (2, " ".join([*rest, one.translate(str.maketrans("ab", "ba"))])), (3, " ".join(rest[:11]))]
    got = {r.doc_id: r.n_removed for r in drop_repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0, 3: 0}

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm.importance import crc32, drawn_ranks, normal_words, resample
from tidewire.llm.textkit import buffers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def features(text, longest):
    ws = words_of(text)
    return [" ".join(ws[i : i + n]) for n in range(1, longest + 1) for i in range(len(ws) - n + 1)]


def brute(docs, target, buckets, longest, percent, least):
    count = lambda texts: Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t, longest))
    have, want = count(t for _, t in docs), count(target)
    s_all, t_all = float(sum(have.values())), float(sum(want.values()))
    gain = {b: math.floor(1000 * math.log((want[b] + 1.0) * (s_all + buckets) / ((have[b] + 1.0) * (t_all + buckets)))) for b in have}
    rows = []
    for i, t in docs:
        fs = [gain[zlib.crc32(f.encode()) % buckets] for f in features(t, longest)]
        weight = sum(fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(t))])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(able[: len(able) * percent // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def sample(seed, n):
    rng = random.Random(seed)
    words = ["Ab", "ab", "x1", "É", "é", "naïve", "日本", "the", "w" * 60, "q"] + ["w%d" % i for i in range(200)]
    text = lambda: rng.choice([" ", "\n", ", ", "—"]).join(rng.choice(words) for _ in range(rng.choice([0, 1, 19, 20, 21, 60])))
    return [text() for _ in range(n)]


def shown(df):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    texts = sample(1, 200) + [None, "", "_ - !", "Word " * 30_000]
    docs = list(enumerate(texts)) + [(7, texts[7]), (8, "another text of an id that repeats " * 4)]
    target = sample(2, 9) + [None, "w1 w2 w3 " * 40]
    frame = spark.createDataFrame([(i, t, 1, 2, "m") for i, t in docs], "doc_id long, text string, rank int, Weight int, ids string").repartition(3)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    for buckets, longest, percent, least in ((10_000, 1, 10, 20), (97, 3, 50, 1), (10_000, 2, 100, 0)):
        assert shown(resample(frame, goal, buckets, longest, percent, least)) == brute(docs, target, buckets, longest, percent, least)


def test_rows_without_id_text_or_target(spark):
    docs = spark.createDataFrame([(None, "a " * 20), (None, None), (3, "b " * 20), (4, "b " * 19)], "doc_id long, text string")
    none = spark.createDataFrame([], "text string")
    got = resample(docs, none, percent=100).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == [1, 2] and sum(r.doc_id is None for r in got) == 2
    assert resample(docs.where("false"), none).collect() == []


def test_ties_go_to_smaller_ids_and_groups_of_one_score_are_cut(spark):
    rows = [(i, 50, 7) for i in range(100)] + [(200, 50, 9000), (201, 50, -9000), (202, 1, 99999)]
    frame = spark.createDataFrame(rows, "doc_id long, n_words long, score long").repartition(5)
    got = {r.doc_id: r["rank"] for r in drawn_ranks(frame, 10, 20).collect()}
    assert got[200] == 1 and [i for i, x in sorted(got.items()) if x] == [*range(9), 200] and [got[i] for i in range(9)] == [*range(2, 11)]


def test_chance_follows_the_weights(spark):
    frame = spark.range(20_000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'wanted word', 'other thing') || repeat(' filler', 20) AS text")
    got = resample(frame, spark.createDataFrame([("wanted word " * 20,)], "text string"), percent=10).where("rank IS NOT NULL").selectExpr("avg(doc_id % 2) AS odd", "count(*) AS n").first()
    assert got.n == 2000 and got.odd < 0.45


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZ09 \n\t-_ÄßI日\x7f"), max_size=130), max_size=6))
def test_words_and_checksums(texts):
    data, offs = buffers(pa.array(texts, pa.string()))
    joined, starts, ends, rows = normal_words(data, offs)
    raw = joined.tobytes()
    for i, t in enumerate(texts):
        assert [raw[a:b].decode() for a, b in zip(starts[rows[i] : rows[i + 1]], ends[rows[i] : rows[i + 1]])] == words_of(t)
    assert crc32(joined, starts, ends).tolist() == [zlib.crc32(raw[a:b]) for a, b in zip(starts, ends)]
    assert crc32(joined, np.zeros(1, np.int64), np.array([len(raw)])).tolist() == [zlib.crc32(raw)]

import math
import random

from tidewire.llm.mixing import mix_sizes, mix_sources
from tidewire.llm.op4_mixing import mix_by_quality


def u(i, seed=0):
    import hashlib

    return (int(hashlib.md5(f"{'' if i is None else i}:{seed}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52


def brute(rows, epochs=3):
    """rows: doc_id, source, size, weight."""
    names = sorted({r[1] for r in rows}, key=lambda s: (s is None, s or ""))
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in names}
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, open_, left = {}, list(names), float(sum(size.values()))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if level * weight[s] >= epochs * size[s]]
        if not full:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in full:
            target[s] = float(epochs * size[s])
            left -= target[s]
            open_.remove(s)
    out = []
    for s in names:
        whole = math.floor(target[s] / size[s]) if size[s] else 0
        rest = round(target[s] - whole * size[s])
        mine = sorted((r for r in rows if r[1] == s), key=lambda r: (-math.log(u(r[0])) / max(r[3] if r[3] is not None else 1e-9, 1e-9), r[0] if r[0] is not None else -1, r[2]))
        for r in mine:
            part = max(0, min(r[2], rest))
            rest -= r[2]
            out.append((r[0], r[2], size[s], round(target[s], 6), whole * r[2] + part))
    return sorted(out, key=str)


def shown(df):
    return sorted(((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in df.collect()), key=str)


def test_sizes_against_brute_force(spark):
    rng = random.Random(5)
    for seed in range(3):
        names = [None, "a", "b", "c", "hot"][: 3 + seed]
        rows = [(i, rng.choice([*names, "hot", "hot"]), rng.choice([0, 1, 5, rng.randrange(400)]), rng.choice([1.0, 0.5, 0.001, None])) for i in range(300)]
        rows += [(1000, "tiny", 7, 1.0), (1001, "none", 0, 1.0)]
        sized = spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")
        assert shown(mix_sizes(sized)) == brute(rows)
        assert shown(mix_sizes(sized, ranges=1)) == brute(rows) == shown(mix_sizes(sized.repartition(7)))


def test_low_weights_spread_over_ranges(spark):
    from pyspark.sql import functions as F

    from tidewire.llm.mixing import RANGES, uniform

    for weight in (1e-9, 0.1, 1.0):
        key = -F.log(uniform(F.col("id"))) / weight
        counts = spark.range(20000).groupBy(F.floor(F.log2(key) * RANGES).alias("b")).count()
        assert counts.agg(F.max("count")).first()[0] < 20000 / 100


def test_quality_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b c", "s", "x"), (1, "a b c", "s", "y"), (None, "w " * 5000, "s", "z"), (2, None, None, "z"), (3, "", "t", "z"), (4, "one\u00a0word two", "t", "z")], "doc_id long, text string, source string, weight string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, None), (None, 1)], "doc_id long, quality int")
    got = mix_by_quality(docs, labels).collect()
    assert sorted(r.size for r in got) == [0, 0, 2, 3, 3, 5000] and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mix_by_quality(docs.limit(0), labels).count() == 0
    assert shown(mix_sources(docs)) == shown(mix_sources(docs))


def test_good_documents_come_first(spark):
    rows = [(i, "s", 10, 1.0 if i % 2 else 0.25) for i in range(2000)] + [(-1, "t", 9000, 1.0)]
    got = mix_sizes(spark.createDataFrame(rows, "doc_id long, source string, size long, weight double")).where("source = 's'").collect()
    more = [sum(r.taken for r in got if r.doc_id % 2 == k) for k in (0, 1)]
    assert more[1] > more[0] and abs(sum(more) - got[0].target) <= 1

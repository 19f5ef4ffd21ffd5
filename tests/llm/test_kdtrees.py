import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm.kdtrees import Tree, build, clusters, distances, survivors


def brute(rows, dim, k, rounds, scale=256):
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest()
    centres = [v for _, v in sorted(kept, key=lambda r: (key(r[0]), r[1]))[:k]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))
    for _ in range(rounds):
        mine = [[] for _ in centres]
        for _, v in kept:
            mine[nearest(v)[1]].append(v)
        centres = [[sum(x) // len(m) for x in zip(*m)] if m else c for m, c in zip(mine, centres)]
    rows = [(i, *nearest(v)[::-1]) for i, v in kept]
    own = {c: sum(d for _, x, d in rows if x == c) for _, c, _ in rows}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in rows), key=str)


def frame(spark, rows, kind="array<float>"):
    return spark.createDataFrame([(i, v, 3, "c") for i, v in rows], f"vec_id long, embedding {kind}, cluster int, V string")


def shown(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(4)
    mids = [[rng.uniform(-1, 1) for _ in range(5)] for _ in range(6)]
    rows = [(i, [float(np.float32(x + rng.gauss(0, 0.1))) for x in rng.choice(mids)]) for i in range(900)]
    rows += [(None, rows[0][1]), (3, rows[5][1]), (3, rows[3][1]), (5000, None), (5001, [1.0] * 4), (5002, []), (5003, [1.0, None, 1.0, 1.0, 1.0]), (5004, [math.nan] * 5), (5005, [math.inf] * 5), (5006, [2.0] * 5)]
    data = frame(spark, rows).repartition(3)
    assert shown(clusters(data, dim=5, k=7, rounds=3)) == brute(rows, 5, 7, 3)
    assert shown(clusters(data, dim=5, k=2000, rounds=1)) == brute(rows, 5, 2000, 1)


def test_ties_copies_and_few_vectors(spark):
    rows = [(i, [float(i % 2), 0.0]) for i in range(400)]
    assert shown(clusters(frame(spark, rows), dim=2, k=5, rounds=2)) == brute(rows, 2, 5, 2)
    assert clusters(frame(spark, rows), dim=3).collect() == []
    assert clusters(frame(spark, rows).where("false")).columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_large_components(spark):
    rows = [(i, [float(i * 1000), -float(i * i * 90), 1e30 if i == 9 else 0.5]) for i in range(60)]
    got = shown(clusters(frame(spark, rows, "array<double>"), dim=3, k=4, rounds=2))
    assert got == brute([r for r in rows if r[0] != 9], 3, 4, 2)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 300), st.integers(1, 9), st.sampled_from([2, 30, 1 << 26]))
def test_walk_is_exact(seed, n, k, span):
    rng = np.random.default_rng(seed)
    points, centres = rng.integers(-span, span + 1, (n, 3)), rng.integers(-span, span + 1, (k, 3))
    order, low, high, total = build(points, leaf=4)
    flat = {c: np.concatenate(x).tobytes() for c, x in zip(("low", "high", "total"), (low, high, total))}
    tree = Tree({"n": n, "kind": "i8", "points": points[order].tobytes(), **flat}, 3)
    whole, places, nearest = tree.assign(centres)
    cluster = np.full(n, -1)
    for a, b, c, s in whole:
        assert (cluster[a:b] == -1).all() and (points[order][a:b].sum(0) == s).all()
        cluster[a:b] = c
    assert (cluster[places] == -1).all()
    cluster[places] = nearest
    want = distances(points[order], centres).argmin(1)
    assert (cluster == want).all() and sorted(order) == list(range(n))
    assert (distances(points, centres) == ((points[:, None] - centres[None]) ** 2).sum(2)).all()


def test_nodes_are_pruned():
    points = np.concatenate([np.arange(500)[:, None] % 20 + np.array([[0, 0]]), np.arange(500)[:, None] % 20 + np.array([[10_000, 0]])])
    _, low, high, _ = build(points, leaf=50)
    alive = survivors(low[1], high[1], np.array([[0, 0], [10_000, 0], [9_000, 9_000]]), np.ones((2, 3), bool))
    assert alive.sum() == 2

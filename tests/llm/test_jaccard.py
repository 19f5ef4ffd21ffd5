import random

import numpy as np
import pytest

from tidewire.llm import jaccard
from tidewire.llm.graph import components


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").encode().split()]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def sample(seed, n):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(600)]
    say = lambda m: [rng.choice(vocabulary) for _ in range(m)]
    common = say(30)
    rows, bases = [], [say(rng.randint(5, 120)) for _ in range(15)]
    for i in range(n):
        kind = rng.random()
        if kind < 0.6:
            words = list(rng.choice(bases))
            for _ in range(rng.randint(0, 5)):
                j = rng.randrange(len(words))
                words[j : j + rng.randint(0, 2)] = say(rng.randint(0, 2))
        else:
            words = say(rng.randint(0, 60)) + (common if kind < 0.8 else [])
        text = " ".join(words)
        rows.append((i, text.upper() if rng.random() < 0.2 else text))
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "one two"), (n + 4, "One  TWO"), (n + 5, "É b"), (n + 6, "é b"), (n + 7, "z " * 30000), (n + 8, "z z z z z")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,one_in", [(1, 2), (2, 1000000)])
def test_components_of_brute_force(spark, monkeypatch, seed, one_in):
    monkeypatch.setattr(jaccard, "CHUNK_SETS", 7)
    monkeypatch.setattr(jaccard, "CHUNK_ELEMENTS", 1000)
    rows = sample(seed, 260)
    docs = spark.createDataFrame([(d, t, "clash") for d, t in rows], "doc_id long, text string, sid string")
    got = jaccard.near_duplicates(docs, one_in=one_in).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, 4, 85))


def test_links_in_tile_join_all_linked_components():
    rng = np.random.default_rng(4)
    for _ in range(60):
        pool = np.unique(rng.integers(0, 2**64, 60, dtype=np.uint64))
        arrays = []
        for _ in range(rng.integers(2, 25)):
            base = arrays[rng.integers(len(arrays))] if arrays and rng.random() < 0.7 else pool[rng.random(len(pool)) < 0.5]
            arrays.append(np.unique(np.r_[base[rng.random(len(base)) > 0.06], rng.choice(pool, 1)]))
        comps = rng.integers(0, 8, len(arrays))

        def closed(pairs):
            label = comps.copy()
            for a, b in pairs:
                label[label == label[b]] = label[a]
            return [tuple(np.flatnonzero(label == x)) for x in np.unique(label)]

        want = [(i, j) for i in range(len(arrays)) for j in range(i) if 100 * len(np.intersect1d(arrays[i], arrays[j])) >= 85 * len(np.union1d(arrays[i], arrays[j]))]
        assert sorted(closed(want)) == sorted(closed(jaccard.links_in_tile(np.arange(len(arrays)), comps, arrays, 85)))


def test_components(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, x) for x in range(101, 150)] + [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.id: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for a, b in edges if a != b for x in (a, b)}


def test_empty(spark):
    assert jaccard.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert jaccard.near_duplicates(spark.createDataFrame([(1, None), (None, "a b c d e"), (None, "a b c d e")], "doc_id long, text string")).count() == 3


def test_one_word_sets_of_words_made_to_collide(spark):
    one = "".join("ab"[i.bit_count() & 1] for i in range(1024))
    rows = [(1, one), (2, one.translate(str.maketrans("ab", "ba"))), (3, one.upper())]
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 1, 2: 2, 3: 1}

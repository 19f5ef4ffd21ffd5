import random

import pytest

import corpus_pipeline

WORDS = "alpha bravo cedar delta ember flint grove haven inlet jolly knoll lemon maple north ocean pearl quill river stone tulip umber vivid willow xenon yield zebra".split()


def words(rng, n):
    return [rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)]


def windows(ws, k=13):
    return [tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)]


def shingles(text, k=5):
    ws = text.lower().split()
    return {tuple(ws[i : i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else {tuple(ws)} if ws else set()


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(4), tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(420):
        ws = words(rng, rng.randrange(30, 90))
        toxic = i % 6 == 0
        if toxic:
            for _ in range(4):
                ws.insert(rng.randrange(len(ws)), rng.choice(["vileness", "vilest", "scoundrels"]))
        rows.append([i, " ".join(ws), "en", ["a", "b", None][i % 3]])
        if i % 4 < 2:
            labels.append((i, 1, int(toxic)))
    items = [" ".join(words(rng, 30)) for _ in range(3)]
    passage = words(rng, 40)
    n = len(rows)
    for i in range(3):
        rows.append([n + i, rows[1][1] + (" extra" if i else ""), "en", "a"])  # near copies of document 1
        rows.append([n + 10 + i, " ".join(words(rng, 20)) + "\n" + items[i] + "\n" + " ".join(words(rng, 20)), "en", "b"])  # leaks
        rows.append([n + 20 + i, " ".join([*words(rng, 60), *passage, *words(rng, 60)]), "en", None])  # a shared passage
    rows += [[n + 30, None, None, None], [n + 31, "", "en", "a"], [n + 32, "  Odd\tlayout  here \n\n kept ", "en", "a"]]
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, items, passage


def test_every_stage_against_brute_force(spark, tables):
    folder, rows, items, passage = tables
    n, columns = 420, ["doc_id", "text", "lang", "source", "n_chars"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, folder)
    assert clean.columns == columns
    kept = {r.doc_id: r for r in clean.collect()}
    truth = {r[0]: r[0] % 6 == 0 and r[0] < n for r in rows}
    assert sum((i in kept) != bad for i, bad in truth.items()) / len(truth) > 0.97

    near = stages["n-gram Jaccard join"](spark, clean, folder)
    assert near.columns == columns
    texts = {i: r.text or "" for i, r in sorted(kept.items())}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    sets = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(texts)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    want = {i for i in ids if find(i) == i}
    got = {r.doc_id: r for r in near.collect()}
    assert set(got) == want and len(want) <= len(ids) - 3

    cut = stages["substring dedup"](spark, near, folder)
    assert cut.columns == columns
    seen, expected = {}, {}
    for i in sorted(got):
        for w in windows((got[i].text or "").split()):
            seen.setdefault(w, i)
    for i in sorted(got):
        ws = (got[i].text or "").split()
        gone = {p for at, w in enumerate(windows(ws)) if seen[w] < i for p in range(at, at + 13)}
        if not gone:
            expected[i] = got[i].text
        elif len(gone) < len(ws):
            expected[i] = " ".join(w for p, w in enumerate(ws) if p not in gone)
    after = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in after.items()} == expected
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in after.values())
    assert sum(" ".join(passage) in (r.text or "") for r in after.values()) == 1

    safe = stages["benchmark decontamination"](spark, cut, folder)
    assert safe.columns == columns
    left = {r.doc_id for r in safe.collect()}
    assert left == {i for i, t in expected.items() if not any(item in (t or "") for item in items)}

    mixed = {r.doc_id: r for r in stages["mixing sources to target weights"](spark, safe, folder).collect()}
    assert set(mixed) == left and all(0 <= r.taken <= 3 * r.size for r in mixed.values())
    assert all(r.size == len((expected[i] or "").split()) for i, r in mixed.items())

    whole = sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()))
    assert whole == sorted(map(tuple, mixed.values()))


def test_empty_documents(spark, tables, tmp_path):
    folder, *_ = tables
    for name in ("documents", "labels", "benchmark"):
        df = spark.read.parquet(f"{folder}/{name}.parquet")
        (df.limit(0) if name == "documents" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_leaks_of_null_and_repeated_ids(spark, tables):
    folder, _, items, _ = tables
    rows = [(None, f"alpha {items[0]} bravo"), (None, "clean text"), (None, None), (7, f"{items[1]} bravo"), (7, "other clean text"), (8, "clean text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_benchmark_leaks(spark, docs, folder)
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, (rows[i] for i in (1, 2, 4, 5))))

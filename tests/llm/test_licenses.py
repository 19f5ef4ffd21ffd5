import random

import pytest

from tidewire.llm.licenses import LEAST_SHARE, TEMPLATES, document_frequency, normal, rarest, scan, template
from tidewire.llm.op12_licenses import query


def brute(text, templates):
    ws = normal(text or "")
    out = []
    for t in templates:
        for s in range(-len(t.words), len(ws)):
            if all(s + a >= 0 and ws[s + a : s + a + len(p)] == p for a, p in t.must):
                share = sum(0 <= s + j < len(ws) and ws[s + j] == w for j, w in enumerate(t.words)) / len(t.words)
                if share >= LEAST_SHARE:
                    out.append((t.label, t.base, s, len(t.words), share))
    return sorted(out)


def texts(seed):
    rng = random.Random(seed)
    out = [None, "", "mit", "MIT-LICENSE mit License\nMit  license.", "Licensed under CC BY-NC 4.0. CC BY cc_by ccby", "gnu general gnu general public license public license", "apache licensé apache licenseİ", "BY CC", "İ MIT LICENSE"]
    pool = [w for t in TEMPLATES for w in t.words] + ["mit", "mit", "cc", "by", "license", "und", "x9"]
    for _ in range(250):
        ws = [rng.choice(pool) for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            words = list(rng.choice(TEMPLATES).words)
            for _ in range(rng.choice([0, 0, 1, 3])):
                words[rng.randrange(len(words))] = "other"
            at = rng.randint(0, len(ws))
            ws[at:at] = words[rng.choice([0, 0, 0, 1]) :]
        out.append(rng.choice([" ", ", ", "\n"]).join(w.upper() if rng.random() < 0.3 else w for w in ws))
    return out


def test_places_against_brute_force(spark):
    rows = [(i, t, 5, "f") for i, t in enumerate(texts(3))] + [(None, "mit license " * 3, 1, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_words int, found string").repartition(3)
    got = scan(docs)
    assert got.columns == ["doc_id", "text", "n_words", "found"]
    for r in got.collect():
        assert r.n_words == len(normal(r.text or ""))
        assert sorted(tuple(x) for x in r.found) == brute(r.text, TEMPLATES), r.text
    assert scan(docs.where("false")).collect() == [] and scan(docs, ()).selectExpr("max(size(found)) AS n").first().n == 0


def test_long_texts_and_the_query_columns(spark, tmp_path):
    long = "word " * 40_000 + "Released under the MIT License. " + "mit " * 20_000 + "license"
    spark.createDataFrame([(1, long), (2, None), (3, "x")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in query(spark, str(tmp_path)).collect()}
    one = got[1]
    assert (one.n_words, one.n_base, one.first_word, one.last_word, one.base_labels, one.labels, one.score) == (60_006, 2, 40_003, 60_004, "mit", "mit", 1.0)
    assert (got[2].n_words, got[2].n_base, got[2].first_word, got[2].base_labels, got[2].labels, got[2].score) == (0, 0, None, "", "", 0.0) and got[3].n_words == 1


def test_rarest_words_are_posted(spark):
    docs = spark.createDataFrame([(i, "mit der und mit" if i else "the license") for i in range(9)], "doc_id long, text string")
    frequency = document_frequency(docs, ["license", "mit", "zebra"])
    assert frequency == {"license": 1, "mit": 8}
    assert rarest(template("mit", "MIT License"), frequency, 1) == ["license"] and rarest(template("z", "mit zebra license"), frequency) == ["zebra", "license"]


def test_phrases_must_be_of_the_passage():
    with pytest.raises(ValueError):
        template("x", "one two three", "two four")
    assert template("x", "One, two THREE", "two-three").must == ((1, ("two", "three")),)

import random
import zlib

from pyspark.sql import functions as F

from tidewire.llm import langid, toxicity

VOICES = {"en": "the of and to in that with from which this have".split(), "de": "der die und nicht mit auf eine ist über sich für".split(), "fr": "le la les et des une dans pour que avec être".split()}


def corpus(n=360, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        lang = list(VOICES)[i % 3]
        body = [rng.choice(VOICES[lang]) if rng.random() < 0.7 else rng.choice(VOICES[lang]) + rng.choice(VOICES[lang]) for _ in range(40)]
        toxic = int(i % 10 < 2)
        if toxic:
            for _ in range(3):
                body.insert(rng.randrange(len(body)), rng.choice(["vileness", "vilest", "scoundrel"]))
        rows.append((i, " ".join(body), lang, toxic))
    return rows


def test_language_of_held_out_texts(spark):
    rows = [(i, t, lang) for i, t, lang, _ in corpus()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~held))
    odd = [(-1, None, None), (-2, "", "en"), (-3, "12 .. !!", "de"), (-4, "Über " * 30000, None), (-4, "Über " * 30000, None), (-5, "Ωμέγα", None)]
    out = langid.predict(spark.createDataFrame(rows + odd, "doc_id long, text string, score string").drop("score").unionByName(docs.limit(0).drop("lang")), model).collect()
    got = {r.doc_id: r for r in out}
    assert len(out) == len(rows) + len(odd)
    right = [got[i].lang_pred == lang for i, _, lang in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(right) / len(right) > 0.97
    assert all(got[i].lang_pred == "und" for i in (-1, -2, -3)) and got[-4].lang_pred == "de" and got[-5].lang_pred in VOICES
    assert all(0 <= r.score <= 1 for r in out)
    nothing = langid.train(docs.limit(0))
    assert {r.lang_pred for r in langid.predict(docs.select("doc_id", "text").limit(3), nothing).collect()} == {"und"}


def test_unseen_words_back_off_to_shorter_grams():
    model = langid.Model(["a", "b"], {0: {"known": 0}, 4: {}, 3: {"<xy": 1}, 2: {}, 1: {"z": 2}}, __import__("numpy").array([[-1, -9], [-9, -1], [-2, -8]], "float32"))
    assert model.classify("known")[0] == "a" and model.classify("xyq")[0] == "b" and model.classify("qz")[0] == "a"


def test_toxicity_from_positive_and_unlabelled_text(spark):
    rows = corpus(900, 5)
    docs = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows if i % 2], "doc_id long, toxic int")
    model = toxicity.train_from_labels(docs, labels)
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "vilest " * 20000), (-3, "vilest " * 20000), (None, "der und")], "doc_id long, text string")
    got = {}
    for r in toxicity.score(docs.unionByName(odd), model).collect():
        got[r.doc_id] = r.score
    held = [(y, got[i] >= 0.5) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(bool(y) == p for y, p in held) / len(held) > 0.95
    assert got[-1] < 0.5 and got[-2] < 0.5 and all(0 <= s <= 1 for s in got.values())
    none = toxicity.train_from_labels(docs, labels.limit(0))
    assert max(r.score for r in toxicity.score(docs, none).collect()) < 0.01
    assert toxicity.score(docs.limit(0), none).count() == 0

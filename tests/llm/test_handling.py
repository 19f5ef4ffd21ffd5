import random

from pyspark.sql import functions as F

import corpus_pipeline
from tidewire.llm import fingerprint as fp
from tidewire.llm import htmlmodel, langid, toxicity
from tidewire.llm.domtree import join, parse
from tidewire.llm.graph import components
from tidewire.llm.jaccard import joined, near_duplicates
from tidewire.llm.tables import Scratch
from tidewire.llm.tokencount import encoded_lengths


def text_of(html):
    page = parse(html)
    return join(page, [True] * len(page.nodes))


def test_letterless_texts_are_und(spark):
    train = spark.createDataFrame([(i, "the cat and the dog", "en") for i in range(9)] + [(i, "der Hund und die Katze", "de") for i in range(9, 18)], "doc_id long, text string, lang string")
    model = langid.train(train)
    rows = [(1, "\u00bd \u00b2"), (2, "\u2167 12"), (3, "x\u00b2 der die"), (4, None), (5, "der " * 3)]
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame([(*r, "kept?", 7) for r in rows], "doc_id long, text string, lang_pred string, Score int"), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "de", "und", "de"]
    assert langid.letter_runs("x\u00b2y A1b") == ["x", "y", "a", "b"]


def test_clashing_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b", "<p>t</p>", 5, "f", 9, "m")], "doc_id long, text string, html string, score int, fingerprint string, n_tokens int, main_text string")
    assert toxicity.score(docs, toxicity.Model({}, -1.0)).schema["score"].dataType.simpleString() == "double"
    assert encoded_lengths(docs).schema["n_tokens"].dataType.simpleString() == "bigint"
    assert len(fp.fingerprints(docs).first().fingerprint) > 5
    model = htmlmodel.train(htmlmodel.labelled_pages(spark, 30))
    assert isinstance(htmlmodel.extract(docs, model).first().main_text, str)


def test_toxic_words_late_in_long_texts_count(spark):
    rng = random.Random(1)
    rows = []
    for i in range(600):
        words = ["w%d" % rng.randrange(10**6) for _ in range(2500 if i % 20 == 0 else 20)]
        rows.append((i, " ".join(words + ["vilest"] * (i % 5 == 0)), int(i % 5 == 0)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train_from_labels(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = {r.doc_id: r.score >= 0.5 for r in toxicity.score(docs, model).collect()}
    assert sum(got[i] == bool(y) for i, _, y in rows) / len(rows) > 0.97


def test_hidden_parts_and_stray_quotes():
    assert text_of("<p>a</p><div hidden>b<p>c</p></div><p>d</p>") == "a\nd"
    assert text_of("<p style='color:red; DISPLAY : none'>x</p><p style='overflow:hidden'>y</p>") == "y"
    assert text_of("<p>one <span style=\"display:none\">no</span>two</p>") == "one two"
    assert text_of("<p class='x>shown</p>") == "shown" and text_of('<a title="5 > 3">t</a>') == "t"
    assert text_of("<p aria-hidden=true data-hidden=1 width=9>kept</p>") == "kept"
    node = parse('<div data-id="menu" width="nav" class="a b c d e f g h i j">t</div>').nodes[1]
    assert node.hints == tuple("abcdefghij")


def test_merged_fingerprints(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), " ".join("w%d" % rng.randrange(50) for _ in range(rng.randrange(0, 300)))) for _ in range(60)]
    docs = fp.fingerprints(spark.createDataFrame(rows, "source string, text string"))
    got = {r.source: r for r in fp.merged(docs.repartition(5), "source").collect()}
    for key in ("a", "b", None):
        want = None
        for r in docs.collect():
            if r.source == key:
                one = fp.from_text(r.fingerprint)
                want = one if want is None else fp.merge(want, one)
        assert (fp.from_text(got[key].fingerprint) == want).all()
    assert fp.merged(docs.limit(0), "source").count() == 0


def test_further_edges_join_components(spark):
    scratch, rng = Scratch(spark), random.Random(2)
    for _ in range(3):
        first, more = ([(rng.randrange(60), rng.randrange(60)) for _ in range(n)] for n in (25, 12))
        comps = joined(components(spark.createDataFrame(first, "a long, b long"), scratch), spark.createDataFrame(more, "a long, b long"), scratch)
        want = components(spark.createDataFrame(first + more, "a long, b long"), scratch)
        assert sorted(map(tuple, comps.collect())) == sorted(map(tuple, want.collect()))


def test_a_shingle_of_very_many_sets(spark):
    """One common passage in thousands of otherwise different short texts, and copies of one text."""
    common, rng = "one two three four five six", random.Random(4)
    rows = [(i, " ".join([common, *("w%d" % rng.randrange(10**9) for _ in range(rng.randrange(3, 6)))])) for i in range(6000)] + [(i, "copy of a text " + common) for i in range(6000, 8000)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got.where("component_id <> doc_id").count() == 1999 and got.where("component_id = 6000").count() == 2000


def test_pipeline_stages_with_odd_rows_and_clashing_columns(spark, tmp_path):
    base = [(i, f"text number {i} " + " ".join("w%d" % (i * 31 + j) for j in range(40)), "en", "s") for i in range(40)]
    copy = base[0][1]
    rows = base + [(None, copy, "en", "s"), (None, copy, "en", "s"), (5, base[6][1], "en", "s"), (7, base[7][1], "en", "s"), (None, "only here " + base[9][1].upper()[:50], "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1]), 1.5, 2, 3, 4) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double, n_words int, n_removed int, component_id int")
    spark.createDataFrame([(i, 1, int(i == 3)) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "a benchmark item that nothing here has")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert stages["toxicity"](spark, docs, str(tmp_path)).columns == docs.columns
    near = stages["n-gram Jaccard join"](spark, docs, str(tmp_path))
    assert near.columns == docs.columns
    got = sorted((str(r.doc_id), r.text) for r in near.collect())
    want = [(str(i), t) for i, t, *_ in base if i != 6] + [("5", base[6][1]), ("None", rows[-1][1])]  # copies without an id go, equal rows stay once, and of document 6's text the one of id 5
    assert got == sorted(want)
    near.write.parquet(f"{tmp_path}/near.parquet")
    out = stages["substring dedup"](spark, spark.read.parquet(f"{tmp_path}/near.parquet"), str(tmp_path))
    assert out.columns == docs.columns and {r.n_removed for r in out.collect()} == {3}
    assert corpus_pipeline.run(spark, str(tmp_path)).where(F.col("taken") > 3 * F.col("size")).count() == 0

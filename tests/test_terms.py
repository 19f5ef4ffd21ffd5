import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from tidewire.operators import phrases
from tidewire.operators.terms import ALL, GROUP, NONE, automaton, term_hits, term_places, term_spans


def brute_spans(text, term, plural):
    return [(m.start(), m.end()) for m in re.finditer(rf"(?<![a-z0-9]){re.escape(term)}{'(?:e?s)?' if plural else ''}(?![a-z0-9])", text)]


def brute(texts, lexicon, claim, every, plural):
    out = []
    for i, text in texts:
        groups = sorted({g for g, t in lexicon if t}) if claim == GROUP else [None]
        for own in groups:
            taken = []
            terms = sorted({t for g, t in lexicon if t and own in (None, g)}, key=lambda t: (-len(t), t))
            for term in terms:
                for a, b in brute_spans(text or "", term, plural):
                    if claim == NONE or all(b <= x or y <= a for x, y in taken):
                        taken.append((a, b))
                        out += [(i, g, term, a, b) for g in sorted({g for g, t in lexicon if t == term and own in (None, g)})]
                        if not every:
                            break
    return sorted(out, key=str)


WORDS = ["a", "b", "ab", "a b", "b a", "a b a", "f-35", "u.s.", "as", "classe", "class", "x y z", "."]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab sfe-35.", max_size=40), st.lists(st.sampled_from(WORDS), max_size=8, unique=True), st.booleans())
def test_spans_are_those_of_patterns(text, terms, plural):
    got = sorted((terms[n], a, b) for a, b, n in term_spans(text, automaton(terms, plural)))
    assert got == sorted((t, a, b) for t in terms for a, b in brute_spans(text, t, plural))


def sample(seed):
    rng = random.Random(seed)
    texts = [(i, " ".join(rng.choice(["a", "b", "ab", "a", "x", "y", "z", "classes", "as", "bs", "f-35s", "u.s."]) for _ in range(rng.randint(0, 14)))) for i in range(60)]
    texts += [(1, texts[1][1]), (None, "a b a"), (None, "a b a"), (99, None), (98, ""), (97, "a b a b " * 4000)]
    return texts, [("g", "a b"), ("g", "a"), ("h", "a b a"), ("h", "b a"), ("g", "b a"), ("h", "a"), ("i", "class"), ("i", "f-35"), ("h", "u.s."), ("i", ""), ("g", None), ("g", "a b")]


def test_all_ways_of_claiming_in_one_pass_and_in_parts(spark):
    texts, lexicon = sample(1)
    frame = spark.createDataFrame(texts, "id long, text string").repartition(3)
    terms = spark.createDataFrame(lexicon, "group string, term string")
    for claim in (NONE, GROUP, ALL):
        for every, plural in ((True, False), (False, True)):
            want = brute(texts, lexicon, claim, every, plural)
            for limit in (100, 3):
                got = term_places(frame, terms, claim, every, plural, limit=limit).select("id", "group", "term", "first", "end")
                assert sorted((tuple(r) for r in got.collect()), key=str) == want, (claim, every, plural, limit)
    assert term_places(frame.where("false"), terms).collect() == [] and term_places(frame, terms.where("false")).collect() == []


def test_windows(spark):
    row = term_places(spark.createDataFrame([(1, "one two three four")], "id long, text string"), spark.createDataFrame([("g", "three")], "group string, term string"), window=5).first()
    assert (row.before, row.after, row.first, row.end) == (" two ", " four", 8, 13)


def test_hits_beside_one_another(spark):
    texts = spark.createDataFrame([(1, "x y of z of y king king of"), (2, None), (3, "king king")], "id long, text string")
    lexicon = [("c", "y", "Y"), ("c", "x y", "XY"), ("t", "of", "OF"), ("t", "of z", "OFZ"), ("t", "king", "K"), ("c", None, "N")]
    got = {r.id: [(h.group, h.term, h.value, h.first, h.end) for h in r.h] for r in texts.select("id", term_hits(F.col("text"), lexicon, (("c", "t"),)).alias("h")).collect()}
    assert got[2] == [] and len(got[3]) == 2
    assert got[1][-2:] == [("c+t", "x y", "XY", 0, 3), ("c+t>", "of z", "OFZ", 4, 8)]


def test_phrases_of_any_length_and_number(spark):
    texts = spark.createDataFrame([(1, "One two three four five. İsrail'den Gazze'ye"), (2, "two, three four")], "id long, text string")
    lexicon = spark.createDataFrame([("g", "One two three four"), ("g", "two three four"), ("h", "israil"), ("h", "Gazze")], "group string, phrase string")
    want = {(1, "g", "One two three four"): 1, (1, "g", "two three four"): 1, (2, "g", "two three four"): 1, (1, "h", "Gazze"): 1}
    got = {(r.id, r.group, r.phrase): r.hits for r in phrases.phrase_hits(texts, lexicon).collect()}
    assert {k: v for k, v in got.items() if k[2] != "israil"} == want


def test_places_come_in_pieces(spark, monkeypatch):
    """A batch of large texts gives its places and hits piece by piece, each beside its own id."""
    batches = []
    texts = spark.createDataFrame([(i, "port " * 60_000 + "ship " * i) for i in range(12)], "id long, text string").coalesce(1)
    run = type(texts).mapInArrow
    monkeypatch.setattr(type(texts), "mapInArrow", lambda self, f, schema: batches.append(f) or run(self, f, schema))
    found = term_places(texts, spark.createDataFrame([("g", "ship")], "group string, term string"))
    assert {r["id"]: r["count"] for r in found.groupBy("id").count().collect()} == {i: i for i in range(1, 12)}
    assert len(list(batches[0](iter(texts.toArrow().to_batches())))) > 2
    hits = texts.select("id", F.size(F.filter(term_hits(F.col("text"), [("a", "ship", "x"), ("b", "port", None)]), lambda h: h["value"] == "x")).alias("n"))
    assert {r.id: r.n for r in hits.collect()} == {i: i for i in range(12)}

import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm.decontaminate import Matcher, budget, matches, myers, normal


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(pattern, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abc", min_size=1, max_size=90), st.text(alphabet="abc", max_size=120), st.integers(0, 9))
def test_myers_is_edit_distance(pattern, text, most):
    want = distance_in(pattern, text)
    assert myers(pattern, text, most) == (want if want <= most else None)


def edit(rng, text, n):
    for _ in range(n):
        i = rng.randrange(len(text))
        text = rng.choice([text[:i] + text[i + 1 :], text[:i] + "q" + text[i:], text[:i] + "z" + text[i + 1 :]])
    return text


def test_every_match_within_budget_is_found(spark):
    rng = random.Random(7)
    say = lambda n: " ".join("".join(rng.choice("aeinrst") for _ in range(rng.randint(1, 6))) for _ in range(n))
    items = [(i, say(rng.randint(4, 30))) for i in range(25)] + [(100, None), (101, ""), (102, "?!"), (103, "Word!"), (103, "Word!")]
    docs = []
    for d in range(120):
        item = rng.choice(items[:25])[1]
        docs.append((d, say(20) + ". " + edit(rng, item, rng.randint(0, 14)).upper() + "  " + say(rng.choice([5, 60]))))
    docs += [(500, None), (501, ""), (502, "a word, here"), (503, "swordfish"), (504, "x " * 50000 + items[0][1]), (504, "x " * 50000 + items[0][1])]
    want = {}
    for d, text in docs:
        for i, item in items:
            p, t = normal(item), normal(text)
            if not p or not t:
                continue
            if not budget(len(p), 0.08):
                hit = 0 if f" {p} " in f" {t} " else None
            else:
                hit = (0 if p in t else None) if d == 504 else distance_in(p, f" {t} ")
                hit = hit if hit is not None and hit <= budget(len(p), 0.08) else None
            if hit is not None:
                want[d, i] = hit
    docs_df = spark.createDataFrame([(d, t, "x") for d, t in docs], "doc_id long, text string, item_id string")
    items_df = spark.createDataFrame(items, "item_id long, text string")
    for chars in (10**6, 300):
        got = {(r.doc_id, r.item_id): r.distance for r in matches(docs_df, items_df, 0.08, chars).collect()}
        assert {k: v for k, v in got.items() if k[0] != 504} == {k: v for k, v in want.items() if k[0] != 504}
        assert got[504, 0] == 0
    assert len(want) > 40 and (502, 103) in want and (503, 103) not in want
    assert matches(docs_df, items_df.limit(0)).count() == 0 and matches(docs_df.limit(0), items_df).count() == 0
    assert Matcher([], 0.1).find("text") == {}


def test_items_without_id_and_short_items(spark):
    docs = spark.createDataFrame([(1, "see the quick brown fox run"), (2, "nothing here"), (3, "short ones: open sesame now"), (4, "openxsesame and shorts")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "the quick brown fox"), (None, "quick brown"), (7, "open sesame"), (8, "short")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.distance for r in matches(docs, items).collect()}
    assert got == {(1, None): 0, (3, 7): 0, (3, 8): 0}  # budgets of 0 below 13 characters: whole, between word ends
    loose = {(r.doc_id, r.item_id) for r in matches(docs, items, word_ends=False).collect()}
    assert loose == {(1, None), (3, 7), (3, 8), (4, 8)}
    assert budget(12, 0.08) == 0 and budget(13, 0.08) == 1
    typo = spark.createDataFrame([(5, "an opun sesame day")], "doc_id long, text string")
    longer = spark.createDataFrame([(9, "open sesame day")], "item_id long, text string")
    assert [(r.item_id, r.distance) for r in matches(typo, longer).collect()] == [(9, 1)]

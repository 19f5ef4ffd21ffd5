import random
from datetime import datetime, timedelta

import pytest

from tidewire.operators import stories


def greedy(rows, words):
    seeds, out = [], {}
    for item, o, domain, _, country, at in sorted(rows, key=lambda r: r[1]):
        mine, place = set(words[item]), (country or "").strip().lower() or None
        for name, d, theirs, p, t in seeds:
            common = len(mine & theirs)
            if d != (domain or "") or (t and at and abs(t - at) > timedelta(hours=48)) or not mine or not theirs or common / min(len(mine), len(theirs)) < 0.5:
                continue
            if common >= 3 or (common >= 2 and place and place == p):
                out[item] = name
                break
        else:
            seeds.append((o, domain or "", mine, place, at))
            out[item] = o
    return out


@pytest.mark.parametrize("few", [100_000, -1])
def test_like_one_by_one(spark, monkeypatch, few):
    monkeypatch.setattr(stories, "FEW", few)
    monkeypatch.setattr(stories, "PAIRS_A_ROW", 100 if few > 0 else 0)
    rng, now = random.Random(9), datetime(2024, 1, 10)
    vocabulary = ["drone", "strike", "port", "talks", "grain", "deal", "minister", "storm", "flood", "border", "ship", "vote", "ışık", "mines"]
    for seed, timeless in ((1, 0.0), (2, 0.2)):
        rows = []
        for i in range(160):
            title = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(0, 7))) + rng.choice(["", " says the report", "!"])
            rows.append((1000 + i, rng.randrange(10**6) * 1000 + i, rng.choice(["a", "a", "b", None]), title, rng.choice(["Fr", "fr ", "de", "", None]), None if rng.random() < timeless else now + timedelta(hours=rng.randrange(200))))
        df = spark.createDataFrame(rows, "item_id long, ordinal long, domain string, title string, country string, at timestamp")
        words = {r.item_id: r.w for r in df.select("item_id", stories.tokens(df.title).alias("w")).collect()}
        got = {r.item_id: r.story for r in stories.stories(df).collect()}
        assert got == greedy(rows, words) and len(set(got.values())) < len(rows)
    assert stories.stories(df.limit(0)).count() == 0


@pytest.mark.parametrize(("block", "most"), [(10**6, 6), (60, None)])
def test_long_time_takes_few_steps(spark, monkeypatch, block, most):
    """Each report hangs on the ones before it, through all of the time; blocks and their messages give what one after another gives."""
    steps, cut = [], stories.cut
    monkeypatch.setattr(stories, "BLOCK", block)
    monkeypatch.setattr(stories, "cut", lambda df: steps.append(1) or cut(df))
    rng, now = random.Random(4), datetime(2024, 1, 1)
    rows = [(i, i, "a", f"alpha report {rng.choice(['drone', 'grain', 'storm'])} {rng.choice(['port', 'ship', 'vote'])} talks", None, now + timedelta(hours=6 * i)) for i in range(150)]
    df = spark.createDataFrame(rows, "item_id long, ordinal long, domain string, title string, country string, at timestamp")
    words = {r.item_id: r.w for r in df.select("item_id", stories.tokens(df.title).alias("w")).collect()}
    assert {r.item_id: r.story for r in stories.stories(df).collect()} == greedy(rows, words)
    assert most is None or len(steps) <= most


def test_cards(spark):
    now = datetime(2024, 1, 1)
    rows = [(1, 1, 10, "s", "S", 5, now), (1, 2, 11, "t", "T", 9, now), (1, 3, 12, "s", "S2", 9, now + timedelta(1)), (4, 4, 13, "u", "U", None, None)]
    members = spark.createDataFrame(rows, "story long, ordinal long, item_id long, source_id string, source_name string, score int, at timestamp")
    got = {r.story: (r.lead, r.n, r.n_sources, r.sources) for r in stories.story_cards(members).collect()}
    assert got == {1: (12, 3, 2, ["S2", "T"]), 4: (13, 1, 1, ["U"])}

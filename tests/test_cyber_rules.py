import random
import re

import pytest
from pyspark.sql import functions as F

from tidewire.operators import cyber

PAIRS = ((cyber.BY_BEFORE, cyber.BACK_TO_BY), (cyber.SOURCE_BEFORE, cyber.BACK_TO_SOURCE), (cyber.VERB_BEFORE, cyber.BACK_TO_VERB), (cyber.PREPOSITION_BEFORE, cyber.BACK_TO_PREPOSITION))


@pytest.mark.parametrize("rule", range(4))
def test_rules_backwards_are_the_rules(rule):
    forward, backward = (re.compile(x) for x in PAIRS[rule])
    words = sorted({w for w in re.findall("[a-z]+", re.sub(r"\\[a-z]", " ", "|".join(p for p, _ in PAIRS))) if len(w) > 1} | {"breach", "breaches", "hackers", "targets", "compromising", "attacks", "ship", "x1", "a", "'re"})
    phrases = [f"{a} {b}" for a in "aimed directed spying spied based operating out blamed hackers attacks hit carried attributed raids victims".split() for b in "at on in from of to by out against".split()]
    rng = random.Random(rule)
    seen = {True: 0, False: 0}
    for _ in range(60000):
        text = rng.choice(["", "'", "x", "- ", " "]) + rng.choice([" ", " ", " ", "  ", "-"]).join(rng.choice(phrases if rng.random() < 0.3 else words) for _ in range(rng.randint(1, 4))) + rng.choice(["", " by", " by the", " by suspected", " by allegedly the", " the", " a", " dozens of"]) + rng.choice([" ", " ", " ", "", "-"])
        holds = forward.search(text) is not None
        assert holds == (backward.search(text[::-1]) is not None), text
        seen[holds] += 1
    assert min(seen.values()) > 300


def test_one_pass_over_the_texts(spark):
    """The plan has one Python pass and shuffles no characters around names."""
    lexicons = (spark.createDataFrame([("A", "north", "aland", False)], "country string, region string, term string, demonym boolean"), spark.createDataFrame([("One", "nation_state", "A", "one group")], "actor string, kind string, country string, term string"), spark.createDataFrame([("east", "eastern")], "region string, term string"))
    items = spark.createDataFrame([(1, "one group attacks Aland. aland is calm, eastern firms")], "id int, text string")
    out = cyber.geo_roles(items, *lexicons)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    rows = {(r.region, r.country): (r.roles, r.role, r.confidence) for r in out.collect()}
    assert rows == {("north", "A"): (["neutral", "origin", "target"], "target", "high"), ("east", None): (["target"], "target", "medium")}
    assert out.select(F.size("roles").alias("n")).agg(F.sum("n")).first()[0] == 4

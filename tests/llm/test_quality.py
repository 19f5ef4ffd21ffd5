import math
import random
from collections import Counter, defaultdict

import pytest

from tidewire.llm import quality


class Brute:
    """Interpolated modified Kneser-Ney over dictionaries."""

    def __init__(self, texts, order):
        self.order, self.counts = order, {}
        raw = Counter()
        for text in texts:
            data = b"\n" * (order - 1) + text.lower().encode()
            raw.update(data[i : i + order] for i in range(len(data) - order + 1))
        self.counts[order] = raw
        for k in range(order - 1, 0, -1):
            self.counts[k] = Counter(g[1:] for g in self.counts[k + 1])
        self.d, self.total, self.mass = {}, {}, {}
        for k, counts in self.counts.items():
            n = [sum(c == i for c in counts.values()) for i in (1, 2, 3, 4)]
            d = [0, 0.5, 1.0, 1.5]
            if all(n):
                y = n[0] / (n[0] + 2 * n[1])
                got = [0, 1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
                d = [g if 0 < g < i else x for i, (g, x) in enumerate(zip(got, d))]
            total, mass = defaultdict(float), defaultdict(float)
            for g, c in counts.items():
                total[g[:-1]] += c
                mass[g[:-1]] += d[min(c, 3)]
            self.d[k], self.total[k], self.mass[k] = d, total, mass

    def p(self, gram):
        if not gram:
            return 1 / 256
        k, context, below = len(gram), gram[:-1], self.p(gram[1:])
        if context not in self.total[k]:
            return below
        c, total = self.counts[k].get(gram, 0), self.total[k][context]
        return max(c - self.d[k][min(c, 3)], 0) / total + self.mass[k][context] / total * below

    def log_perplexity(self, text):
        data = b"\n" * (self.order - 1) + text.lower().encode()
        size = len(data) - self.order + 1
        return -sum(math.log(self.p(data[i : i + self.order])) for i in range(size)) / size if size else None


def sentence(rng, n=30):
    return " ".join(rng.choice("der die und haus größe the of ship water été".split()) for _ in range(n))


@pytest.mark.parametrize("order", [3, 5])
def test_against_brute_force(spark, order, monkeypatch):
    monkeypatch.setattr(quality, "PIECE", 97)
    rng = random.Random(1)
    trusted = [sentence(rng) for _ in range(25)]
    rows = [(i, t, "en") for i, t in enumerate(trusted)] + [(90, "unknown !!! $$ words", "xx"), (91, "", "en"), (92, None, None), (93, "a", None), (93, "a", None), (None, "Ωμ", "en"), (94, sentence(rng, 4000), "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    model = Brute(trusted, order)
    got = quality.perplexities(docs, docs.where("doc_id < 50"), order).collect()
    assert len(got) == len(rows)
    want = sorted((str(d), str(lang), len(t.lower().encode()) if t else 0, model.log_perplexity(t) if t else None) for d, t, lang in rows)
    for r, w in zip(sorted((str(r.doc_id), str(r.lang), r.n_tokens, r.log_perplexity) for r in got), want):
        assert r[:3] == w[:3] and (r[3] is None) == (w[3] is None) and (w[3] is None or r[3] == pytest.approx(w[3], rel=1e-5))
    # probabilities of all continuations of a context add up to 1
    assert sum(model.p(b"der d"[-order + 1 :] + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_keep_follows_language_quantiles(spark):
    rng = random.Random(2)
    rows = [(i, sentence(rng), ["en", "de", None][i % 3], "x") for i in range(1500)]
    junk = [(3000 + i, " ".join("%$&#!"[rng.randrange(5)] * 3 + rng.choice("qxzvw") * 4 for _ in range(30)), "en", "x") for i in range(20)]
    docs = spark.createDataFrame(rows + junk + [(4000, None, "en", "x"), (4001, "", "fr", "x"), (4002, sentence(rng), "fr", "x")], "doc_id long, text string, lang string, held string")
    ids = spark.createDataFrame([(i,) for i in range(1200)] + [(5,), (None,)], "doc_id long")
    out = {r.doc_id: r for r in quality.classify(docs, ids).collect()}
    assert len(out) == 1523
    assert sum(out[i].keep for i in range(1500)) > 1425 and not any(out[3000 + i].keep for i in range(20))
    assert not out[4000].keep and not out[4001].keep and out[4002].keep
    assert all(r.keep == (r.perplexity is not None and r.perplexity <= r.threshold) for r in out.values())
    nothing = quality.classify(docs, ids.limit(0)).collect()
    assert all(r.keep == (r.n_tokens > 0) for r in nothing) and all(abs(r.perplexity - 256) < 1e-3 for r in nothing if r.n_tokens)
    assert quality.classify(docs.limit(0), ids).count() == 0


def test_quantile_of_each_language(spark):
    rows = [("en", i / 100) for i in range(1, 101)] + [(None, 5.0)] * 3 + [("de", None)]
    got = {r.lang: r.threshold for r in quality.language_thresholds(spark.createDataFrame(rows, "lang string, log_perplexity double"), 0.9, 1.0).collect()}
    assert got[None] == pytest.approx(5, abs=1 / 128) and got["en"] == pytest.approx(0.9, abs=1 / 100) and set(got) == {"en", None}


def test_floor_and_threshold_are_quantiles(spark):
    rows = [("en", i / 100) for i in range(1, 201)] + [(None, 5.0)] * 3
    scores = spark.createDataFrame(rows, "lang string, log_perplexity double")
    got = {r.lang: r for r in quality.language_thresholds(scores, low=0.05).collect()}
    assert got["en"].threshold == pytest.approx(1.98, abs=1 / 100) and got["en"].floor == pytest.approx(0.1, abs=1 / 100)
    assert got[None].floor <= 5 <= got[None].threshold and all(r.floor is None for r in quality.language_thresholds(scores).collect())


def test_repeated_words_are_dropped(spark):
    rng = random.Random(5)
    rows = [(i, sentence(rng, 60), ["en", None][i % 2]) for i in range(800)] + [(1000 + i, " ".join([w] * 80), ["en", None, "fr"][i % 3]) for i, w in enumerate("der die und of the".split())] + [(2000, "", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = {r.doc_id: r for r in quality.classify(docs, spark.range(700).toDF("doc_id"), low=0.02).collect()}
    assert not any(r.keep for i, r in out.items() if i >= 1000) and sum(r.keep for i, r in out.items() if i < 800) > 720
    assert all(r.keep == (r.perplexity is not None and r.floor <= r.perplexity <= r.threshold) for r in out.values())

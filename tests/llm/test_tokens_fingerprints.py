import hashlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewire.llm import fingerprint as fp
from tidewire.llm.op3_fingerprints import compare_with_next
from tidewire.llm.textkit import buffers, shingle_sets
from tidewire.llm.tokencount import _encoding, RANKS, encoded_lengths, length_histogram, totals_at

import pyarrow as pa

TEXTS = [(3, "a b c d e f g h i j"), (1, None), (2, ""), (5, "a b c d e f g h i j"), (9, "É" * 5000 + " x"), (7, "one two"), (7, "one three"), (None, "z z z z z z z")]


def brute(texts, k, fold=False):
    out = []
    for t in texts:
        words = (t or "").encode().split()
        words = [w.lower() if fold else w for w in words]
        out.append({tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set()))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB \t\né \x00c", max_size=40)), max_size=8), st.integers(1, 5))
def test_shingle_sets_have_the_sizes_and_overlaps_of_brute_force(texts, k):
    data, offs = buffers(pa.array(texts, pa.string()))
    got = [set(x.tolist()) for x in shingle_sets(data, offs, k)]
    want = brute(texts, k)
    assert [len(x) for x in got] == [len(x) for x in want]
    for i in range(len(got)):
        for j in range(len(got)):
            assert len(got[i] & got[j]) == len(want[i] & want[j])


def test_sketch_estimates():
    rng = np.random.default_rng(1)
    values = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64))
    order = rng.permutation(len(values))
    a, b = np.sort(values[order[:4000]]), np.sort(values[order[2000:]])
    exact = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    sa, sb = fp.sketch(a), fp.sketch(b)
    assert abs(fp.resemblance(sa, sb) - exact) < 0.15
    assert abs(fp.distinct_count(sa) / 4000 - 1) < 0.3
    assert (fp.merge(sa, sb) == np.union1d(a, b)[: fp.K]).all()
    assert abs(fp.containment(sa, sb) - len(np.intersect1d(a, b)) / 4000) < 0.2
    assert fp.resemblance(sa[:0], sb[:0]) == 1.0 and fp.resemblance(sa, sb[:0]) == 0.0
    assert (fp.from_text(fp.to_text(sa)) == sa).all()


def test_fingerprints_follow_doc_id(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    for parts in (1, 3, 8):
        rows = compare_with_next(docs.repartition(3), parts).collect()
        assert len(rows) == len(TEXTS)
        order = sorted(TEXTS, key=lambda x: (x[0] is not None, x[0] or 0, x[1] or ""))
        want = {}
        for (i, t), (_, n) in zip(order, [*order[1:], order[0]]):
            t, n = t or "", n or ""
            h = len(t) // 2
            want[(i, hashlib.sha256((t[: len(t) - h] + n[:h]).encode()).hexdigest())] = len(t)
        assert {(r.doc_id, r.edited_sha256): r.n_chars for r in rows} == want
    by = {(r.doc_id, r.n_chars): r for r in rows}
    assert by[(3, 19)].fingerprint == by[(5, 19)].fingerprint and by[(3, 19)].near_next == 1.0
    assert compare_with_next(docs.limit(0), 3).count() == 0


def test_token_histogram(spark):
    docs = spark.createDataFrame([(t, "clash") for _, t in TEXTS], "text string, n_docs string")
    lengths = encoded_lengths(docs)
    enc = _encoding(RANKS)
    want = [len(enc.encode_ordinary(t or "")) for _, t in TEXTS]
    hist = length_histogram(lengths.select("n_tokens"))
    rows = {r.n_tokens: r for r in hist.collect()}
    assert set(rows) == set(want)
    for n, r in rows.items():
        assert r.n_docs == want.count(n) and r.docs_longer == sum(x > n for x in want) and r.tokens_longer == sum(x for x in want if x > n)
        assert r.tokens_kept == sum(min(x, n) for x in want) and r.tokens_total == sum(want) and r.docs_total == len(want)
        assert abs(r.quantile - sum(x <= n for x in want) / len(want)) < 1e-12
    for limit in (0, 1, 5, 10**6):
        r = totals_at(hist, limit).first()
        assert (r.docs_longer, r.tokens_kept) == (sum(x > limit for x in want), sum(min(x, limit) for x in want))
    assert length_histogram(lengths.select("n_tokens").limit(0)).count() == 0

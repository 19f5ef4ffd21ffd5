import numpy as np
import pytest

from tidewire.llm.jaccard import fold, may_link, signature


@pytest.mark.parametrize("percent", [50, 80, 85, 100])
def test_bitmaps_lose_no_link(percent):
    rng = np.random.default_rng(percent)
    pool = rng.integers(0, 2**64, 5000, dtype=np.uint64)
    sets = [np.unique(rng.choice(pool, rng.integers(1, 80))) for _ in range(40)]
    for base in list(sets):
        sets += [np.unique(np.r_[base[rng.random(len(base)) < q], rng.choice(pool, len(base) // 8)]) for q in (1, 0.95, 0.85, 0.6)]
    sets.append(np.zeros(0, np.uint64))
    comps = rng.integers(0, len(sets), len(sets))
    label = may_link(comps, np.array([len(x) for x in sets]), [signature(x) for x in sets], percent)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            common = len(np.intersect1d(a, b))
            if comps[i] != comps[j] and common and 100 * common >= percent * (len(a) + len(b) - common):
                assert label[i] == label[j]
    alone = may_link(np.zeros(len(sets)), np.array([len(x) for x in sets]), [signature(x) for x in sets], percent)
    assert (alone == np.arange(len(sets))).all()


def test_bitmaps_leave_unlike_sets_out():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**64, 300, dtype=np.uint64)) for _ in range(30)]
    assert (may_link(np.arange(30), np.array([len(x) for x in sets]), [signature(x) for x in sets], 80) == np.arange(30)).all()


def test_folding_joins_neighbouring_bits():
    rng = np.random.default_rng(3)
    bits = rng.random((5, 128)) < 0.3
    assert (fold(np.packbits(bits, axis=1)) == np.packbits(bits.reshape(5, 64, 2).any(2), axis=1)).all()

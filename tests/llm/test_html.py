import itertools
import random
from collections import Counter

import pytest

from tidewire.llm.domtree import Node, Page, join, parse
from tidewire.llm.htmlmodel import Model, extract, features, labelled_pages, make_page, train


@pytest.fixture(scope="module")
def model(spark):
    return train(labelled_pages(spark, 1500))


def test_sum_product_gives_the_marginals_of_brute_force():
    import math

    rng = random.Random(2)
    for _ in range(30):
        n = rng.randint(1, 8)
        nodes = [Node(rng.choice("abc"), -1 if i == 0 else rng.randrange(i), chars=rng.choice([0, 30]), commas=rng.randint(0, 2)) for i in range(n)]
        names = {f for x in nodes for f in features(x)}
        p, q = rng.uniform(0.05, 0.95), rng.uniform(0.05, 0.95)
        model = Model({f: rng.uniform(-3, 3) for f in names}, {(0, 0): 1 - p, (0, 1): p, (1, 0): 1 - q, (1, 1): q}, rng.uniform(0.1, 0.9))
        total, mass = 0.0, [0.0] * n
        for ys in itertools.product((0, 1), repeat=n):
            w = model.root if ys[0] else 1 - model.root
            for i, y in enumerate(ys):
                w *= math.exp(sum(model.unary[f] for f in features(nodes[i]))) if y else 1
                w *= model.edges[ys[nodes[i].parent], y] if i else 1
            total += w
            for i, y in enumerate(ys):
                mass[i] += w * y
        for got, m in zip(model.marginals(Page(nodes)), mass):
            assert abs(got - m / total) < 1e-9


def test_held_out_pages(model):
    scores = []
    for i in range(300):
        html = make_page(77_000_000 + i)
        page = parse(html)
        want, got = Counter(join(page, [x.marked for x in page.nodes]).split()), Counter(model.extract(html).split())
        scores.append(2 * sum((want & got).values()) / max(1, sum(want.values()) + sum(got.values())))
    assert sum(scores) / len(scores) > 0.9


def test_reader():
    text = lambda h: join(parse(h), [True] * len(parse(h).nodes))
    assert text("<p>a &amp; b&#233;&nbsp; c</p><p>d<br>e") == "a & bé c\nd e"
    assert text("<script>if (a<b) x</script><style>p{}</style>t<!-- <p>no</p> -->u") == "tu"
    assert text("<b>one<p>two</b> three</p><p unfinished") == "one\ntwo three"
    assert text("<ul><li>a<li>b</ul>c</div>d") == "a\nb\ncd"
    assert text("x < y and 1 <2") == "x < y and 1 <2"
    assert text(None) == "" and text("") == "" and text("<head><title>t</title></head>") == ""
    assert text("<div>" * 3000 + "deep" + "</div>" * 3000) == "deep"


def test_unclosed_elements_lose_nothing():
    text = lambda h: join(parse(h), [True] * len(parse(h).nodes))
    for name in "button object canvas audio video select datalist svg".split():
        assert text(f"<p>a</p><{name} class=x>no</{name}><p>b</p>") == "a\nb"
        assert text(f"<p>a</p><{name}><p>b</p>") == "a\nb"
        assert text(f"<{name}><p>a</p><{name}>no</{name}><p>b</p>") == "a\nb"
        assert text(f"<{name}>no <{name}>no</{name}> no</{name}>c") == "c"
    for name in "script style iframe textarea".split():
        assert text(f"<p>a</p><{name}><p>b</p>") == "a"
    assert text("<svg/>a<svg><path/></svg>b<!-- <svg> --><button>no<script>'</button>'</script></button>c") == "abc"
    assert text("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>TeX</annotation></math> holds") == "so x=2 holds"


def test_extract_rows(spark, model):
    article = "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='ad'>Buy this now.</div><article><h1>The title of it</h1><p>" + "A sentence, of some length. " * 8 + "</p><p>Short.</p></article><section class=comments><p>I read it and liked it, really.</p></section><footer>&copy; us</footer>"
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (3, "v", ""), (4, "w", "<p>" + "word " * 60000 + "</p>" )]
    out = extract(spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "page_id long, url string, html string, text string"), model).collect()
    by = {r.page_id: r.main_text for r in out}
    assert len(out) == 5 and by[2] == "" and by[3] == ""
    assert by[1] == "The title of it\n" + ("A sentence, of some length. " * 8).strip() + "\nShort."
    assert extract(spark.createDataFrame([], "page_id long, html string"), model).count() == 0


def test_reading_is_linear_in_open_elements():
    import time

    def seconds(n):
        page = "<b>" * n + "<p>one</b> <i>two" * n + "<div>" * n + "three</i>" * n
        start = time.perf_counter()
        assert len(parse(page).nodes) == 2 * n + 1
        return time.perf_counter() - start

    assert seconds(40_000) < 20 * max(seconds(4_000), 0.01)

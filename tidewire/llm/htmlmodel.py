"""Main-text extraction by a tree-structured graphical model over a page's block elements.

Each node is content or not. A node's own features give its potential; a parent's and a child's label have a joint
potential. Sum-product messages go from the leaves to the root and back, which gives exact marginals on a tree. All
potentials are counted on labelled pages: elements with the attribute ``data-content`` are content with all below, but for what has ``data-content=no``.
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm.domtree import Node, Page, join, parse
from tidewire.llm.tables import without

#: Features and edges that a fitted model keeps, most frequent first.
MAX_COUNTS = 20_000
_SIZES = (0, 20, 60, 150, 400)


def features(node: Node) -> list[str]:
    own = [f"tag {node.tag}", *(f"hint {h}" for h in node.hints)]
    if node.chars:
        own += [f"size {sum(node.chars > x for x in _SIZES)}", f"links {min(2, int(3 * node.linked / node.chars))}", f"commas {min(3, node.commas)}"]
    return own


@dataclass
class Model:
    unary: dict[str, float]  # log P(feature | content) - log P(feature | other)
    edges: dict[tuple[int, int], float]  # P(child's label | parent's label)
    root: float  # P(root is content)

    def marginals(self, page: Page) -> list[float]:
        """Probability that each node is content, by one pass up and one pass down."""
        nodes, unary = page.nodes, self.unary
        n = len(nodes)
        e = self.edges
        e00, e01, e10, e11 = e[0, 0], e[0, 1], e[1, 0], e[1, 1]
        own = [math.exp(max(-30.0, min(30.0, sum(unary.get(f, 0.0) for f in features(x))))) for x in nodes]
        # belief of content against other (odds) of all below a node, its own potential included
        up, message = own[:], [1.0] * n
        for i in range(n - 1, 0, -1):
            o = up[i]
            message[i] = (e10 + e11 * o) / (e00 + e01 * o)  # odds that the child's subtree gives to its parent
            parent = nodes[i].parent
            up[parent] = min(1e150, max(1e-150, up[parent] * message[i]))
        full = [0.0] * n
        full[0] = up[0] * self.root / (1 - self.root)
        for i in range(1, n):
            rest = full[nodes[i].parent] / message[i]  # the parent's odds without this child
            down = (e01 + e11 * rest) / (e00 + e10 * rest)
            full[i] = min(1e150, max(1e-150, up[i] * down))
        return [x / (1 + x) for x in full]

    def extract(self, html: str | None, threshold: float = 0.5) -> str:
        page = parse(html)
        return join(page, [p >= threshold for p in self.marginals(page)])


def train(pages: DataFrame) -> Model:
    """Count potentials on labelled pages (column html); Spark sums them, the most frequent reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got: Counter = Counter()
            for html in batch.column(0).to_pylist():
                page = parse(html)
                for i, node in enumerate(page.nodes):
                    y = int(node.marked)
                    got[f"{y} node"] += 1
                    got.update(f"{y} {f}" for f in features(node))
                    got[f"{int(page.nodes[node.parent].marked)} {y} edge" if i else f"{y} root"] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(got)), pa.array(list(got.values()), pa.int64())], ["what", "n"])

    rows = pages.select("html").mapInArrow(run, "what string, n long").groupBy("what").agg(F.sum("n").alias("n"))
    counts = {r.what: r.n for r in rows.orderBy(F.desc("n"), "what").limit(MAX_COUNTS).collect()}
    total = [counts.get(f"{y} node", 0) for y in (0, 1)]
    names = {k[2:] for k in counts if k[2:].split(" ")[0] in ("tag", "size", "links", "commas", "hint")}
    unary = {f: math.log((counts.get(f"1 {f}", 0) + 0.5) / (total[1] + 1)) - math.log((counts.get(f"0 {f}", 0) + 0.5) / (total[0] + 1)) for f in names}
    edges = {}
    for a in (0, 1):
        pair = [counts.get(f"{a} {b} edge", 0) + 1 for b in (0, 1)]
        edges |= {(a, b): pair[b] / sum(pair) for b in (0, 1)}
    root = (counts.get("1 root", 0) + 0.5) / (counts.get("1 root", 0) + counts.get("0 root", 0) + 1)
    return Model(unary, edges, root)


def labelled_pages(spark: SparkSession, n: int = 3000, seed: int = 11) -> DataFrame:
    """Pages made by rule in many layouts, with their article marked: column html."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([make_page(seed * 1_000_003 + i) for i in batch.column(0).to_pylist()], pa.string())], ["html"])

    return spark.range(0, n, 1, 8).mapInArrow(run, "html string")


#: Names that pages commonly give to their parts.
PARTS = {
    "content": "content main-content post-content entry-content article-body article story story-body post entry page-content text body-text hentry".split(),
    "menu": "nav menu navbar main-menu site-nav topbar navigation breadcrumbs breadcrumb pagination pager toc tabs".split(),
    "header": "header site-header masthead branding top page-header logo".split(),
    "footer": "footer site-footer bottom copyright colophon legal".split(),
    "side": "sidebar side aside widget widgets related related-posts recommended popular trending more-stories tags author-box share social sharing".split(),
    "ad": "ad ads advert advertisement banner sponsor sponsored promo promotion adsense ad-slot".split(),
    "notice": "notice cookie cookie-banner consent alert popup modal overlay newsletter subscribe signup paywall gdpr message".split(),
    "comment": "comments comment comment-list comment-body replies reply discussion respond disqus".split(),
    "form": "search search-form login contact-form form newsletter-form feedback".split(),
}


def make_page(seed: int) -> str:
    """One labelled page; the same seed makes the same page."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("aeiourstlnmdkpb") for _ in range(rng.randint(1, 9)))

    def say(low: int, high: int) -> str:
        words = [word() for _ in range(rng.randint(low, high))]
        return " ".join(w + rng.choice(["", "", "", "", "", "", ",", "."]) for w in words).capitalize() + rng.choice([".", ".", "", "?"])

    def named(kind: str, extra: str = "") -> str:
        if rng.random() < 0.12:
            return extra
        return f' {rng.choice(["class", "class", "id"])}="{rng.choice(PARTS[kind])}{rng.choice(["", "", " " + word()])}"{extra}'

    def link(low: int = 1, high: int = 4) -> str:
        return f'<a href="/{word()}">{say(low, high).rstrip(".?,")}</a>'

    def links(n: int) -> str:
        return rng.choice([lambda: "<ul>" + "".join(f"<li>{link()}</li>" for _ in range(n)) + "</ul>", lambda: " | ".join(link() for _ in range(n)), lambda: "".join(f"<div>{link()}</div>" for _ in range(n))])()

    def inline(text: str) -> str:
        words = text.split(" ")
        if len(words) > 5 and rng.random() < 0.4:
            i = rng.randrange(len(words) - 2)
            words[i] = rng.choice([f'<a href="#">{words[i]}</a>', f"<b>{words[i]}</b>", f"<em>{words[i]}</em>", f"<b>{words[i]}"])
        return " ".join(words)

    def para() -> str:
        text = inline(say(*rng.choice([(1, 3), (4, 12), (12, 60), (30, 150), (60, 200)])))
        return rng.choice([f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}</p>", f"<p>{text}", f"{text}<br><p>{text}</p>"])

    def piece() -> str:
        return rng.choice([
            para, para, para, para, para, para, para, lambda: f"<h2>{say(1, 8)}</h2>", lambda: f"<h3>{say(1, 8)}</h3>",
            lambda: f"<blockquote>{para()}</blockquote>", lambda: f"<blockquote>{say(5, 40)}</blockquote>", lambda: "<ul>" + "".join(f"<li>{inline(say(2, 25))}</li>" for _ in range(rng.randint(2, 6))) + "</ul>",
            lambda: "<ol>" + "".join(f"<li>{say(2, 25)}" for _ in range(3)) + "</ol>", lambda: f"<pre>{say(5, 30)}</pre>", lambda: f"<div>{say(10, 80)}</div>",
            lambda: "<table>" + "".join(f"<tr><td>{say(1, 3)}</td><td>{say(1, 3)}</td></tr>" for _ in range(3)) + "</table>", lambda: f"<figure><img src=x><figcaption>{say(3, 15)}</figcaption></figure>",
        ])()

    def menu() -> str:
        tag = rng.choice(["nav", "nav", "div", "ul"])
        return f"<ul{named('menu')}>" + "".join(f"<li>{link()}</li>" for _ in range(5)) + "</ul>" if tag == "ul" else f"<{tag}{named('menu')}>{links(rng.randint(3, 9))}</{tag}>"

    def advert() -> str:
        tag = rng.choice(["div", "div", "aside", "section"])
        return f"<{tag}{named('ad')}>{rng.choice([say(2, 30), link(2, 8), '<p>' + say(3, 25) + '</p>'])}</{tag}>"

    def notice() -> str:
        tag = rng.choice(["div", "div", "section", "aside", "dialog"])
        return f"<{tag}{named('notice')}>{rng.choice([say(4, 40), '<p>' + say(5, 40) + '</p>' + link()])}<button>{word()}</button></{tag}>"

    def side() -> str:
        tag = rng.choice(["aside", "aside", "div", "section"])
        return f"<{tag}{named('side')}><h3>{say(1, 3)}</h3>{rng.choice([links(rng.randint(2, 6)), '<p>' + say(4, 30) + '</p>'])}</{tag}>"

    def form() -> str:
        return f"<form{named('form')}><p>{say(2, 12)}</p><label>{word()}</label><input name=q><button>{word()}</button></form>"

    def comments() -> str:
        tag = rng.choice(["section", "div", "div", "ol"])
        one = lambda: rng.choice([*["<div{}>{}</div>", "<li{}>{}</li>"] * 12, "<article{}>{}</article>"]).format(named("comment"), f"<p>{say(1, 2)}</p>" * rng.randint(0, 1) + f"<p>{say(3, 90)}</p>")
        name = f' {rng.choice(["class", "id"])}="{rng.choice(PARTS["comment"])}"'
        return f"<{tag}{name}><h3>{say(1, 3)}</h3>{''.join(one() for _ in range(rng.randint(1, 5)))}</{tag}>"

    def header() -> str:
        tag = rng.choice(["header", "header", "div"])
        return f"<{tag}{named('header')}>{rng.choice([link(), '<h1>' + say(1, 3) + '</h1>', '<p>' + say(2, 9) + '</p>'])}{rng.choice(['', menu()])}</{tag}>"

    def footer() -> str:
        tag = rng.choice(["footer", "footer", "div"])
        return f"<{tag}{named('footer')}>{rng.choice(['', '&copy; '])}{rng.choice([say(3, 30), '<p>' + say(3, 40) + '</p>' + links(3), links(5)])}</{tag}>"

    body = [f"<h1>{say(2, 12)}</h1>"] * (rng.random() < 0.8) + [piece() for _ in range(rng.choice([1, 3, 6, 12]))]
    if rng.random() < 0.15:  # talk, verse or news in brief: many short paragraphs
        body += [f"<p>{say(1, 5)}{rng.choice(['</p>', '</p>', '<br>', ''])}" for _ in range(rng.randint(8, 60))]
    for extra in (advert, side, notice, form):
        if rng.random() < 0.1:
            body.insert(rng.randrange(len(body) + 1), extra().replace(">", " data-content=no>", 1))
    tag, attributes = rng.choice([("article", ""), ("article", ""), ("article", named("content")), ("main", named("content")), ("div", named("content")), ("div", named("content")), ("section", named("content")), ("div", "")])
    pieces = f"<{tag}{attributes} data-content>{''.join(body)}</{tag}>"
    if rng.random() < 0.3:
        pieces = f"<div{rng.choice(['', ' id=wrap', ' class=container'])}>{pieces}{rng.choice(['', side()])}</div>"
    before = [f() for f in (header, menu, notice, advert, form) if rng.random() < 0.5]
    after = [f() for f in (comments, side, advert, form, notice) if rng.random() < 0.35] + [footer()] * (rng.random() < 0.8)
    rng.shuffle(before)
    page = f"<!DOCTYPE html><html><head><title>{say(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}{pieces}{''.join(after)}</body></html>"
    return page if rng.random() < 0.9 else page[: rng.randint(len(page) * 9 // 10, len(page))]


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Add ``main_text``, in place of a column so named: each page's main text, empty for null or empty html. The model has at most MAX_COUNTS entries."""
    pages = without(pages, "main_text")
    schema = pages.select("*").schema.add("main_text", "string")
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.extract(h) for h in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.string())], [*batch.schema.names, "main_text"])

    return pages.mapInArrow(run, schema)

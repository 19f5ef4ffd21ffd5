"""A small tolerant HTML reader: block elements of a page as a tree, with their own text."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

_TAG = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(>|$)", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_UNSEEN = re.compile(r"(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")
_PART = re.compile(r"[a-z]+")
#: Fixed values of the HTML standard: elements without content, and elements whose content is not shown or not markup.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe title textarea".split())
#: Elements left out with their content if they are closed; unclosed ones are read on as any element.
SKIPPED = frozenset("object svg canvas audio video select button datalist annotation annotation-xml".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img input math semantics mi mn mo ms mtext mspace mrow mfrac msqrt mroot mstyle merror mpadded mphantom msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd".split())
#: An opening tag on the left closes open elements on the right.
_CLOSES = {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}


@dataclass
class Node:
    tag: str
    parent: int
    hints: tuple[str, ...] = ()
    chars: int = 0
    linked: int = 0
    commas: int = 0
    marked: bool = False
    hidden: bool = False  # not shown, like all below it


@dataclass
class Page:
    """Nodes in document order (a parent precedes its children), and the text runs with the node that each belongs to."""

    nodes: list[Node] = field(default_factory=list)
    runs: list[tuple[int, str]] = field(default_factory=list)


def raw_end(source: str, name: str, at: int) -> int:
    """The place after the end tag of a RAW element, or the end of the page."""
    stop = re.compile(f"</{name}\\s*>", re.I).search(source, at)
    return stop.end() if stop else len(source)


def skipped_ends(source: str) -> dict[int, int]:
    """For each SKIPPED element that is closed: the place after its end tag, by the place after its start tag."""
    ends: dict[int, int] = {}
    started: dict[str, list[int]] = {}
    at = 0
    while tag := _TAG.search(source, at):
        at = tag.end()
        name = (tag[2] or "").lower()
        if not tag[4]:
            continue
        if name in RAW and not tag[1]:
            at = raw_end(source, name, at)
        elif name == "svg" and tag[3].endswith("/"):
            continue
        elif name in SKIPPED and not tag[1]:
            started.setdefault(name, []).append(at)
        elif started.get(name):
            ends[started[name].pop()] = at
    return ends


def attributes(inside: str) -> tuple[tuple[str, ...], bool | None, bool]:
    """Of a start tag: the words of its class, id and role, its label if it has one, and whether the element is hidden."""
    hints: list[str] = []
    marked, hidden = None, False
    for key, a, b, c in _ATTR.findall(inside) if inside else ():
        key, value = key.lower(), (a or b or c).lower()
        if key == "data-content":
            marked = value != "no"
        elif key == "hidden":
            hidden = True
        elif key == "style":
            hidden = hidden or bool(_UNSEEN.search(value))
        elif key in ("class", "id", "role"):
            hints += _PART.findall(value)
    return tuple(dict.fromkeys(hints)), marked, hidden


def parse(source: str | None) -> Page:
    """Read a whole page. Truncated or unbalanced markup is closed as browsers do in the common cases."""
    page = Page([Node("body", -1)])
    if not source:
        return page
    nodes, runs = page.nodes, page.runs
    open_tags: list[str] = []  # all open elements
    places: dict[str, list[int]] = {}  # places in open_tags by name, so that no tag looks through all of them
    solid: list[int] = []  # places in open_tags of those that are not inline
    blocks: list[tuple[int, int, bool]] = [(0, 0, True)]  # (node, depth of open_tags, whether it breaks lines) of open block elements
    links = 0
    at = 0

    def close(to: int) -> None:
        nonlocal links
        while len(open_tags) > to:
            gone = open_tags.pop()
            places[gone].pop()
            links -= gone == "a"
        while solid and solid[-1] >= to:
            solid.pop()
        while len(blocks) > 1 and blocks[-1][1] > len(open_tags):
            if blocks.pop()[2]:
                runs.append((-1, ""))

    def begin(name: str) -> None:
        places.setdefault(name, []).append(len(open_tags))
        if name not in INLINE:
            solid.append(len(open_tags))
        open_tags.append(name)

    def text(raw: str) -> None:
        if not raw or places.get("head"):
            return
        value = html.unescape(raw) if "&" in raw else raw
        node = nodes[blocks[-1][0]]
        size = len(value) - value.count(" ")
        if size:
            node.chars += size
            node.linked += size if links > 0 else 0
            node.commas += value.count(",") + value.count(". ")
        runs.append((blocks[-1][0], value))

    end = len(source)
    skipped: dict[int, int] | None = None  # read when the first such element is met
    while at < end:
        tag = _TAG.search(source, at)
        if tag is None:
            rest = source[at:]
            text(rest)
            break
        text(source[at : tag.start()])
        at = tag.end()
        name = tag[2]
        if name is None or not tag[4]:
            continue  # a comment, a declaration, or a tag cut off by the end
        name = name.lower()
        if tag[1]:
            if places.get(name):
                k = places[name][-1]
                if name in INLINE and solid and solid[-1] > k:
                    continue
                close(k)
            continue
        if name in RAW:
            at = raw_end(source, name, at)
            continue
        if tag[3].endswith("/") and name in ("svg", "math"):
            continue
        if name in SKIPPED:
            if skipped is None:
                skipped = skipped_ends(source)
            if at in skipped:
                at = skipped[at]
                continue
        if name == "br":
            runs.append((blocks[-1][0], " "))
            continue
        if name in VOID:
            if name == "hr":
                runs.append((-1, ""))
            continue
        if name in ("html", "body"):
            if places.get("head"):
                close(places["head"][0])
            continue
        if name in INLINE:
            begin(name)
            links += name == "a"
            if tag[3] and attributes(tag[3])[2]:
                nodes.append(Node(name, blocks[-1][0], hidden=True))
                blocks.append((len(nodes) - 1, len(open_tags), False))
            continue
        wanted = _CLOSES.get(name, {"p"})
        while solid and open_tags[solid[-1]] in wanted:
            close(solid[-1])
        hints, marked, hidden = attributes(tag[3])
        parent = blocks[-1][0]
        begin(name)
        runs.append((-1, ""))
        nodes.append(Node(name, parent, hints, marked=nodes[parent].marked if marked is None else marked, hidden=hidden or nodes[parent].hidden))
        blocks.append((len(nodes) - 1, len(open_tags), True))
    return page


def join(page: Page, keep: list[bool]) -> str:
    """Text of the kept nodes: one line a block, white space inside it as one space."""
    lines, now = [], []
    for node, value in page.runs:
        if node < 0:
            if now:
                lines.append(" ".join("".join(now).split()))
                now = []
        elif keep[node] and not page.nodes[node].hidden:
            now.append(value)
    if now:
        lines.append(" ".join("".join(now).split()))
    return "\n".join(x for x in lines if x)

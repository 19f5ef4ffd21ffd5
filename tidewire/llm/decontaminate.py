"""Approximate matches of benchmark items in documents: exact pieces first, then bit-parallel edit distance."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import texts_in_small_batches

_ODD = re.compile(r"[\W_]+")
#: Characters of benchmark text that one pass over the documents handles; more items take more passes.
PASS_CHARS = 4_000_000
ERROR_RATE = 0.08


def normal(text: str | None) -> str:
    """Lower case; every run of characters other than letters and digits is one space."""
    return _ODD.sub(" ", text.lower()).strip() if text else ""


def budget(length: int, rate: float) -> int:
    return int(length * rate)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """``errors`` + 1 disjoint pieces that cover an item, with their offsets: so many edits leave one piece whole."""
    n = len(item)
    cuts = [n * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str, most: int) -> int | None:
    """Least edit distance of ``pattern`` to any substring of ``text`` if it is at most ``most``."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, min(m, most + 1)
    for c in text:
        eq = masks.get(c, 0)
        x = eq | down
        d0 = (((x & up) + up) ^ up) | x
        right, left = down | (full & ~(d0 | up)), d0 & up
        if right & last:
            score += 1
        elif left & last:
            score -= 1
            if score < best:
                best = score
                if not best:
                    return 0
        right, left = right << 1, left << 1
        up, down = (left | (full & ~(d0 | right))) & full, right & d0 & full
    return best if best <= most else None


class Matcher:
    """All pieces of some items in one automaton; items without any error in their budget match between word ends if ``word_ends``."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float, word_ends: bool = True):
        import ahocorasick

        self.items = [(i, t, budget(len(t), rate)) for i, t in items]
        where: dict[str, list[tuple[int, int]]] = {}
        for at, (_, text, errors) in enumerate(self.items):
            for offset, piece in pieces(text, errors) if text else ():
                where.setdefault(piece if errors or not word_ends else f" {piece} ", []).append((at, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, found in where.items():
            self.automaton.add_word(piece, (len(piece), found))
        if where:
            self.automaton.make_automaton()
        self.empty = not where

    def find(self, text: str | None) -> dict[int | None, int]:
        """Least distance by item id of all items within their budget anywhere in the whole text."""
        best: dict[int | None, int] = {}
        body = normal(text)
        if self.empty or not body:
            return best
        body = f" {body} "
        tried: dict[int, set[int]] = {}
        for end, (size, found) in self.automaton.iter(body):
            for at, offset in found:
                item_id, item, errors = self.items[at]
                if best.get(item_id) == 0:
                    continue
                if not errors:
                    best[item_id] = 0
                    continue
                start = end + 1 - size - offset
                span = errors + 1
                done = tried.setdefault(at, set())
                if start // span in done:
                    continue
                done.add(start // span)
                low = start // span * span  # all starts of this stretch at once
                if body.startswith(item, start):
                    best[item_id] = 0
                    continue
                got = myers(item, body[max(0, low - errors) : low + span + len(item) + errors], errors)
                if got is not None and got < best.get(item_id, errors + 1):
                    best[item_id] = got
        return best


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, pass_chars: int = PASS_CHARS, word_ends: bool = True) -> DataFrame:
    """Rows (doc_id, item_id, distance): each benchmark item found in a document with at most ``rate`` edits a character.

    Texts are compared after ``normal``. Null or empty texts and items without letters or digits match nothing. Items so short
    that their budget has no error are found whole, with ``word_ends`` only between word ends. Repeated rows of a pair give
    one row with the least distance; so do all items with a null item_id. Items go to the executors in passes of about ``pass_chars`` characters.
    """
    texts_in_small_batches(docs.sparkSession)
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = items.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    passes = total // pass_chars + 1
    found = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == k).collect()
        shared = docs.sparkSession.sparkContext.broadcast(sorted(((r.item_id, normal(r.text)) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate, word_ends)
            for batch in batches:
                got = [(d, i, e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, e in matcher.find(t).items()]
                yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in got], pa.int64()) for j in range(3)], ["doc_id", "item_id", "distance"])

        rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, distance long")
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))

"""Places of lexicon terms in texts, with their offsets and the text around them.

A term stands where no letter a-z or digit touches it. Lexicons are tables that a caller gives. Up to ``limit`` terms become
one automaton that finds all of them in one pass over a text; of larger lexicons each part is one more pass, with the same result. Terms may claim their places, longest first, so ``crypto exchange`` leaves nothing for ``exchange`` there.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from tidewire.functions.text import pieces

#: Terms that one automaton has at most; it is sent to all executors.
MOST_TERMS = 100_000
#: Endings that a term may have besides none, where plurals count.
PLURALS = ("s", "es")
#: What takes a place: nothing, terms of the same group, or all terms.
NONE, GROUP, ALL = "none", "group", "all"

Place = tuple[int, int, int]


def automaton(terms: list[str], plural: bool = False) -> ahocorasick.Automaton:
    """Finds all terms at once; the value of a spelling has the length and number of each term spelled so."""
    found: dict[str, list[tuple[int, int]]] = {}
    for number, term in enumerate(terms):
        for end in ("", *PLURALS) if plural else ("",):
            found.setdefault(term + end, []).append((len(term + end), number))
    out = ahocorasick.Automaton()
    for spelling, value in found.items():
        out.add_word(spelling, value)
    if found:
        out.make_automaton()
    return out


def _solid(char: str) -> bool:
    return "a" <= char <= "z" or "0" <= char <= "9"


def term_spans(text: str, finder: ahocorasick.Automaton, overlap: bool = False) -> list[Place]:
    """Places (first, end, term) of all terms that nothing solid touches; places of one term do not overlap one another unless ``overlap``."""
    out, last, size = [], {}, len(text)
    if not len(finder):
        return out
    for end, value in finder.iter(text):
        end += 1
        if end < size and _solid(text[end]):
            continue
        for length, number in value:
            first = end - length
            if (overlap or first >= last.get(number, 0)) and not (first and _solid(text[first - 1])):
                last[number] = end
                out.append((first, end, number))
    return out


def claimed(places: list[Place], ranks: list[int], every: bool) -> list[Place]:
    """Those places that are free when terms claim theirs by rank; of a term all or, without ``every``, the first."""
    taken: list[tuple[int, int]] = []
    done, out = set(), []
    for place in sorted(places, key=lambda p: (ranks[p[2]], p[0])):
        first, end, number = place
        if not every and number in done:
            continue
        i = bisect.bisect_left(taken, (first, end))
        if (i < len(taken) and taken[i][0] < end) or (i and taken[i - 1][1] > first):
            continue
        taken.insert(i, (first, end))
        done.add(number)
        out.append(place)
    return out


def _settled(places: list[Place], lexicon: list[tuple[str, list[str]]], claim: str, every: bool) -> list[tuple[int, int, int, str]]:
    """Places (first, end, term, group) that stay; lexicon: terms, in the order in which they claim, and their groups."""
    if claim == GROUP:
        by_group: dict[str, list[Place]] = {}
        for p in places:
            for group in lexicon[p[2]][1]:
                by_group.setdefault(group, []).append(p)
        return [(*p, group) for group, own in by_group.items() for p in claimed(own, range(len(lexicon)), every)]
    if claim == ALL:
        places = claimed(places, range(len(lexicon)), every)
    elif not every:
        first: dict[int, Place] = {}
        for p in places:
            first.setdefault(p[2], p)
        places = list(first.values())
    return [(*p, group) for p in places for group in lexicon[p[2]][1]]


def _terms(lexicon: DataFrame) -> DataFrame:
    """Rows (term, groups, turn) of a lexicon, each term once."""
    turn = F.col("turn").cast("int") if "turn" in lexicon.columns else F.lit(0)
    known = lexicon.select(F.coalesce(F.col("group").cast("string"), F.lit("")).alias("group"), F.col("term").cast("string").alias("term"), turn.alias("turn")).where("term <> ''")
    return known.groupBy("term").agg(F.sort_array(F.collect_set("group")).alias("groups"), F.coalesce(F.min("turn"), F.lit(0)).alias("turn"))


def term_places(texts: DataFrame, lexicon: DataFrame, claim: str = NONE, every: bool = True, plural: bool = False, window: int = 0, limit: int = MOST_TERMS, overlap: bool = False) -> DataFrame:
    """Rows (id, group, term, first, end, before, after) of the places of terms in texts.

    texts: id, text (lower case, as ``plain_words`` or ``plain_marks`` give it); lexicon: group, term. A term under several
    groups gives a row for each. ``claim``: whether a place counts only if no longer term, of the same group or of any, took it
    (ties: the term that sorts first); with a column ``turn`` in the lexicon
    all terms of a lower turn come before. Without ``every`` a term counts once a text, at its first place that is free.
    ``plural``: a term may end in s or es. ``overlap``: without claims places of one term may overlap one another. ``window``: so many characters before and after a place come with it. ``first`` and
    ``end`` count characters from 0. Null and empty texts have no places, null and empty terms none either; repeated rows of
    texts count each, repeated rows of the lexicon once.
    """
    terms = _terms(lexicon)
    rows = terms.limit(limit + 1).collect()
    if len(rows) <= limit:
        return _one_pass(texts, rows, claim, every, plural, window, overlap)
    parts = -(-terms.count() // max(1, limit // 2))  # by hash, so a part may be somewhat larger than the mean
    dealt = [terms.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == i).collect() for i in range(parts)]
    if claim == NONE and every:
        return reduce(DataFrame.unionAll, (_one_pass(texts, rows, claim, every, plural, window, overlap) for rows in dealt))
    return _claimed_later(texts, dealt, terms.select("term", "turn"), claim, every, plural, window)


HITS = "array<struct<group:string,term:string,value:string,rank:int,first:int,end:int,before:string,after:string"


def term_hits(text: Column, lexicon: list[tuple[str, str, str | None]], beside: tuple[tuple[str, str], ...] = (), facts: tuple[list[dict], str] | None = None, window: int = 0) -> Column:
    """All places of a small lexicon's terms in a text, as an array beside the text's other columns; for up to ``MOST_TERMS`` of them.

    lexicon: (group, term, value); ``rank`` is a row's place in it. Hits come in the order of their ends. For each (left, right) of
    ``beside`` the first two hits of these groups with one character between them, of longer terms where several begin there, come again
    as groups ``left+right`` and ``left+right>``. ``facts``: what is known of each row of the lexicon, and the type, for a further field. ``window``: so many characters before and
    after a place come with it; expressions over hits should look at these and not at the text, which Spark may work out again for each hit. Null and empty texts have an empty array, null and empty terms are passed over.
    """
    lexicon = [(g, t, v) for g, t, v in lexicon]
    if len(lexicon) > MOST_TERMS:
        raise ValueError(f"more than {MOST_TERMS} terms; term_places takes any number")

    known, known_type = facts or ([None] * len(lexicon), "string")
    kinds = to_arrow_type(_parse_datatype_string(known_type))

    @F.arrow_udf(f"{HITS},facts:{known_type}>>")
    def run(column: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = [i for i, (_, t, _) in enumerate(lexicon) if t]
        finder = automaton([lexicon[i][1] for i in numbers])
        of_term = [pa.array([x[k] for x in lexicon], pa.string()) for k in (1, 2)]
        of_facts = pa.array(known, kinds)
        for batch in column:
            for texts in pieces(batch):
                ends, rows, around = [0], [], ([], [])
                for text in texts.to_pylist():
                    places = [(a, b, numbers[n]) for a, b, n in term_spans(text, finder)] if text else []
                    hits = [(lexicon[n][0], n, a, b) for a, b, n in places]
                    for left, right in beside:
                        hits += _neighbours(places, lexicon, left, right)
                    for _, _, a, b in hits:
                        around[0].append(text[max(0, a - window) : a])
                        around[1].append(text[b : b + window])
                    rows += hits
                    ends.append(len(rows))
                group, rank, first, end = zip(*rows) if rows else ((),) * 4
                rank = pa.array(rank, pa.int32())
                fields = {"group": pa.array(group, pa.string()), "term": of_term[0].take(rank), "value": of_term[1].take(rank), "rank": rank, "first": pa.array(first, pa.int32()), "end": pa.array(end, pa.int32())}
                fields |= {"before": pa.array(around[0], pa.string()), "after": pa.array(around[1], pa.string()), "facts": of_facts.take(rank)}
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(list(fields.values()), list(fields)))

    return run(text)


def _neighbours(places: list[Place], lexicon: list[tuple[str, str, str | None]], left: str, right: str) -> list[tuple[str, int, int, int]]:
    """The first place of a term of one group with one of the other group after it, as two hits (group, rank, first, end)."""
    after: dict[int, Place] = {}
    for p in places:
        if lexicon[p[2]][0] == right and p[1] > after.get(p[0], (0, 0, 0))[1]:
            after[p[0]] = p
    pairs = [(p[0], p[0] - p[1], p[2], after[p[1] + 1]) for p in places if lexicon[p[2]][0] == left and p[1] + 1 in after]
    if not pairs:
        return []
    first, size, n, other = min(pairs)
    return [(f"{left}+{right}", n, first, first - size), (f"{left}+{right}>", other[2], *other[:2])]


def places_by_lexicon(texts: DataFrame, asked: dict[str, tuple[DataFrame, dict]], limit: int = MOST_TERMS) -> DataFrame:
    """Rows (lexicon, *those of ``term_places``) of several lexicons, from one pass over the texts if each has at most ``limit`` terms.

    asked: by name, each lexicon and the options of ``term_places`` for it.
    """
    if not all(len(_terms(lexicon).limit(limit + 1).take(limit + 1)) <= limit for lexicon, _ in asked.values()):
        return reduce(DataFrame.unionAll, (term_places(texts, lexicon, **options, limit=limit).select(F.lit(name).alias("lexicon"), "*") for name, (lexicon, options) in asked.items()))
    return _pass(texts, [Asked(name, _terms(lexicon).collect(), **options) for name, (lexicon, options) in asked.items()])


class Asked(NamedTuple):
    """A lexicon of few terms and how its places are looked for, as in ``term_places``."""

    name: str
    rows: list
    claim: str = NONE
    every: bool = True
    plural: bool = False
    window: int = 0
    overlap: bool = False


def _one_pass(texts: DataFrame, rows: list, claim: str, every: bool, plural: bool, window: int, overlap: bool = False) -> DataFrame:
    """``term_places`` of few terms."""
    return _pass(texts, [Asked("", rows, claim, every, plural, window, overlap)]).drop("lexicon")


def _pass(texts: DataFrame, asked: list[Asked]) -> DataFrame:
    """``places_by_lexicon`` of few terms."""
    sorted_ = [a._replace(rows=[(r.term, list(r.groups)) for r in sorted(a.rows, key=lambda r: (r.turn, -len(r.term), r.term))]) for a in asked]
    shared = texts.sparkSession.sparkContext.broadcast([tuple(a) for a in sorted_])  # a bounded number of terms
    kind = texts.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = [(a, automaton([t for t, _ in a.rows], a.plural)) for a in (Asked(*x) for x in shared.value)]
        for batch in batches:
            keys, at = batch.column("id"), 0
            for part in pieces(batch.column("text")):
                rows: list[tuple] = []
                for i, text in enumerate(part.to_pylist(), at):
                    for a, finder in each if text else ():
                        places = term_spans(text, finder, a.overlap and a.claim == NONE)
                        if places:
                            rows += [(a.name, i, g, a.rows[t][0], first, end, text[max(0, first - a.window) : first], text[end : end + a.window]) for first, end, t, g in _settled(places, a.rows, a.claim, a.every)]
                at += len(part)
                names, numbers, *columns = list(zip(*rows)) or [()] * 8
                kinds = (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), keys.take(pa.array(numbers, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["lexicon", "id", "group", "term", "first", "end", "before", "after"])

    return texts.select("id", "text").mapInArrow(run, f"lexicon string, id {kind}, group string, term string, first int, end int, before string, after string")


def _claimed_later(texts: DataFrame, dealt: list[list], turns: DataFrame, claim: str, every: bool, plural: bool, window: int) -> DataFrame:
    """``term_places`` of a lexicon in several parts: a pass over the texts finds the places of a part, then each text's places claim.

    Equal rows of texts are searched once and counted again at the end, so that a text's places can be gathered by key.
    """
    rows = texts.where("text <> ''").groupBy("id", "text").agg(F.count("*").alias("_m")).withColumn("_key", F.sha2(F.concat(F.coalesce(F.col("id").cast("string"), F.lit("\u0001")), F.lit("\u0000"), F.col("text")), 256))
    keyed = rows.select(F.col("_key").alias("id"), "text")
    found = reduce(DataFrame.unionAll, (_one_pass(keyed, part, NONE, True, plural, window) for part in dealt))

    def run(table: pa.Table) -> pa.Table:
        cells = list(zip(*(table.column(c).to_pylist() for c in ("term", "group", "first", "end"))))
        turn = dict(zip(table.column("term").to_pylist(), table.column("turn").to_pylist()))
        order = sorted(turn, key=lambda t: (turn[t], -len(t), t))
        number, groups = {t: n for n, t in enumerate(order)}, [set() for _ in order]
        row = {}
        for i, (t, g, a, b) in enumerate(cells):
            groups[number[t]].add(g)
            row[a, b, number[t], g] = i
        places = sorted({(a, b, number[t]) for t, _, a, b in cells}, key=lambda p: (p[1], p[0]))
        kept = _settled(places, [(t, sorted(groups[n])) for n, t in enumerate(order)], claim, every)
        return table.take(pa.array([row[p] for p in kept], pa.int64()))

    found = found.join(turns, "term").select(*found.columns, "turn")
    kept = found.groupBy("id").applyInArrow(run, found.schema).withColumnRenamed("id", "_key")
    again = rows.select("_key", "id", F.explode(F.array_repeat(F.lit(0), F.col("_m").cast("int"))))
    return kept.join(again, "_key").select("id", "group", "term", "first", "end", "before", "after")

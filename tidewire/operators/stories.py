"""Reports of one story across sources: greedy clusters by titles, as joins on pairs of tokens."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.functions.text import tokens
from tidewire.operators.lineage import cut

#: Least overlap of the smaller title, common tokens that are enough, that are with a shared country, and hours apart.
OVERLAP, STRONG, ASSISTED, HOURS = 0.5, 3, 2, 48
_BAND = HOURS * 3_600_000_000
#: Pairs that keys may bring together for each row of keys, or at all, for the graph of similar pairs to be made; the result is the same.
PAIRS_A_ROW, FEW = 100, 100_000
#: Items and similar pairs that one task settles in order; the result is the same for any.
BLOCK = 4_000_000


def overlap(a: Column, b: Column) -> Column:
    """Common share of the smaller of two token sets; 0 if one is empty."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(0.0)


def _pairs(bands: Column) -> Column:
    """A key for each pair of an item's tokens and each band: similar items share two tokens, so they share such a key."""
    ordered = F.array_sort("words")
    pairs = F.flatten(F.transform(ordered, lambda a: F.transform(F.filter(ordered, lambda b: b > a), lambda b: F.concat_ws(" ", a, b))))
    return F.flatten(F.transform(bands, lambda band: F.transform(pairs, lambda p: F.xxhash64("domain", p, band))))


def _matches() -> Column:
    """Whether an item matches another one, whose columns begin with an underscore."""
    near = F.coalesce(F.abs(F.col("micros") - F.col("_micros")) <= _BAND, F.lit(True))
    least = F.least(F.size("words"), F.size("_words"))
    needed = F.greatest(F.when(F.coalesce(F.col("place") == F.col("_place"), F.lit(False)), ASSISTED).otherwise(STRONG), F.ceil(least * OVERLAP))
    return (F.col("domain") == F.col("_domain")) & near & (F.size(F.array_intersect("words", "_words")) >= needed)


def _similar(pairs: DataFrame, items: DataFrame) -> DataFrame:
    """Of rows (ordinal, seed) those whose item, the later one, matches its seed."""
    seed = items.select(F.col("ordinal").alias("seed"), *(F.col(c).alias(f"_{c}") for c in ("domain", "words", "place", "micros")))
    met = pairs.where("seed < ordinal").distinct().join(items, "ordinal").join(seed, "seed")
    return met.where(_matches()).select("ordinal", "seed")


def _bands(timed: int, *shifts: int) -> Column:
    """Keys of an item in its own band, shifted; ``timed`` 0 gives keys without a band instead."""
    band = F.floor(F.col("micros") / _BAND)
    return _pairs(F.array(*(band + s for s in shifts)) if timed else F.array(F.lit(-1).cast("long")))


def _meetings(items: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Pairs of tables (the items' columns, key): of each two items that may match, one of each table of some pair share a key.

    Items with times meet in their band or the one before. Those without meet all, apart, so they do not make the others meet across all time.
    """
    timed, timeless = items.where("micros IS NOT NULL"), items.where("micros IS NULL")
    keyed = lambda rows, keys: rows.select("ordinal", "domain", "words", "place", "micros", F.explode(keys).alias("key"))
    return [(keyed(timed, _bands(1, 0)), keyed(timed, _bands(1, 0, 1))), (keyed(timeless, _bands(0)), keyed(items, _bands(0)))]


def _few_pairs(items: DataFrame) -> bool:
    """Whether the items' keys bring together at most PAIRS_A_ROW pairs for each row of keys, or FEW at all; counted, not made."""
    for left, right in _meetings(items):
        mine, theirs = (x.groupBy("key").agg(F.count("*").cast("double").alias(n)) for x, n in ((left, "a"), (right, "b")))
        pairs, rows = mine.join(theirs, "key").agg(F.sum(F.col("a") * F.col("b")), F.sum(F.col("a") + F.col("b"))).first()
        if (pairs or 0) > max(FEW, PAIRS_A_ROW * (rows or 0)):
            return False
    return True


def _graph(items: DataFrame) -> DataFrame:
    """Rows (ordinal, seed) of all similar pairs, each once: items meet with all that the match looks at, and only at the key of their first two common tokens."""
    found = []
    for timed, (left, right) in enumerate(reversed(_meetings(items))):
        met = left.join(right.select("key", *(F.col(c).alias(f"_{c}") for c in ("ordinal", "domain", "words", "place", "micros"))), "key")
        band = F.floor(F.col("micros") / _BAND)
        both = (band == F.floor(F.col("_micros") / _BAND)) if timed else F.col("_micros").isNull()
        met = met.where(F.when(both, F.col("ordinal") > F.col("_ordinal")).otherwise(F.col("ordinal") != F.col("_ordinal")) & _matches())
        common = F.array_sort(F.array_intersect("words", "_words"))
        at = F.xxhash64("domain", F.concat_ws(" ", F.get(common, 0), F.get(common, 1)), band if timed else F.lit(-1).cast("long"))
        found.append(met.where(F.col("key") == at).select(F.greatest("ordinal", "_ordinal").alias("ordinal"), F.least("ordinal", "_ordinal").alias("seed")))
    return found[0].union(found[1])


def _settled(table: pa.Table) -> pa.Table:
    """Rows (block, ordinal, first) of a block's items, in order: one begins a story if no item that does is similar, before the block (``hit``) or in it."""
    table = table.sort_by("ordinal")
    ordinals, seeds, hit = table.column("ordinal").to_numpy(), table.column("seeds").combine_chunks(), table.column("hit").to_numpy().copy()
    later = np.repeat(np.arange(len(ordinals)), seeds.value_lengths().fill_null(0).to_numpy())
    seed = np.searchsorted(ordinals, seeds.flatten().to_numpy(zero_copy_only=False))
    later, ends = later[np.argsort(seed, kind="stable")], np.cumsum(np.bincount(seed, minlength=len(ordinals)))
    first = np.zeros(len(ordinals), bool)
    for i, end in enumerate(ends.tolist()):
        if not hit[i]:
            first[i] = True
            hit[later[ends[i - 1] if i else 0 : end]] = True
    return pa.table([table.column("block"), table.column("ordinal"), pa.array(first)], ["block", "ordinal", "first"])


def _firsts_of_graph(items: DataFrame, edges: DataFrame) -> DataFrame:
    """Ordinals of the items that begin a story, from the graph of similar pairs.

    Items are dealt by order into blocks of about BLOCK items and pairs, and each block is settled in order by one task as if no story of another block
    touched it. Then the stories that blocks begin are told to later blocks, and those for which this changes something are settled again, until nothing
    changes: what a block looks at is then right for the first block, so for the second, and so on. An item mostly hangs on near ones, so few rounds do; the
    number of blocks bounds them.
    """
    rows = items.select(F.col("ordinal").cast("double").alias("at")).union(edges.select(F.col("ordinal").cast("double")))
    n = -(-rows.count() // BLOCK)
    cuts = sorted(set(rows.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []

    @F.arrow_udf("int")
    def numbered(at: pa.Array) -> pa.Array:
        return pa.array(np.searchsorted(np.array(cuts, dtype=float), at.to_numpy(zero_copy_only=False), side="right"), pa.int32())

    block = lambda c: numbered(F.col(c).cast("double")) if cuts else F.lit(0)
    dealt = edges.select("ordinal", "seed", block("ordinal").alias("block"), block("seed").alias("seed_block"))
    inner = dealt.where("block = seed_block").groupBy("ordinal").agg(F.collect_list("seed").alias("seeds"))
    nodes = items.select("ordinal", block("ordinal").alias("block")).join(inner, "ordinal", "left")
    kind = items.schema["ordinal"].dataType.simpleString()
    settle = lambda rows: cut(rows.groupBy("block").applyInArrow(_settled, f"block int, ordinal {kind}, first boolean"))
    if not cuts:
        return settle(nodes.withColumn("hit", F.lit(False))).where("first").select("ordinal")
    nodes, across = cut(nodes), cut(dealt.where("block <> seed_block"))
    state, hits = settle(nodes.withColumn("hit", F.lit(False))), None
    while True:
        told = cut(across.join(state.where("first").select(F.col("ordinal").alias("seed")), "seed", "left_semi").select("block", "ordinal").distinct())
        news = told if hits is None else told.join(hits, "ordinal", "left_anti").union(hits.join(told, "ordinal", "left_anti"))
        again = [r.block for r in news.select("block").distinct().collect()]
        if not again:
            return state.where("first").select("ordinal")
        hits = told
        fresh = nodes.where(F.col("block").isin(again)).join(told.select("ordinal", F.lit(True).alias("hit")), "ordinal", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
        state = cut(settle(fresh).union(state.where(~F.col("block").isin(again))))


def stories(reports: DataFrame) -> DataFrame:
    """Rows (item_id, ordinal, story): reports in order of ``ordinal`` (distinct) join the first story whose first report they match, else begin one.

    A story's name is its first report's ordinal; it keeps that report's title, country and time. Reports match in one domain, within 48
    hours (missing times match), when their titles share half of the smaller one's tokens and three tokens, or two and the country.
    reports: item_id, ordinal, domain, title, country, at.

    Where keys (pairs of tokens in a time band) bring few pairs together, the graph of similar pairs is made once and settled in blocks. Where a story is hot, its
    pairs are too many to make: then those reports begin a story that come first for all their keys, what matches them is settled, and the
    rest is looked at again. Both ways give the same stories, and no task holds a whole domain.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    country = F.nullif(F.lower(F.trim("country")), F.lit(""))
    items = cut(reports.select("item_id", "ordinal", F.coalesce("domain", F.lit("")).alias("domain"), tokens(F.coalesce("title", F.lit(""))).alias("words"), country.alias("place"), micros.alias("micros")))
    if _few_pairs(items):
        edges = cut(_graph(items))
        best = edges.join(_firsts_of_graph(items, edges).withColumnRenamed("ordinal", "seed"), "seed").groupBy("ordinal").agg(F.min("seed").alias("story"))
        return items.join(best, "ordinal", "left").select("item_id", "ordinal", F.coalesce("story", "ordinal").alias("story"))
    band, none = F.floor(F.col("micros") / _BAND), F.array().cast("array<long>")
    every = F.array(F.lit(-1).cast("long")) if not items.where("micros IS NULL").isEmpty() else none
    around = lambda *shifts: _pairs(F.concat(F.when(band.isNotNull(), F.array(*(band + s for s in shifts))).otherwise(none), every))
    asks = items.select("ordinal", F.explode(around(0)).alias("key"))
    offer = lambda seeds: items.join(seeds, "ordinal").select(F.col("ordinal").alias("seed"), F.explode(around(-1, 0, 1)).alias("key"))
    left, seeds = items, items.select("ordinal").limit(0)
    while not left.isEmpty():
        if _few_pairs(left):
            seeds = seeds.union(_firsts_of_graph(left, cut(_graph(left))))
            break
        undecided = cut(left.select("ordinal", F.explode_outer(around(0, 1)).alias("key")))
        ranked = undecided.join(undecided.groupBy("key").agg(F.min("ordinal").alias("first")), "key", "left")
        new = cut(ranked.groupBy("ordinal").agg(F.bool_and(F.col("key").isNull() | (F.col("ordinal") == F.col("first"))).alias("ok")).where("ok").select("ordinal"))
        waiting = left.join(new, "ordinal", "left_anti").select("ordinal")
        members = _similar(asks.join(waiting, "ordinal", "left_semi").join(offer(new), "key").select("ordinal", "seed"), items).select("ordinal").distinct()
        left = cut(left.join(new.union(members), "ordinal", "left_anti"))
        seeds = seeds.union(new)
    seeds = cut(seeds)
    rest = items.join(seeds, "ordinal", "left_anti").select("ordinal")
    best = _similar(asks.join(rest, "ordinal", "left_semi").join(offer(seeds), "key").select("ordinal", "seed"), items).groupBy("ordinal").agg(F.min("seed").alias("story"))
    return items.join(best, "ordinal", "left").select("item_id", "ordinal", F.coalesce("story", "ordinal").alias("story"))


def story_cards(members: DataFrame) -> DataFrame:
    """Rows (story, lead, n, n_sources, sources): the lead is the report of highest score, then the latest, then the first.

    members: story, ordinal, item_id, source_id, source_name, score, at. ``sources`` are names in order of members, one for each source.
    """
    order = [F.desc(F.coalesce("score", F.lit(0))), F.desc(F.coalesce(F.unix_micros(F.col("at").cast("timestamp")), F.lit(0))), F.asc("ordinal")]
    ranked = members.withColumn("_rank", F.row_number().over(W.partitionBy("story").orderBy(*order)))
    by_source = ranked.groupBy("story", "source_id").agg(F.min("_rank").alias("_rank"), F.min_by("source_name", "_rank").alias("source_name"), F.count("*").alias("n"), F.min_by("item_id", "_rank").alias("item_id"))
    return by_source.groupBy("story").agg(
        F.min_by("item_id", "_rank").alias("lead"), F.sum("n").alias("n"), F.count("*").alias("n_sources"),
        F.transform(F.array_sort(F.collect_list(F.struct("_rank", "source_name"))), lambda x: x["source_name"]).alias("sources"),
    )

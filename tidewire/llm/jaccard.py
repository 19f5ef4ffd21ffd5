"""Exact n-gram Jaccard join and its components.

Two sets with similarity of at least t percent share one of their first ``n - ceil(t n / 100) + 1`` shingles in any common
order. The order here puts shingles first that few documents have, as far as a sample tells: any order gives the same
links, this one gives few candidates. Sets that share such a shingle meet in tiles of neighbouring size bands. In a tile
512-bit signatures bound each overlap from above before the exact intersection of the sorted hash arrays.

Groups of copies make many equal links. Exact copies are one set. Other sets first meet at one shared shingle, then
only the best-linked set of each component meets others; last, all pairs of sets that still lie in different components and
share a prefix shingle are compared. A tile never compares inside a component, so its work does not grow with
the square of a group of copies.

Before sets' arrays go anywhere, bitmaps sized to the sets go to the tiles of a round. Sets that by their bitmaps may have a
link in a tile are joined there, under the least set so joined. Tiles with the same least set are one candidate group, and a
set is sent whole once to each of its groups; only groups too large for one task fall back to their tiles.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.blocks import column, cuts, scaled
from tidewire.llm.bloom import MAX_IDS, may_have, membership
from tidewire.llm.graph import components
from tidewire.llm.tables import Scratch, forget, texts_in_small_batches
from tidewire.llm.textkit import buffers, chunks, give_back, shingle_sets, tidy

#: One document of so many tells which shingles are frequent; the most frequent MAX_HINTS of them are broadcast.
SAMPLE_ONE_IN = 16
MAX_HINTS = 1_000_000
#: Elements of the sets that one part of a tile, or one candidate group, may have, and the number of its sets.
CHUNK_ELEMENTS = 2_000_000
CHUNK_SETS = 2000
#: Bytes of arrays or bitmaps for one task.
TASK_BYTES = 12 << 20
_FOLD = (np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)).reshape(256, 4, 2).any(2), axis=1) >> 4).reshape(-1)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def needed(n: int | np.ndarray, m: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of sets of n and m shingles that makes them similar."""
    return -(-percent * (n + m) // (100 + percent))


def band(n: np.ndarray, percent: int) -> np.ndarray:
    """Size bands so wide that similar sets lie in the same or in neighbouring ones."""
    return np.floor(np.log(np.maximum(n, 1)) / np.log(100 / percent) + 1e-9).astype(np.int64)


def set_id(values: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sets(batch: pa.RecordBatch, k: int) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """Slices of a batch with about a megabyte of text, and the shingle set of each row."""
    data, offs = buffers(batch.column("text"))
    for a, b in chunks(offs):
        yield batch.slice(a, b - a), shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], k, fold=True)
    give_back()


def signature(values: np.ndarray) -> bytes:
    """Bitmap of a set's hashes by their upper bits; it has twice to four times as many bits as the set has hashes, 64 at least."""
    level = max(6, (2 * len(values) - 1).bit_length())
    marks = np.zeros(1 << level, bool)
    marks[(values >> np.uint64(64 - level)).astype(np.int64)] = True
    return np.packbits(marks).tobytes()


def fold(bits: np.ndarray) -> np.ndarray:
    """Packed bitmaps of half the width: a bit is set where one of two neighbours was."""
    half = _FOLD[bits]
    return half[:, 0::2] << 4 | half[:, 1::2]


def may_link(comps: np.ndarray, n: np.ndarray, signs: list[bytes], percent: int) -> np.ndarray:
    """A label for each set of a tile: sets that, by the bitmaps' bound on overlaps, may be similar have equal labels.

    Sets of one component are not compared. Labels are places of sets; a set that may have no link is alone with its own.
    Bitmaps of similar sets have equal widths or one has twice the other's bits and is folded; that needs 50 percent or more.
    """
    label, width = np.arange(len(n)), np.array([len(x) for x in signs], np.int64)
    for w in np.unique(width):
        narrow, wide = np.flatnonzero(width == w), np.flatnonzero(width == 2 * w)
        bits = np.frombuffer(b"".join(signs[i] for i in narrow), np.uint8).reshape(-1, w)
        if len(wide):
            bits = np.concatenate([bits, fold(np.frombuffer(b"".join(signs[i] for i in wide), np.uint8).reshape(-1, 2 * w))])
        at = np.r_[narrow, wide]
        order = np.argsort(n[at], kind="stable")
        at, bits = at[order], np.ascontiguousarray(bits[order]).view(np.uint64)
        size, comp, step = n[at], comps[at], max(1, (4 << 20) // int(w))
        for p in np.flatnonzero(width[at] == w):
            low, high = np.searchsorted(size, -(-percent * size[p] // 100), "left"), np.searchsorted(size, 100 * size[p] // percent, "right")
            for first in range(low, high, step):
                x = np.arange(first, min(first + step, high))
                x = x[(comp[x] != comp[p]) & (label[at[x]] != label[at[p]])]
                if not len(x):
                    continue
                most = np.minimum(size[p] - np.bitwise_count(bits[p] & ~bits[x]).sum(1, dtype=np.int64), size[x] - np.bitwise_count(bits[x] & ~bits[p]).sum(1, dtype=np.int64))
                hit = x[most >= needed(size[p], size[x], percent)]
                if len(hit):
                    label[np.isin(label, label[at[hit]])] = label[at[p]]
    return label


def frequent_shingles(docs: DataFrame, k: int, one_in: int = SAMPLE_ONE_IN, most: int = MAX_HINTS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of shingles that several sampled documents have, and log2 of their counts. A hint for the order only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distinct = {set_id(x): x for _, sets in _sets(batch, k) for x in sets}
            if distinct:
                values, n = np.unique(np.concatenate(list(distinct.values())), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    sample = docs.where(F.pmod(F.xxhash64(F.lit("hint"), "doc_id"), F.lit(one_in)) == 0).select("text")
    counts = sample.mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 3")
    got = counts.orderBy(F.desc("n"), "h").limit(most).toArrow()
    h, n = got.column("h").to_numpy().view(np.uint64), got.column("n").to_numpy()
    order = np.argsort(h)
    return h[order], np.log2(n[order]).astype(np.uint8)


def in_order(values: np.ndarray, hints: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Sorted hashes with the frequent ones last."""
    hot, level = hints
    if not len(hot) or not len(values):
        return values
    at = np.minimum(np.searchsorted(hot, values), len(hot) - 1)
    known = hot[at] == values
    return values[np.argsort(np.where(known, level[at], 0), kind="stable")] if known.any() else values


def document_sets(docs: DataFrame, k: int, percent: int, hints: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Rows (doc_id, n, sid, prefix, sign): size and id of each document's shingle set, its prefix in the common order, its bitmap."""
    shared = docs.sparkSession.sparkContext.broadcast(hints)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _sets(batch, k):
                prefix = [in_order(x, shared.value)[: prefix_length(len(x), percent)].tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([
                    rows.column("doc_id"), pa.array([len(x) for x in sets], pa.int64()), pa.array([set_id(x) for x in sets], pa.int64()),
                    pa.array(prefix, pa.binary()), pa.array([signature(x) for x in sets], pa.binary()),
                ], names=["doc_id", "n", "sid", "prefix", "sign"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, sid long, prefix binary, sign binary")


def shared_prefixes(rows: DataFrame) -> DataFrame:
    """One row (sid, rep, n, prefix, first, sign) for each set of rows (doc_id, n, sid, prefix, sign), rep being its least doc_id.

    Of a set's prefix only what other sets have too stays, sets without any go. Sets lie in blocks by their id, equal ones
    meet there. A block sends each hash-range shard its distinct prefix shingles, and gets a bit for each: whether several
    sets have it.
    """
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.length("prefix") + F.length("sign")).alias("n")).first().n or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n_blocks, n_shards = max(least, size // (2 << 20)), max(least, size // (4 << 20))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch]).append_column("at", pa.array(np.arange(batch.num_rows)))
            best = table.group_by("sid").aggregate([("doc_id", "min"), ("at", "min")])
            yield from table.take(best.column("at_min")).drop_columns(["doc_id", "at"]).append_column("rep", best.column("doc_id_min")).to_batches()

    def distinct(block: pa.Table) -> pa.Table:
        best = block.append_column("at", pa.array(np.arange(block.num_rows))).group_by("sid").aggregate([("rep", "min"), ("at", "min")]).sort_by("sid")
        return block.take(best.column("at_min")).drop_columns(["rep"]).append_column("rep", best.column("rep_min"))

    @tidy
    def ask(block: pa.Table) -> pa.Table:
        values, n = np.unique(column(distinct(block), "prefix", "u8")[0], return_counts=True)
        to = scaled(values, n_shards)
        runs = list(zip(*cuts(to)))
        return pa.table({
            "shard": pa.array([int(to[a]) for a, _ in runs], pa.int32()), "block": pa.array([block.column("block")[0].as_py()] * len(runs), pa.int64()),
            "values": pa.array([values[a:b].tobytes() for a, b in runs], pa.binary()), "several": pa.array([np.packbits(n[a:b] > 1).tobytes() for a, b in runs], pa.binary()),
        })

    @tidy
    def answer(shard: pa.Table) -> pa.Table:
        values, sizes = column(shard, "values", "u8")
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in zip(shard.column("several").to_pylist(), sizes)]
        order = np.argsort(values, kind="stable")
        a, b = cuts(values[order])
        several = np.empty(len(values), bool)
        several[order] = np.repeat((b - a > 1) | np.maximum.reduceat(np.concatenate(twice)[order], a).astype(bool), b - a) if len(a) else False
        ends = np.cumsum(sizes)
        bits = [np.packbits(several[e - n : e]).tobytes() for n, e in zip(sizes, ends)]
        return pa.table({"block": shard.column("block"), "shard": shard.column("shard"), "n": pa.array(sizes, pa.int64()), "bits": pa.array(bits, pa.binary())})

    @tidy
    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        block = distinct(block)
        values, sizes = column(block, "prefix", "u8")
        known = np.unique(values)
        runs = sorted(zip(got.column("shard").to_pylist(), got.column("n").to_pylist(), got.column("bits").to_pylist()))
        several = np.concatenate([np.unpackbits(np.frombuffer(bits, np.uint8), count=n) for _, n, bits in runs]).astype(bool)
        keep = several[np.searchsorted(known, values)]
        ends = np.cumsum(sizes)
        new = [values[e - n : e][keep[e - n : e]] for n, e in zip(sizes, ends)]
        out = pa.table({
            "sid": block.column("sid"), "rep": block.column("rep"), "n": block.column("n"), "prefix": pa.array([x.tobytes() for x in new], pa.binary()),
            "first": pa.array([int(x[0].view(np.int64)) if len(x) else None for x in new], pa.int64()), "sign": block.column("sign"),
        })
        return out.filter(pa.array([len(x) > 0 for x in new], pa.bool_()))

    some = rows.where("n > 0").select("doc_id", "n", "sid", "prefix", "sign").mapInArrow(first, "n long, sid long, prefix binary, sign binary, rep long")
    blocks = some.withColumn("block", F.pmod("sid", F.lit(n_blocks))).repartition("block")
    asked = blocks.groupBy("block").applyInArrow(ask, "shard int, block long, values binary, several binary")
    answers = asked.groupBy("shard").applyInArrow(answer, "block long, shard int, n long, bits binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "sid long, rep long, n long, prefix binary, first long, sign binary")


def links_in_tile(sids: np.ndarray, comps: np.ndarray, arrays: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that join the components present in a tile as far as pairs of its sets are similar.

    Components grow from their sets outward; a set is only compared with sets of components not reached yet.
    """
    n = np.array([len(x) for x in arrays], np.int64)
    order = np.argsort(n, kind="stable")
    sids, n, arrays = sids[order], n[order], [arrays[i] for i in order]
    names, c = np.unique(comps[order], return_inverse=True)
    if len(names) < 2:
        return []
    offs = np.r_[0, np.cumsum(n)]
    flat = np.concatenate(arrays)
    marks = np.zeros(len(n) * 512, bool)
    marks[np.repeat(np.arange(len(n)) * 512, n) + (flat >> np.uint64(55)).astype(np.int64)] = True
    signs = np.packbits(marks.reshape(len(n), 512), axis=1).view(np.uint64)
    by_comp = np.argsort(c, kind="stable")
    bounds = np.searchsorted(c[by_comp], np.arange(len(names) + 1))
    todo, left, out = np.ones(len(names), bool), len(names), []
    for seed in range(len(names)):
        if not todo[seed]:
            continue
        todo[seed], left = False, left - 1
        queue = deque(by_comp[bounds[seed] : bounds[seed + 1]].tolist())
        while queue and left:
            p = queue.popleft()
            low = np.searchsorted(n, -(-percent * n[p] // 100), "left")
            high = np.searchsorted(n, 100 * n[p] // percent, "right")
            x = np.arange(low, high)
            x = x[todo[c[x]]]
            if not len(x):
                continue
            most = np.minimum(n[p] - np.bitwise_count(signs[p] & ~signs[x]).sum(1, dtype=np.int64), n[x] - np.bitwise_count(signs[x] & ~signs[p]).sum(1, dtype=np.int64))
            want = needed(n[p], n[x], percent)
            x, want = x[most >= want], want[most >= want]
            step = max(1, min(512, 400_000 // max(1, int(n[p]))))
            for i in range(0, len(x), step):
                y = x[i : i + step]
                sizes = n[y]
                first = np.cumsum(sizes) - sizes
                values = flat[np.arange(int(sizes.sum())) - np.repeat(first - offs[y], sizes)]
                own = arrays[p]
                hit = own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values
                for z in y[np.add.reduceat(hit, first, dtype=np.int64) >= want[i : i + step]]:
                    if todo[c[z]]:
                        todo[c[z]], left = False, left - 1
                        out.append((int(sids[p]), int(sids[z])))
                        others = by_comp[bounds[c[z]] : bounds[c[z] + 1]]
                        queue.append(int(z))
                        queue.extend(others[others != z].tolist())
    return out


def _tasks(rows: DataFrame, size: object) -> int:
    """So many tasks that each has about TASK_BYTES, by the sum of a size over rows."""
    total = rows.agg(F.sum(size).alias("n")).first().n or 0
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(total) // TASK_BYTES)


def promising(members: DataFrame, comps: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those rows (tile, part, sid) whose set may have a link in its tile, by bitmaps only; ``to`` is the least set it is joined with."""
    rows = members.join(sets.select("sid", "n", "sign"), "sid").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
    rows = rows.select("tile", "part", "sid", "n", "sign", F.coalesce("comp", "sid").alias("comp"), F.xxhash64("tile", "part").alias("key"))
    tasks = _tasks(members.join(sets.select("sid", "n"), "sid"), F.col("n") / 3 + 64)

    @tidy
    def run(table: pa.Table) -> pa.Table:
        key, sid, comp, n = (table.column(x).to_numpy() for x in ("key", "sid", "comp", "n"))
        signs, order = table.column("sign"), np.argsort(key, kind="stable")
        kept, to = [], []
        for a, b in zip(*cuts(key[order])):
            at = order[a:b]
            label = may_link(comp[at], n[at], [signs[int(i)].as_buffer() for i in at], percent)
            some = np.bincount(label, minlength=len(at))[label] > 1
            least = np.full(len(at), np.iinfo(np.int64).max)
            np.minimum.at(least, label, sid[at])
            kept.append(at[some])
            to.append(least[label[some]])
        kept = np.concatenate(kept)
        return table.select(["tile", "part", "sid", "n"]).take(kept).append_column("to", pa.array(np.concatenate(to), pa.int64()))

    return rows.withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInArrow(run, "tile long, part int, sid long, n long, to long")


def set_arrays(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """Rows (found, rep, arr) of at least the wanted sets (sid, rep), computed again from the text of document ``rep``.

    Few wanted documents are found by a Bloom filter, which keeps nearly all others' texts out of that pass, many by a join.
    """
    docs, count = docs.select(F.col("doc_id").cast("long"), "text"), wanted.count()
    if count > MAX_IDS:
        some = docs.join(wanted.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
    else:
        some = may_have(docs, "doc_id", membership(wanted, "rep", count), nulls=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, sets in _sets(batch, k):
                out = pa.RecordBatch.from_arrays([pa.array([set_id(x) for x in sets], pa.int64()), rows.column("doc_id"), pa.array([x.tobytes() for x in sets], pa.binary())], ["found", "rep", "arr"])
                yield out.filter(pa.array([len(x) > 0 for x in sets], pa.bool_()))

    return some.mapInArrow(run, "found long, rep long, arr binary")


def group_links(kept: DataFrame, comps: DataFrame, ids: DataFrame, docs: DataFrame, k: int, percent: int, every_pair: bool, scratch: Scratch) -> DataFrame:
    """Edges (a, b) that join the components among the sets that ``promising`` kept.

    Sets of one candidate group go to one task. A group too large for that goes by its tiles' parts, and these, unless
    ``every_pair`` of them must be compared, are cut to size.
    """
    sizes = kept.select("to", "sid", "n").distinct().groupBy("to").agg(F.sum("n").alias("elements"), F.count("*").alias("sets"))
    pieces = F.lit(1) if every_pair else F.ceil(F.col("elements") / CHUNK_ELEMENTS)
    large = sizes.where((F.col("elements") > 2 * CHUNK_ELEMENTS) | (F.col("sets") > 2 * CHUNK_SETS))  # few, as each is large
    key = F.when(F.col("elements").isNotNull(), F.xxhash64("tile", "part", F.pmod(F.xxhash64("sid"), pieces))).otherwise(F.xxhash64("to"))
    dealt = scratch.keep(kept.join(large, "to", "left").select(key.alias("key"), "sid", "n").distinct())

    wanted = ids.join(dealt.select("sid"), "sid", "left_semi")
    rows = dealt.select("key", "sid").join(ids.withColumnRenamed("rep", "of"), "sid").join(comps.withColumnRenamed("id", "sid"), "sid", "left")
    rows = rows.join(set_arrays(docs, wanted, k), (F.col("sid") == F.col("found")) & F.col("of").eqNullSafe(F.col("rep")))
    rows = rows.select("key", "sid", F.coalesce("comp", "sid").alias("comp"), "arr")
    tasks = _tasks(dealt, F.col("n") * 8)

    @tidy
    def run(table: pa.Table) -> pa.Table:
        key, sid, comp = (table.column(x).to_numpy() for x in ("key", "sid", "comp"))
        arr, order = table.column("arr"), np.argsort(key, kind="stable")
        out = []
        for a, b in zip(*cuts(key[order])):
            at = order[a:b]
            out += links_in_tile(sid[at], comp[at], [np.frombuffer(arr[int(i)].as_buffer(), np.uint64) for i in at], percent)
        return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([y for _, y in out], pa.int64())})

    edges = scratch.keep(rows.withColumn("task", F.pmod("key", F.lit(tasks))).groupBy("task").applyInArrow(run, "a long, b long"))
    scratch.drop(dealt)
    return edges


def joined(comps: DataFrame, edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Components (id, comp) after further edges: these join components, and ends that were alone."""
    x, y = comps.toDF("i1", "c1"), comps.toDF("i2", "c2")
    between = edges.join(x, F.col("a") == F.col("i1"), "left").join(y, F.col("b") == F.col("i2"), "left")
    found = components(between.select(F.coalesce("c1", "a").alias("a"), F.coalesce("c2", "b").alias("b")), scratch)
    new = found.toDF("from", "to")
    old = comps.join(new, F.col("comp") == F.col("from"), "left").select("id", F.coalesce("to", "comp").alias("comp"))
    alone = new.join(comps, F.col("from") == F.col("id"), "left_anti").toDF("id", "comp")
    out = scratch.keep(old.union(alone))
    scratch.drop(found, comps)
    return out


def prefix_tiles(sets: DataFrame, comps: DataFrame, percent: int, hubs_only: bool) -> DataFrame:
    """Rows (tile, part, sid) of sets of neighbouring size bands that share a prefix shingle but lie in different components.

    ``hubs_only``: component ids in the place of sets, each once for a shingle and band. Equal tiles are one. A large tile is
    dealt over parts: with ``hubs_only`` once, else so that every pair of its sets meets in some part.
    """
    n_shards = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), sets.count() // 20_000)
    rows = sets.join(comps, sets.sid == comps.id, "left").select("sid", "n", "prefix", F.coalesce("comp", "sid").alias("comp"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, sizes = column(batch, "prefix", "u8")
            owner = np.repeat(np.arange(len(sizes)), sizes)
            comp = batch.column("comp").to_numpy()
            ids = comp if hubs_only else batch.column("sid").to_numpy()
            bands = band(batch.column("n").to_numpy(), percent).astype(np.uint16)
            order = np.lexsort((bands[owner], ids[owner], values))
            values, owner = values[order], owner[order]
            if hubs_only:
                new = np.r_[True, (values[1:] != values[:-1]) | (comp[owner[1:]] != comp[owner[:-1]]) | (bands[owner[1:]] != bands[owner[:-1]])][: len(values)]
                values, owner = values[new], owner[new]
            to = scaled(values, n_shards)
            runs = list(zip(*cuts(to)))
            packed = [ids, bands] if hubs_only else [ids, bands, comp]
            arrays = [pa.array([values[a:b].tobytes() for a, b in runs], pa.binary())] + [pa.array([x[owner[a:b]].tobytes() for a, b in runs], pa.binary()) for x in packed]
            yield pa.RecordBatch.from_arrays([pa.array([int(to[a]) for a, _ in runs], pa.int32()), *arrays], names=["shard", "values", "ids", "bands", "comps"][: 2 + len(packed)])

    @tidy
    def meet(table: pa.Table) -> pa.Table:
        values, ids, bands = (column(table, x, t)[0] for x, t in (("values", "u8"), ("ids", "i8"), ("bands", "u2")))
        comp = ids if hubs_only else column(table, "comps", "i8")[0]
        order = np.lexsort((bands, values))
        values, ids, comp, bands = values[order], ids[order], comp[order], bands[order].astype(np.int64)
        found: dict[int, tuple[bytes, int]] = {}
        for a, b in zip(*cuts(values)):
            if b - a < 2 or (comp[a:b] == comp[a]).all():
                continue
            here = bands[a:b]
            for low in np.unique(here):
                x, y = a + np.searchsorted(here, low, "left"), a + np.searchsorted(here, low + 1, "right")
                if y - x < 2 or (comp[x:y] == comp[x]).all():
                    continue
                members = np.unique(ids[x:y])
                found.setdefault(set_id(members), (members.tobytes(), int((100 / percent) ** (low + 2)) + 1))
        return pa.table({"tile": pa.array(list(found), pa.int64()), "members": pa.array([x for x, _ in found.values()], pa.binary()), "most": pa.array([n for _, n in found.values()], pa.int64())})

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile, data, most in zip(*(batch.column(x).to_pylist() for x in ("tile", "members", "most"))):
                members = np.frombuffer(data, np.int64)
                each = max(1, min(CHUNK_SETS, CHUNK_ELEMENTS // most))
                groups = np.array_split(members, -(-len(members) // each))
                pairs = [(g,) for g in groups] if hubs_only or len(groups) == 1 else [(x, y) for i, x in enumerate(groups) for y in groups[i + 1 :]]
                for part, gs in enumerate(pairs):
                    got = np.concatenate(gs)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), tile), pa.int64()), pa.array(np.full(len(got), part), pa.int32()), pa.array(got)], ["tile", "part", "sid"])

    sent = rows.mapInArrow(send, "shard int, values binary, ids binary, bands binary" + ("" if hubs_only else ", comps binary"))
    tiles = sent.groupBy("shard").applyInArrow(meet, "tile long, members binary, most long").dropDuplicates(["tile"])
    return tiles.mapInArrow(deal, "tile long, part int, sid long")


def near_duplicates(docs: DataFrame, k: int = 4, percent: int = 85, one_in: int = SAMPLE_ONE_IN) -> DataFrame:
    """Rows (doc_id, n_shingles, sid, component_id): each document's set and the least doc_id that links lead to.

    A-Z are taken as a-z; a set has the distinct ``k``-word shingles, of fewer words the whole sequence. Documents
    without words (or text) have no shingles, are linked with nothing and are their own component. Links: similarity of at
    least ``percent``, which is 50 or more. Repeated rows each give a row; null doc_ids give rows but no component id of their own.
    """
    if percent < 50:
        raise ValueError("percent must be 50 or more")
    texts_in_small_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(document_sets(docs, k, percent, frequent_shingles(docs, k, one_in)))
    of = scratch.keep(rows.select("doc_id", "n", F.when(F.col("n") > 0, F.col("sid")).alias("sid")))
    sets = scratch.keep(shared_prefixes(rows))
    scratch.drop(rows)
    ids = sets.select("sid", "rep")
    edges = docs.sparkSession.range(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    comps = edges.toDF("id", "comp")

    # sets with the same first shared shingle, then the best-linked sets of components that share prefix shingles, then all
    # sets of different components that do
    for turn in ("first", "hubs", "all"):
        if turn == "first":
            groups = sets.groupBy("first").agg(F.count("*").alias("sets"), F.sum("n").alias("elements")).where("sets > 1")
            parts = F.ceil(F.greatest(F.col("elements") / CHUNK_ELEMENTS, F.col("sets") / CHUNK_SETS))
            members = sets.join(groups, "first").select(F.col("first").alias("tile"), F.pmod(F.xxhash64("sid"), parts).cast("int").alias("part"), "sid")
        else:
            members = prefix_tiles(sets, comps, percent, turn == "hubs")
        if turn == "hubs":
            ends = edges.select(F.col("a").alias("id")).union(edges.select("b")).groupBy("id").agg(F.count("*").alias("links"))
            hubs = ends.join(comps, "id").groupBy(F.col("comp").alias("sid")).agg(F.max_by("id", F.struct("links", "id")).alias("hub"))
            members = members.join(hubs, "sid", "left").select("tile", "part", F.coalesce("hub", "sid").alias("sid"))
        members = scratch.keep(members)
        kept = scratch.keep(promising(members, comps, sets, percent))
        scratch.drop(members)
        if not kept.isEmpty():
            new = group_links(kept, comps, ids, docs, k, percent, turn == "all", scratch)
            if not new.isEmpty():
                edges, comps = edges.union(new), joined(comps, new, scratch)
        scratch.drop(kept)
        forget(docs.sparkSession)

    least = of.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep")).join(comps, F.col("sid") == F.col("id"), "left")
    least = least.select("sid", "rep", F.coalesce("comp", "sid").alias("comp"))
    roots = least.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_set = least.join(roots, "comp").select("sid", "component_id")
    return of.join(by_set, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), "sid", F.coalesce("component_id", "doc_id").alias("component_id"))

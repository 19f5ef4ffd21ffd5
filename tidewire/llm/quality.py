"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text.

Tokens are the UTF-8 bytes of the lower-cased text, so an n-gram of up to seven is an exact integer and unseen words still
have a probability. Each text is preceded by n - 1 line ends. Raw counts serve the highest order, the number of
different left neighbours the lower ones; discounts D1, D2, D3+ of each order come from its counts of counts.

Counts lie in shards named by the two tokens before the last one: whatever orders n to 3 need of an n-gram is in its
shard. Orders 2 and 1 have at most 256 * 256 entries, so they are summed on the driver and broadcast. To score, blocks of
documents send each shard their distinct n-grams and get one log probability for each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.blocks import column, cuts, pack, read, scaled, shards, text_bytes
from tidewire.llm.bloom import having
from tidewire.llm.tables import Scratch, cut, forget, texts_in_small_batches
from tidewire.llm.textkit import buffers, chunks, mix

ORDER = 5
BLOCK_BYTES = 16 << 20
PIECE = 1 << 20
SHARD_BYTES = 16 << 20
#: Effort of the compression of shuffled text.
TEXT_LEVEL = 9
#: Blocks that one group of a shard answers; more blocks make more groups of each shard.
BLOCKS_AT_ONCE = 256
#: One trusted document of so many is left out of the counts and sets the thresholds.
HELD_OUT = 8
#: Share of held-out trusted documents of a language that lies below its threshold.
QUANTILE = 0.99
#: A threshold lies so many times as far above the median as that quantile does; 1 is the quantile itself.
SPREAD = 1.0
#: Share of held-out trusted documents of a language that lies below its floor, where one is asked for.
LOW_QUANTILE = 0.01
#: Thresholds are upper ends of steps of this size in log perplexity.
STEPS = 256
#: Most languages whose thresholds are broadcast; with more they are joined by shuffle.
MAX_BROADCAST_LANGS = 10_000


def padded(text: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of lower-cased texts, each after order - 1 line ends; the first byte of each text, and its length."""
    data, offs = buffers(pc.utf8_lower(text.cast(pa.large_string())))
    size = np.diff(offs)
    out = np.full(len(data) + len(size) * (order - 1), 10, np.uint8)
    first = offs[:-1] + (np.arange(len(size)) + 1) * (order - 1)
    for a, b, n in zip(first.tolist(), offs[:-1].tolist(), size.tolist()):
        out[a : a + n] = data[b : b + n]
    return out, first, size


def grams(data: np.ndarray, first: np.ndarray, size: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """In pieces: n-grams that end in a token of a text, and the number of that text."""
    for a in range(order - 1, len(data), PIECE):
        b = min(len(data), a + PIECE)
        code = np.zeros(b - a, np.uint64)
        for j in range(order):
            code <<= np.uint64(8)
            code |= data[a - order + 1 + j : b - order + 1 + j]
        at = np.arange(a, b)
        owner = np.searchsorted(first, at, "right") - 1
        inside = at < first[owner] + size[owner]
        inside &= owner >= 0
        yield code[inside], owner[inside]


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams in order and the sum of their counts."""
    every, n = np.concatenate([np.zeros(0, np.uint64), *codes]), np.concatenate([np.zeros(0, np.int64), *counts])
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    a, _ = cuts(every)
    return every[a], np.add.reduceat(n, a) if len(a) else n


def small(codes: np.ndarray) -> bytes:
    """Sorted distinct n-grams as compressed gaps, their bytes by place, so that the many small gaps cost little."""
    gaps = np.diff(codes, prepend=np.uint64(0))
    return zlib.compress(np.ascontiguousarray(gaps.view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def large(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(planes.reshape(8, -1).T).reshape(-1).view(np.uint64), dtype=np.uint64)


def shard_of(codes: np.ndarray, n: int) -> np.ndarray:
    return scaled(mix((codes >> np.uint64(8)) & np.uint64(0xFFFF)), n)


def dealt(codes: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Shards and the places of their n-grams."""
    to = shard_of(codes, n)
    order = np.argsort(to, kind="stable")
    for a, b in zip(*cuts(to[order])):
        yield int(to[order[a]]), order[a:b]


def trusted_counts(trusted: DataFrame, n_shards: int, order: int) -> DataFrame:
    """Rows (shard, codes, counts): the distinct n-grams of trusted texts with their counts, once a shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, np.ndarray] = summed([], [])
        size = 0

        def rows() -> pa.RecordBatch:
            found = list(dealt(held[0], n_shards))
            return pa.RecordBatch.from_arrays([
                pa.array([s for s, _ in found], pa.int32()), pa.array([small(held[0][at]) for _, at in found], pa.binary()),
                pa.array([zlib.compress(held[1][at].tobytes(), 1) for _, at in found], pa.binary()),
            ], names=["shard", "codes", "counts"])

        for batch in batches:
            text = batch.column("text")
            lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
            for a, b in chunks(np.r_[0, np.cumsum(lengths)]):
                for codes, _ in grams(*padded(text.slice(a, b - a), order), order):
                    new = np.unique(codes, return_counts=True)
                    held = summed([held[0], new[0]], [held[1], new[1].astype(np.int64)])
                size += int(lengths[a:b].sum())
                if size > BLOCK_BYTES:
                    yield rows()
                    held, size = summed([], []), 0
        yield rows()

    def merge(table: pa.Table) -> pa.Table:
        codes, counts = summed([large(x) for x in table.column("codes").to_pylist()], [np.frombuffer(zlib.decompress(x), np.int64) for x in table.column("counts").to_pylist()])
        return pa.table({"shard": table.column("shard")[:1], "codes": pa.array([codes.tobytes()], pa.binary()), "counts": pa.array([counts.tobytes()], pa.binary())})

    parts = trusted.select("text").mapInArrow(run, "shard int, codes binary, counts binary")
    return parts.groupBy("shard").applyInArrow(merge, "shard int, codes binary, counts binary")


def lower(codes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """N-grams one token shorter and the number of different first tokens of each."""
    return np.unique(codes & np.uint64((1 << 8 * (length - 1)) - 1), return_counts=True)


def discounts(n: np.ndarray) -> np.ndarray:
    """D1, D2, D3+ from the numbers of n-grams that count 1, 2, 3 and 4; half of each count where those don't tell."""
    out = np.array([0.0, 0.5, 1.0, 1.5])
    if (n > 0).all():
        y = n[0] / (n[0] + 2 * n[1])
        for i in (1, 2, 3):
            got = i - (i + 1) * y * n[i] / n[i - 1]
            out[i] = got if 0 < got < i else out[i]
    return out


class Level:
    """One order: probabilities p(last token | those before) = own part + weight of the context * p of the order below."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, d: np.ndarray):
        kind = np.minimum(counts, 3)
        self.codes = codes
        self.contexts, of = np.unique(codes >> np.uint64(8), return_inverse=True)
        total = np.bincount(of, counts, len(self.contexts))
        self.own = (counts - d[kind]) / total[of] if len(codes) else np.zeros(0)
        self.weights = np.bincount(of, d[kind], len(self.contexts)) / total if len(codes) else np.zeros(0)

    def apply(self, asked: np.ndarray, below: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return below
        context = asked >> np.uint64(8)
        at = np.minimum(np.searchsorted(self.contexts, context), len(self.contexts) - 1)
        p = np.where(self.contexts[at] == context, self.weights[at], 1.0) * below
        at = np.minimum(np.searchsorted(self.codes, asked), len(self.codes) - 1)
        return p + np.where(self.codes[at] == asked, self.own[at], 0.0)


def statistics(counts: DataFrame, order: int) -> tuple[dict[int, np.ndarray], np.ndarray]:
    """Discounts of each order, and p(last | one before) of all 65536 pairs.

    What reaches the driver from a shard is its four counts of counts of each order and the sums of pairs, which are
    added up by Spark: at most 4 * order + 65536 rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, n in zip(batch.column("codes"), batch.column("counts")):
                codes, counts_ = np.frombuffer(c.as_buffer(), np.uint64), np.frombuffer(n.as_buffer(), np.int64)
                keys, values = [], []
                for length in range(order, 2, -1):
                    keys += [-(10 * length + i) for i in (1, 2, 3, 4)]
                    values += np.bincount(np.minimum(counts_, 5), minlength=6)[1:5].tolist()
                    codes, counts_ = lower(codes, length)
                keys += codes.astype(np.int64).tolist()
                values += counts_.tolist()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(values, pa.int64())], ["key", "n"])

    got = counts.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    n = dict(zip(got.column("key").to_pylist(), got.column("n").to_pylist()))
    d = {length: discounts(np.array([n.get(-(10 * length + i), 0) for i in (1, 2, 3, 4)], float)) for length in range(order, 2, -1)}
    pairs = np.array(sorted(k for k in n if k >= 0), np.uint64)
    seen = np.array([n[int(k)] for k in pairs], np.int64)
    singles, left = lower(pairs, 2)
    for length, c in ((2, seen), (1, left)):
        d[length] = discounts(np.bincount(np.minimum(c, 5), minlength=6)[1:5].astype(float))
    every = np.arange(65536, dtype=np.uint64)
    p = Level(singles, left, d[1]).apply(every & np.uint64(255), np.full(65536, 1 / 256))
    return d, Level(pairs, seen, d[2]).apply(every, p)


def log_probabilities(codes: np.ndarray, counts: np.ndarray, asked: np.ndarray, d: dict[int, np.ndarray], pairs: np.ndarray, order: int) -> np.ndarray:
    """Natural logs for n-grams that a shard is asked for, from the shard's counts."""
    levels = []
    for length in range(order, 2, -1):
        levels.append((length, Level(codes, counts, d[length])))
        codes, counts = lower(codes, length)
    p = pairs[(asked & np.uint64(0xFFFF)).astype(np.int64)]
    for length, level in reversed(levels):
        p = level.apply(asked & np.uint64((1 << 8 * length) - 1), p)
    return np.log(p)


def perplexities(docs: DataFrame, trusted: DataFrame, order: int = ORDER) -> DataFrame:
    """Rows (doc_id, lang, n_tokens, log_perplexity) of every whole text under a model of the texts of ``trusted``.

    docs: doc_id, text, lang. Texts without tokens (null, empty) have null. Without trusted text every token has
    probability 1/256. Repeated rows give a row each.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.col("lang").cast("string"))
    total = text_bytes(docs)
    n_shards = min(65536, shards(docs, total, SHARD_BYTES))
    parts = total // (BLOCK_BYTES * BLOCKS_AT_ONCE) + 1
    counts = Scratch(spark).keep(trusted_counts(trusted, n_shards, order))
    forget(spark)  # the trusted texts' shuffle
    known = spark.sparkContext.broadcast(statistics(counts, order))
    blocks = pack(docs, limit=BLOCK_BYTES, level=TEXT_LEVEL)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, payload in zip(batch.column("block").to_pylist(), batch.column("payload")):
                table = read(payload.as_py())
                codes = np.zeros(0, np.uint64)
                for new, _ in grams(*padded(table.column("text").combine_chunks(), order), order):
                    codes = np.union1d(codes, new)
                found = list(dealt(codes, n_shards))
                yield pa.RecordBatch.from_arrays([
                    pa.array([s for s, _ in found], pa.int32()), pa.array(np.full(len(found), mix(np.array([number], np.uint64))[0] % np.uint64(parts)), pa.int32()),
                    pa.array(np.full(len(found), number), pa.int64()), pa.array([small(codes[at]) for _, at in found], pa.binary()),
                ], names=["shard", "part", "block", "codes"])

    def answer(asks: pa.Table, model: pa.Table) -> pa.Table:
        each = [large(x) for x in asks.column("codes").to_pylist()]
        sizes = [len(x) for x in each]
        asked, of = np.unique(np.concatenate([np.zeros(0, np.uint64), *each]), return_inverse=True)
        values = log_probabilities(column(model, "codes", "u8")[0], column(model, "counts", "i8")[0], asked, *known.value, order)[of].astype(np.float32)
        ends = np.cumsum(sizes)
        return pa.table({"block": asks.column("block"), "codes": asks.column("codes"), "values": pa.array([values[e - s : e].tobytes() for s, e in zip(sizes, ends)], pa.binary())})

    def finish(block: pa.Table, got: pa.Table) -> pa.Table:
        tables = [read(x) for x in block.column("payload").to_pylist()]
        table = pa.concat_tables(tables) if tables else pa.table({"doc_id": pa.array([], pa.int64()), "text": pa.array([], pa.string()), "lang": pa.array([], pa.string())})
        data, first, size = padded(table.column("text").combine_chunks(), order)
        codes, values = np.concatenate([np.zeros(0, np.uint64), *(large(x) for x in got.column("codes").to_pylist())]), column(got, "values", "f4")[0]
        by = np.argsort(codes)
        codes, values = codes[by], values[by].astype(np.float64)
        sums = np.zeros(len(size))
        for new, owner in grams(data, first, size, order):
            if len(new):
                low = owner[0]
                part = np.bincount(owner - low, values[np.searchsorted(codes, new)])
                sums[low : low + len(part)] += part
        per_token = pa.array(-sums / np.maximum(size, 1), mask=size == 0)
        return pa.table({"doc_id": table.column("doc_id"), "lang": table.column("lang"), "n_tokens": pa.array(size, pa.int64()), "log_perplexity": per_token})

    model = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("part", F.col("part").cast("int"))
    asked = blocks.mapInArrow(ask, "shard int, part int, block long, codes binary")
    answers = asked.groupBy("shard", "part").cogroup(model.groupBy("shard", "part")).applyInArrow(answer, "block long, codes binary, values binary")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, "doc_id long, lang string, n_tokens long, log_perplexity double")


def language_thresholds(trusted_scores: DataFrame, quantile: float = QUANTILE, spread: float = SPREAD, low: float = 0.0) -> DataFrame:
    """Rows (lang, threshold, floor) for each language, null included: ``median + spread * (quantile - median)`` of ``log_perplexity``, and its quantile ``low``.

    A threshold is the upper end of a step, a floor the lower end. Without ``low`` floors are null. Counts are summed by
    step first, so a language's rows are bounded by its steps, however many documents it has.
    """
    steps = trusted_scores.where("log_perplexity IS NOT NULL").withColumn("step", F.floor(F.col("log_perplexity") * STEPS).cast("long"))
    steps = steps.groupBy("lang", "step").agg(F.count("*").alias("n"))
    share = F.sum("n").over(W.partitionBy("lang").orderBy("step")) / F.sum("n").over(W.partitionBy("lang"))
    steps = steps.withColumn("share", share)
    ends = steps.groupBy("lang").agg(*(F.min(F.when(F.col("share") >= q, F.col("step"))).alias(name) for name, q in (("near", low), ("mid", 0.5), ("far", quantile))))
    floor = F.col("near") / STEPS if low else F.lit(None).cast("double")
    return ends.select("lang", ((F.col("mid") + spread * (F.col("far") - F.col("mid")) + 1) / STEPS).alias("threshold"), floor.alias("floor"))


def classify(docs: DataFrame, trusted_ids: DataFrame, order: int = ORDER, quantile: float = QUANTILE, low: float = 0.0) -> DataFrame:
    """Rows (doc_id, lang, n_tokens, perplexity, threshold, keep) of every document; with ``low`` also floor, before keep.

    trusted_ids: doc_id of trusted documents. One in HELD_OUT of them, by doc_id, only sets its language's limits; a
    language without any takes the widest of all languages. ``keep``: the perplexity is at most the threshold and, with
    ``low``, at least the floor; false for texts without tokens, true for others if nothing is trusted. Repeated and null
    doc_ids give a row each.
    """
    texts_in_small_batches(docs.sparkSession)
    ids = trusted_ids.select(F.col("doc_id").cast("long")).where("doc_id IS NOT NULL").distinct()
    held = F.pmod(F.xxhash64(F.lit("held out"), "doc_id"), F.lit(HELD_OUT)) == 0
    known = cut(ids.withColumn("held", held))
    text = docs.select(F.col("doc_id").cast("long"), "text")
    for_counts = known.where("NOT held").select("doc_id")
    trusted = having(text, "doc_id", for_counts)
    scored = cut(perplexities(docs, trusted, order))
    thresholds = cut(language_thresholds(scored.join(known.where("held"), "doc_id", "left_semi"), quantile, low=low))
    widest = thresholds.agg(F.max("threshold").alias("t"), F.min("floor").alias("f")).first()
    small = thresholds.count() <= MAX_BROADCAST_LANGS
    named = (F.broadcast(thresholds) if small else thresholds).withColumnRenamed("lang", "of")
    out = scored.join(named, F.col("lang").eqNullSafe(F.col("of")), "left")
    limit, floor = F.coalesce("threshold", F.lit(widest.t).cast("double")), F.coalesce("floor", F.lit(widest.f).cast("double"))
    inside = (F.col("log_perplexity") <= F.coalesce(limit, F.lit(float("inf")))) & (F.col("log_perplexity") >= F.coalesce(floor, F.lit(float("-inf"))))
    return out.select(
        "doc_id", "lang", "n_tokens", F.exp("log_perplexity").alias("perplexity"), F.exp(limit).alias("threshold"),
        *([F.exp(floor).alias("floor")] if low else []), F.coalesce(inside, F.lit(False)).alias("keep"),
    )

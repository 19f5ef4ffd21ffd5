"""Mixing sources to target weights by Efraimidis-Spirakis sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import Scratch

#: A source's keys are summed in ranges, so many to a doubling of the key, so that no task orders a whole source. Whatever
#: the weights, a range has a few thousandths of the documents of one weight at most.
RANGES = 128


def word_count(text: Column) -> Column:
    """Number of ``[^\\x20\\x09-\\x0D]+`` in a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def uniform(key: Column, seed: int = 0) -> Column:
    """A value in (0, 1) that depends on key and seed only: 52 bits of MD5."""
    digest = F.md5(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(f":{seed}")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, max_epochs: float) -> DataFrame:
    """Add ``target`` to rows (source, source_size, weight).

    The sum of all sizes is shared by weight; no source gets over ``max_epochs`` times its size, and
    what it can't take is shared by weight among the others. Sorted by size a unit of weight, the
    sources that reach their limit come first, so running sums give every round of that sharing.
    """
    room = F.col("source_size") * F.lit(float(max_epochs))
    order = W.orderBy((room / F.col("weight")), F.col("rank"))
    before = order.rowsBetween(W.unboundedPreceding, -1)
    after = order.rowsBetween(W.currentRow, W.unboundedFollowing)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(room).over(before), F.lit(0.0))) / F.sum("weight").over(after)
    return (
        sizes.withColumn("level", level)
        .withColumn("full", F.col("level") * F.col("weight") >= room)
        .withColumn("level", F.max(F.when(~F.col("full"), F.col("level"))).over(every))
        .withColumn("target", F.when(F.col("full"), room).otherwise(F.col("level") * F.col("weight")))
        .drop("level", "full")
    )


def mix_sources(docs: DataFrame, weight: Column | None = None, max_epochs: int = 3, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """``mix_sizes`` of documents (doc_id, source, text), whose sizes are their words; ``weight`` is an expression over their columns."""
    weight = F.lit(1.0) if weight is None else weight
    return mix_sizes(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), weight.cast("double").alias("weight")), max_epochs, seed, ranges)


def mix_sizes(sized: DataFrame, max_epochs: int = 3, seed: int = 0, ranges: int = RANGES) -> DataFrame:
    """How many words of each document a mix takes. sized: doc_id, source, size, weight.

    Sources weigh 1, 2, 3, 1, 2, 3, ... in code-point order, null last, and share all words. Every
    whole multiple of a source's size in its target is complete epochs; the rest goes to documents
    by ascending key ``-ln(u) / weight`` until the budget is used, the last of them in part.
    A weight that is null or not positive counts as the smallest double that sorts last. Repeated
    rows count each. A source without words has target 0. Empty table: no rows.
    Returns doc_id, size, source_size, target, taken, source.
    """
    key = -F.log(uniform(F.col("doc_id"), seed)) / F.greatest(F.coalesce("weight", F.lit(1e-9)), F.lit(1e-9))
    rows = sized.select("doc_id", "source", "size", key.alias("key"))
    rows = Scratch(sized.sparkSession).keep(rows.withColumn("bucket", F.floor(F.log2("key") * ranges).cast("int")))  # texts are read once
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    sizes = buckets.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    sizes = sizes.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    sizes = sizes.withColumn("weight", ((F.col("rank") - 1) % 3 + 1).cast("double"))
    targets = source_targets(sizes, max_epochs).withColumn("target", F.when(F.col("source_size") > 0, F.col("target")).otherwise(0.0))
    run = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    ahead = buckets.withColumn("ahead", F.coalesce(F.sum("bucket_size").over(run), F.lit(0))).drop("bucket_size")
    marks = ahead.alias("a").join(targets.alias("t"), F.col("a.source").eqNullSafe(F.col("t.source"))).select("a.source", "bucket", "ahead", "source_size", "target")
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    joined = rows.alias("r").join(marks.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.bucket") == F.col("m.bucket")))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.round(F.col("target") - epochs * F.col("source_size")).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), rest - F.col("ahead") - F.col("within")))
    return joined.select("doc_id", "size", "source_size", "target", (epochs * F.col("size") + part).alias("taken"), F.col("r.source").alias("source"))

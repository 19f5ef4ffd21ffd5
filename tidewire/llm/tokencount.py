"""Exact token counts and their length histogram."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import Scratch, without

#: The public byte-level BPE pattern that goes with the ranks file.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Lengths are summed in ranges of this many, so no task orders all distinct lengths.
STEP = 256


@lru_cache(2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded_lengths(docs: DataFrame, ranks_path: str = RANKS, text: str = "text") -> DataFrame:
    """Add ``n_tokens``, in place of a column so named, to every row: the exact token count of its whole text, 0 if null or empty.

    The ranks file is part of the machine image and is opened on each executor.
    """
    docs = without(docs, "n_tokens")
    schema = docs.select("*").schema.add("n_tokens", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(ranks_path).encode_ordinary
        for batch in batches:
            counts = [len(encode(t.as_py())) if t.is_valid else 0 for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(counts, pa.int64())], [*batch.schema.names, "n_tokens"])

    return docs.mapInArrow(run, schema)


def length_histogram(lengths: DataFrame, n: str = "n_tokens") -> DataFrame:
    """One row for each distinct length, which is also a context limit.

    n_docs of that length; docs_longer and tokens_longer (strictly); docs_total, tokens_total;
    tokens_kept: all tokens if each text is cut at this limit; quantile: share of documents that
    fit whole. A limit between two rows is answered by ``totals_at``. Null lengths count as 0;
    empty table: no rows. The counts by length are written once, as they are used twice.
    """
    hist = lengths.groupBy(F.coalesce(F.col(n), F.lit(0)).cast("long").alias(n)).agg(F.count("*").alias("n_docs"))
    hist = Scratch(lengths.sparkSession).keep(hist.withColumn("bucket", F.floor(F.col(n) / STEP)))
    coarse = hist.groupBy("bucket").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col(n)).alias("t"))
    later = W.orderBy(F.desc("bucket")).rowsBetween(W.unboundedPreceding, -1)
    every = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    coarse = coarse.select(
        "bucket",
        F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_after"),
        F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_after"),
        F.sum("d").over(every).alias("docs_total"),
        F.sum("t").over(every).alias("tokens_total"),
    )
    inside = W.partitionBy("bucket").orderBy(F.desc(n)).rowsBetween(W.unboundedPreceding, -1)
    out = hist.join(coarse, "bucket").withColumns({
        "docs_longer": F.col("d_after") + F.coalesce(F.sum("n_docs").over(inside), F.lit(0)),
        "tokens_longer": F.col("t_after") + F.coalesce(F.sum(F.col("n_docs") * F.col(n)).over(inside), F.lit(0)),
    })
    return out.select(
        n, "n_docs", "docs_longer", "tokens_longer", "docs_total", "tokens_total",
        (F.col("tokens_total") - F.col("tokens_longer") + F.col("docs_longer") * F.col(n)).alias("tokens_kept"),
        ((F.col("docs_total") - F.col("docs_longer")) / F.col("docs_total")).alias("quantile"),
    )


def totals_at(histogram: DataFrame, limit: int, n: str = "n_tokens") -> DataFrame:
    """One row: documents and tokens beyond any context limit and the tokens kept under it."""
    over = F.col(n) > limit
    total: Column = F.sum(F.col("n_docs") * F.least(F.col(n), F.lit(limit)))
    return histogram.agg(
        F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0)).alias("docs_longer"),
        F.coalesce(total, F.lit(0)).alias("tokens_kept"),
    )

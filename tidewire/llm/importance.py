"""Target-distribution importance resampling over a persisted document-by-bucket count matrix.

Documents' hashed word runs are counted once and written as blocks of a sparse matrix in CSR form. Its column sums are the
distribution of the corpus over buckets, those of the target's matrix the wanted one; a sparse matrix-vector product with the
buckets' gains weighs every document. Texts are read for the first step only.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.llm.tables import Scratch
from tidewire.llm.textkit import buffers, chunks

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Bytes of text whose counts one block of the matrix has at most, or one document.
BLOCK_TEXT = 1 << 20
#: Features up to so many bytes are hashed side by side, longer ones one by one.
SIDE_BY_SIDE = 48
#: Features hashed at once.
AT_ONCE = 1 << 17
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CRC = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _CRC = np.where(_CRC & 1, _CRC >> 1 ^ np.uint32(0xEDB88320), _CRC >> 1).astype(np.uint32)


def normal_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of texts joined by one space each: the bytes, the words' starts and ends there, and each row's first word.

    A-Z are taken as a-z; words are runs of bytes of digits, a-z and all that is not ASCII.
    """
    low = _LOWER[data]
    solid = _WORD[low]
    head = solid.copy()
    head[1:] &= ~solid[:-1]
    inner = offs[1:-1]
    inner = inner[inner < len(data)]
    head[inner] = solid[inner]
    starts = np.flatnonzero(head)
    rows = np.searchsorted(starts, offs)
    size = np.add.reduceat(solid, starts).astype(np.int64) if len(starts) else np.zeros(0, np.int64)
    ends = np.cumsum(size + 1) - 1
    joined = np.full(int(ends[-1]) + 1 if len(ends) else 0, 32, np.uint8)
    place = np.ones(len(joined), bool)
    place[ends] = False
    joined[place] = low[solid]
    return joined, ends - size, ends, rows


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned CRC-32 of each span of the bytes."""
    if len(starts) > AT_ONCE:
        return np.concatenate([crc32(data, starts[i : i + AT_ONCE], ends[i : i + AT_ONCE]) for i in range(0, len(starts), AT_ONCE)])
    size = ends - starts
    order = np.argsort(-size, kind="stable")
    big = int(np.searchsorted(-size[order], -SIDE_BY_SIDE))
    at, size = starts[order], size[order]
    crc = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    for j in range(int(size[big]) if big < len(size) else 0):
        n = int(np.searchsorted(-size, -j))  # these have a byte j
        crc[big:n] = _CRC[(crc[big:n] ^ data[at[big:n] + j]) & np.uint32(255)] ^ (crc[big:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(big):
        crc[i] = zlib.crc32(data[at[i] : at[i] + size[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def csr(data: np.ndarray, offs: np.ndarray, n_buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of rows' features by bucket: row pointers, buckets and counts of a sparse matrix, and each row's words."""
    joined, starts, ends, rows = normal_words(data, offs)
    owner = np.repeat(np.arange(len(offs) - 1), np.diff(rows))
    keys = []
    for n in range(1, longest + 1):
        last = len(starts) - n + 1
        if last <= 0:
            break
        whole = owner[:last] == owner[n - 1 :]
        bucket = crc32(joined, starts[:last][whole], ends[n - 1 :][whole]) % np.uint32(n_buckets)
        keys.append(owner[:last][whole] * n_buckets + bucket.astype(np.int64))
    key, count = np.unique(np.concatenate([np.zeros(0, np.int64), *keys]), return_counts=True)
    pointers = np.searchsorted(key, np.arange(len(offs), dtype=np.int64) * n_buckets)
    return pointers, key % n_buckets, count, np.diff(rows)


def count_matrix(docs: DataFrame, n_buckets: int = BUCKETS, longest: int = LONGEST, block_text: int = BLOCK_TEXT) -> DataFrame:
    """Blocks (ids, words, pointers, buckets, counts) of the sparse matrix of documents (doc_id, text); a null text has no words."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ints = lambda x: pa.array([x.astype(np.int32)], pa.list_(pa.int32()))
        for batch in batches:
            data, offs = buffers(batch.column("text"))
            for a, b in chunks(offs, block_text):
                parts = csr(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], n_buckets, longest)
                ids = batch.column("doc_id").slice(a, b - a)
                ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids)
                yield pa.RecordBatch.from_arrays([ids, ints(parts[3]), *(ints(x) for x in parts[:3])], ["ids", "words", "pointers", "buckets", "counts"])

    ints = ", ".join(f"{c} array<int>" for c in ("words", "pointers", "buckets", "counts"))
    return docs.select("doc_id", "text").mapInArrow(run, f"ids array<{kind}>, {ints}")


def _flat(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def column_sums(matrix: DataFrame, n_buckets: int = BUCKETS) -> np.ndarray:
    """Sum of each column; every task sums its blocks, so the driver gets ``n_buckets`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_buckets, np.int64)
        for batch in batches:
            np.add.at(total, _flat(batch, "buckets"), _flat(batch, "counts"))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["bucket", "n"])

    out = np.zeros(n_buckets, np.int64)
    for row in matrix.select("buckets", "counts").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[row.bucket] = row.n
    return out


def bucket_gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of how much likelier the target is to have each bucket, both with one added to every count."""
    s, t, n = float(have.sum()), float(want.sum()), float(len(have))
    return np.array([math.floor(1000 * math.log((float(y) + 1) * (s + n) / ((float(x) + 1) * (t + n)))) for x, y in zip(have, want)], np.int64)


def document_weights(matrix: DataFrame, gains: np.ndarray) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight): the matrix times the gains, divided by the row's features and floored; 0 without features."""
    kind = matrix.schema["ids"].dataType.elementType.simpleString()
    shared = matrix.sparkSession.sparkContext.broadcast(gains)  # one number for each bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                block = batch.slice(i, 1)
                pointers, counts = _flat(block, "pointers"), _flat(block, "counts")
                sums, n = (np.diff(np.r_[0, np.cumsum(x)][pointers]) for x in (shared.value[_flat(block, "buckets")] * counts, counts))
                weight = sums // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([block.column("ids").flatten(), pa.array(_flat(block, "words")), pa.array(n), pa.array(weight)], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(run, f"doc_id {kind}, n_words long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variate that depends on seed and id only; a null id has an empty name."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn_ranks(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """Add ``rank`` to rows (doc_id, n_words, score, ...): 1, 2, ... of the highest ``percent`` % scores among rows of enough words, else null.

    Scores are whole numbers from a range of some 130,000 (logarithms of doubles, times 1000), so a table of their counts is
    bounded whatever the input; running sums over it say how many rows are ahead of each score. Only rows of scores that can
    be drawn are sorted, each score by itself. ``scored`` is read several times: give a written table.
    """
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).withColumn("part", F.floor(F.col("score") / 256))
    parts = counts.groupBy("part").agg(F.sum("n").alias("part_n"))  # some 500 rows at most
    above = W.orderBy(F.desc("part")).rowsBetween(W.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("part_n").over(above), F.lit(0)).alias("part_ahead"), F.sum("part_n").over(W.partitionBy()).alias("total"))
    inside = W.partitionBy("part").orderBy(F.desc("score")).rowsBetween(W.unboundedPreceding, -1)
    quota = F.floor(F.col("total") * percent / 100)
    counts = counts.withColumn("within", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(F.broadcast(parts), "part")
    marks = counts.select(F.col("score").alias("_score"), (F.col("part_ahead") + F.col("within")).alias("_ahead"), quota.alias("_quota"))
    joined = scored.join(F.broadcast(marks.where("_ahead < _quota")), able & (F.col("score") == F.col("_score")), "left")
    place = F.col("_ahead") + F.row_number().over(W.partitionBy("_score").orderBy(F.col("doc_id").asc_nulls_last()))
    names = scored.columns
    drawn = joined.where("_score IS NOT NULL").withColumn("_place", place).select(*names, F.when(F.col("_place") <= F.col("_quota"), F.col("_place")).cast("long").alias("rank"))
    return drawn.unionByName(joined.where("_score IS NULL").select(*names, F.lit(None).cast("long").alias("rank")))


def resample(docs: DataFrame, target: DataFrame, n_buckets: int = BUCKETS, longest: int = LONGEST, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Rows (doc_id, n_words, n_features, weight, score, rank) of all documents (doc_id, text), drawn to resemble the target's texts.

    Features are runs of 1 to ``longest`` words, hashed to ``n_buckets``. A document's weight is the mean gain of its features;
    with a Gumbel variate of its id added, the highest scores are a draw without replacement in proportion to exp(weight / 1000).
    A null or empty text has no features, weight 0 and is never drawn (with ``least_words`` above 0). Repeated rows count each;
    rows that tie in score and doc_id get their ranks in any order. A null doc_id ranks after others of its score; all of these share
    one variate. Without target texts every gain is that of a flat target. Other columns are left aside. Empty table: no rows.
    """
    scratch = Scratch(docs.sparkSession)
    matrix = scratch.keep(count_matrix(docs, n_buckets, longest))
    gains = bucket_gains(column_sums(matrix, n_buckets), column_sums(count_matrix(target.select(F.lit(0).alias("doc_id"), "text"), n_buckets, longest), n_buckets))
    weighed = document_weights(matrix, gains)
    scored = scratch.keep(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)))
    scratch.drop(matrix)
    return drawn_ranks(scored, percent, least_words)

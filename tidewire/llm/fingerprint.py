"""Bottom-k sketches of shingle hashes."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import without
from tidewire.llm.textkit import buffers, chunks, shingle_sets

#: Kept hashes: a resemblance r is off by about sqrt(r (1 - r) / K).
K = 128
SHINGLE = 5


def sketch(values: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest of sorted distinct hashes: shorter than k means that all are there."""
    return values[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """Sketch of the union of two parts."""
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated Jaccard similarity: the part of the union's sketch that both hold. Two empty sets: 1."""
    if not len(a) and not len(b):
        return 1.0
    both = merge(a, b, k)
    return float(len(np.intersect1d(np.intersect1d(a, b, True), both, True))) / len(both)


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that b has too; of an empty a: 1."""
    if not len(a):
        return 1.0
    common = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return min(1.0, common / distinct_count(a, k))


def to_text(a: np.ndarray) -> str:
    return base64.b64encode(a.astype("<u8").tobytes()).decode()


def from_text(s: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(s), "<u8").astype(np.uint64)


def sketches(column: pa.Array, k: int = K, shingle: int = SHINGLE) -> list[np.ndarray]:
    """The sketch of each text of an Arrow column; null and empty texts have an empty one."""
    data, offs = buffers(column)
    out = []
    for a, b in chunks(offs):
        out += [x[:k] for x in shingle_sets(data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], shingle)]
    return out


def fingerprints(docs: DataFrame, k: int = K, shingle: int = SHINGLE, text: str = "text") -> DataFrame:
    """Add ``fingerprint`` (base64 of the sketch, smallest hash first) and ``n_shingles`` (estimate), in place of columns so named, to every row."""
    docs = without(docs, "fingerprint", "n_shingles")
    schema = docs.select("*").schema.add("fingerprint", "string").add("n_shingles", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = sketches(batch.column(text), k, shingle)
            new = [pa.array(map(to_text, got), pa.string()), pa.array([distinct_count(x, k) for x in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "fingerprint", "n_shingles"])

    return docs.mapInArrow(run, schema)


def merged(rows: DataFrame, key: str, k: int = K) -> DataFrame:
    """Rows (key, fingerprint, n_shingles): the sketch of each key's texts together, from ``fingerprint`` of rows. Null keys are one.

    Batches merge their own rows before anything is shuffled, and again as many as meet in a part of a key, so that no
    task has all sketches of a hot key.
    """
    name = f"`{key}`"

    def union(table: pa.Table) -> np.ndarray:
        return np.unique(np.concatenate([np.zeros(0, np.uint64), *(from_text(x) for x in table.column("fingerprint").to_pylist() if x)]))[:k]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for value in pa.compute.unique(table.column(key)):
                mine = pa.compute.equal(table.column(key), value) if value.is_valid else pa.compute.is_null(table.column(key))
                yield pa.RecordBatch.from_arrays([pa.array([value.as_py()], table.schema.field(key).type), pa.array([to_text(union(table.filter(mine)))])], [key, "fingerprint"])

    def group(table: pa.Table) -> pa.Table:
        got = union(table)
        return table.select([key]).slice(0, 1).append_column("fingerprint", pa.array([to_text(got)])).append_column("n_shingles", pa.array([distinct_count(got, k)]))

    kind = rows.schema[key].dataType.simpleString()
    parts = rows.select(name, "fingerprint").mapInArrow(partial, f"{name} {kind}, fingerprint string")
    return parts.groupBy(name).applyInArrow(group, f"{name} {kind}, fingerprint string, n_shingles double")


def with_successor(docs: DataFrame, key: str, parts: int) -> DataFrame:
    """Deal rows over ``parts`` ranges of a long key, each sorted, with a copy of the next range's first row at its end.

    Range bounds are values of the key itself, so a range's first row is the row at its bound; that row is
    also sent to the range before (the very first row to the last range). Adds ``_part`` and ``_extra``.
    Bounds are at most ``parts`` numbers, searched by halves. Rows of equal key stay in one range; a null key sorts first.
    """
    rank = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))
    ranked = docs.withColumn("_rank", rank)
    shares = [i / parts for i in range(parts)]
    row = ranked.agg(F.min("_rank").alias("low"), F.percentile_approx("_rank", shares, 20 * parts).alias("cuts")).first()
    bounds = sorted({row["low"], *row["cuts"]}) if row["low"] is not None else [0]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(bounds, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            at = batch.column("_rank").to_numpy()
            part = np.searchsorted(bounds, at, "right") - 1
            edge = np.flatnonzero(bounds[part] == at)
            rows = np.r_[np.arange(len(at)), edge]
            home = np.r_[part, (part[edge] - 1) % len(bounds)].astype(np.int32)
            out = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(home), pa.array(np.arange(len(rows)) >= len(at))], [*out.schema.names, "_part", "_extra"])

    out = ranked.mapInArrow(deal, ranked.select("*").schema.add("_part", "integer").add("_extra", "boolean"))
    return out.repartition(max(parts, 1), "_part").sortWithinPartitions("_part", "_extra", "_rank", "text")

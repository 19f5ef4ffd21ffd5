"""Query op3: fingerprints of all documents and of their edited texts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.blocks import text_bytes
from tidewire.llm.fingerprint import K, SHINGLE, containment, distinct_count, resemblance, sketches, to_text, with_successor
from tidewire.llm.tables import table

NAME = "op3_fingerprints"
SQL = None  # SQL has no such hash; tested against brute-force Jaccard similarity
SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, n_shingles double, kept_in_edited double"
GROUP_BYTES = 1 << 20
#: Bytes of text in one range of doc_id.
RANGE_BYTES = 8 << 20


def edited(text: str, following: str) -> str:
    """The last half of a text replaced by as many first characters of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, parts: int) -> DataFrame:
    """For each document, its fingerprint, that of its edited text, and likenesses to that and to the next document.

    Further columns: its number of distinct shingles, and the share of them that the edited text has, both estimated.

    Null texts are empty. Documents of equal doc_id follow each other by text. A single document is its own successor.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def emit(group: list[tuple], after: str) -> pa.RecordBatch:
        texts = [t for _, t in group]
        news = [edited(t, n) for t, n in zip(texts, [*texts[1:], after])]
        got = sketches(pa.array([*texts, after, *news], pa.large_string()))
        own, new = got[: len(texts) + 1], got[len(texts) + 1 :]
        return pa.RecordBatch.from_arrays([
            pa.array([i for i, _ in group], pa.int64()), pa.array(map(len, texts), pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in news]),
            pa.array(map(to_text, own[:-1])), pa.array(map(to_text, new)),
            pa.array([resemblance(a, b) for a, b in zip(own, new)], pa.float64()),
            pa.array([resemblance(a, b) for a, b in zip(own, own[1:])], pa.float64()),
            pa.array([distinct_count(a) for a in own[:-1]], pa.float64()), pa.array([containment(a, b) for a, b in zip(own, new)], pa.float64()),
        ], names=[x.split()[0] for x in SCHEMA.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        size, now, done = 0, None, False
        for doc_id, text, part, extra in rows(batches):
            text = text or ""
            if part != now:
                now, done = part, False
            if done:
                continue  # more rows at the next range's first key
            if extra:
                if group:
                    yield emit(group, text)
                group, size, done = [], 0, True
                continue
            if size > GROUP_BYTES:
                yield emit(group, text)
                group, size = [], 0
            group.append((doc_id, text))
            size += len(text)

    return with_successor(docs.select("doc_id", "text"), "doc_id", parts).select("doc_id", "text", "_part", "_extra").mapInArrow(run, SCHEMA)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    assert (K, SHINGLE) == (128, 5)
    docs = table(spark, sf_dir, "documents")
    return compare_with_next(docs, max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(docs) // RANGE_BYTES))

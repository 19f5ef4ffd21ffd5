"""Toxicity scores by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives; all other text is unlabelled, so it holds toxic texts too. With the class
prior p, the risk is ``p R(P, +) + max(0, R(U, -) - p R(P, -))``: the second term corrects for the toxic part of
the unlabelled text, and where it falls below zero the step goes against it, as the model then fits noise.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import cut, texts_in_small_batches, without

WORD = re.compile(r"[^\W\d_]+")
#: Features that a classifier keeps.
MAX_FEATURES = 50_000
#: Bounds of the sample that the classifiers are fitted on, in documents; their texts are used whole.
MAX_POSITIVE = 3000
MAX_UNLABELLED = 8000
#: Standard errors by which a feature's shares must differ, and documents' worth of that difference.
STRENGTH, GAP = 6.0, 4.5
PREFIXES = (3, 4, 5, 6)


def features(word: str) -> list[int]:
    """32-bit hashes of a lower-case word's indicators: the word itself and its beginnings."""
    keys = ["=" + word, *("^" + word[:n] for n in PREFIXES if len(word) >= n)]
    return [zlib.crc32(k.encode("utf-8", "surrogatepass")) for k in keys]


def fold(key: Column, folds: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % folds


@dataclass
class Model:
    """Weights of the few features that a fit kept, by hash."""

    weights: dict[int, float]
    bias: float

    def scores(self, texts: list[str | None], cache: dict[str, float]) -> list[float]:
        """Probability that each whole text is toxic."""
        out = []
        for text in texts:
            total = self.bias
            for word in set(WORD.findall(text.lower())) if text else ():
                value = cache.get(word)
                if value is None:
                    if len(cache) > 150_000:
                        cache.clear()
                    value = cache[word] = sum(self.weights.get(f, 0.0) for f in features(word))
                total += value
            out.append(1 / (1 + math.exp(-min(max(total, -40.0), 40.0))))
        return out


def document_features(text: str | None) -> np.ndarray:
    """Distinct features of a whole text, sorted."""
    words = set(WORD.findall(text.lower())) if text else ()
    return np.unique(np.fromiter((f for x in words for f in features(x)), np.uint32))


def associated(sample: DataFrame, most: int = MAX_FEATURES) -> list[int]:
    """Features whose share of positive documents differs clearly from that of unlabelled ones. sample: role (1 or 0), text.

    Documents are counted by Spark, over whole texts; the driver gets the ``most`` strongest features.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts: dict[int, list[np.ndarray]] = {0: [], 1: []}
            for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                parts[role].append(document_features(text))
            for role, docs in parts.items():
                if docs:
                    ids, n = np.unique(np.concatenate(docs), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(ids.astype(np.int64)), pa.array(np.full(len(ids), role, np.int32)), pa.array(n, pa.int64())], ["f", "role", "n"])

    size = sample.groupBy("role").count().collect()
    n, m = (next((r["count"] for r in size if r.role == k), 0) for k in (1, 0))
    if not n or not m:
        return []
    of = lambda k: F.sum(F.when(F.col("role") == k, F.col("n")).otherwise(0))
    counts = sample.mapInArrow(run, "f long, role int, n long").groupBy("f").agg(of(1).alias("p"), of(0).alias("u"))
    pooled = (F.col("p") + F.col("u")) / (n + m)
    gap = F.abs(F.col("p") / n - F.col("u") / m)
    strength = gap / F.sqrt(F.greatest(pooled * (1 - pooled), F.lit(1e-12)) * (1 / n + 1 / m))
    kept = counts.select("f", strength.alias("strength")).where((F.col("strength") >= STRENGTH) & (gap > GAP / n))
    return sorted(r.f for r in kept.orderBy(F.desc("strength"), "f").limit(most).collect())


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], kept: np.ndarray, prior: float, seed: int = 0, steps: int = 300, rate: float = 0.06, decay: float = 1e-4) -> Model:
    """One classifier by Adam over a random nine tenths of both kinds; documents are arrays of ``kept`` features.

    Without positives, or with prior 0, every score is close to 0.
    """
    if not positive or not unlabelled or prior <= 0:
        return Model({}, -12.0)
    rng = np.random.default_rng(seed)
    parts = [[x[i] for i in np.sort(rng.permutation(len(x))[: max(1, len(x) * 9 // 10)])] for x in (positive, unlabelled)]
    n_pos, n = len(parts[0]), len(parts[0]) + len(parts[1])
    docs = [np.searchsorted(kept, x) for x in [*parts[0], *parts[1]]]
    sizes = np.array([len(x) for x in docs])
    flat, owner = np.concatenate(docs).astype(np.int64), np.repeat(np.arange(n), sizes)
    is_p = np.arange(n) < n_pos
    w = np.zeros(len(kept) + 1)  # the last one is the bias
    w[-1] = np.log(prior / (1 - prior)) if prior < 1 else 4.0
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = w[-1] + np.bincount(owner, w[flat], n)
        s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        soft = np.logaddexp(0, z)  # loss of calling a document toxic when it is not
        g = np.empty(n)
        if soft[~is_p].mean() >= prior * soft[is_p].mean():
            g[is_p] = -prior / n_pos
            g[~is_p] = s[~is_p] / (n - n_pos)
        else:
            g[is_p] = prior * s[is_p] / n_pos
            g[~is_p] = -s[~is_p] / (n - n_pos)
        grad = np.r_[np.bincount(flat, g[owner], len(kept)), g.sum()] + decay * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Model(dict(zip(kept.tolist(), w[:-1].tolist())), float(w[-1]))


def mean(models: list[Model]) -> Model:
    keys = {k for m in models for k in m.weights}
    return Model({k: sum(m.weights.get(k, 0.0) for m in models) / len(models) for k in keys}, sum(m.bias for m in models) / len(models))


def train(docs: DataFrame, positives: DataFrame, prior: float, usable: Column, classifiers: int = 3) -> Model:
    """Mean of several classifiers, fitted on a bounded sample that depends on doc_id only.

    positives: doc_id of confirmed toxic documents. ``usable`` says which documents may serve as unlabelled text.
    The driver gets at most MAX_FEATURES features and those of them that each of MAX_POSITIVE + MAX_UNLABELLED documents has.
    """
    texts_in_small_batches(docs.sparkSession)
    order = F.xxhash64(F.lit("toxicity"), F.col("doc_id"))
    pos = positives.select("doc_id").where("doc_id IS NOT NULL").distinct().orderBy(order, "doc_id").limit(MAX_POSITIVE)
    rest = docs.where(usable & F.col("doc_id").isNotNull()).select("doc_id").orderBy(order, "doc_id").limit(MAX_UNLABELLED)
    ids = pos.withColumn("role", F.lit(1)).unionByName(rest.distinct().withColumn("role", F.lit(0)))

    small = ids.limit(MAX_POSITIVE + MAX_UNLABELLED + 1)  # bounded, so it may be broadcast
    sample = cut(docs.select("doc_id", "text").join(F.broadcast(small), "doc_id").select("role", "text"))
    kept = np.array(associated(sample), np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.intersect1d(document_features(x), kept, assume_unique=True).astype(np.uint32).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("role"), pa.array(found, pa.binary())], ["role", "ids"])

    rows = sorted((r.role, bytes(r.ids)) for r in sample.mapInArrow(run, "role int, ids binary").collect())
    parts = [[np.frombuffer(x, np.uint32) for role, x in rows if role == k] for k in (1, 0)]
    return mean([fit(*parts, kept, prior, seed) for seed in range(classifiers)])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``score`` (0 to 1), in place of a column so named, to every row. The model has at most MAX_FEATURES weights a classifier, so its broadcast is bounded. Null text: as empty."""
    texts_in_small_batches(docs.sparkSession)
    docs = without(docs, "score")
    schema = docs.select("*").schema.add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[str, float] = {}
        for batch in batches:
            got = shared.value.scores(batch.column(text).to_pylist(), cache)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64())], [*batch.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def train_from_labels(docs: DataFrame, labels: DataFrame, folds: int = 5) -> Model:
    """Train from rows whose crc32(doc_id) mod ``folds`` is not 0; the prior is their share of toxic labels."""
    seen = labels.where((fold(F.col("doc_id"), folds) != 0) & F.col("toxic").isNotNull())
    prior = seen.agg(F.avg("toxic").alias("p")).first().p or 0.0
    return train(docs, seen.where("toxic = 1"), float(prior), fold(F.col("doc_id"), folds) != 0)

"""Language identification: known words first, then shorter and shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.tables import without

WORD = re.compile(r"[^\W\d_]+")
#: Bound of the sample that the model is fitted on: documents a language. All that occurs twice in it is kept.
MAX_DOCS = 2000
#: Most languages whose shares are broadcast.
MAX_BROADCAST_LANGS = 10_000
LENGTHS = (4, 3, 2, 1)
CACHE = 200_000


def letter_runs(text: str) -> list[str]:
    """Maximal runs of letters of a text in lower case; numbers such as fractions and Roman numerals are none."""
    found = WORD.findall(text.lower())
    if not found or "".join(found).isalpha():
        return found
    return [x for word in found for x in "".join(c if c.isalpha() else " " for c in word).split()]


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word with marked ends; single characters without them."""
    marked = word if n == 1 else f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Model:
    """Log frequencies: ``tables[0]`` of words, ``tables[n]`` of n-grams, each a row number in ``rows``."""

    langs: list[str]
    tables: dict[int, dict[str, int]]
    rows: np.ndarray
    cache: dict[str, int] = field(default_factory=dict)
    found: np.ndarray | None = None

    def vector(self, word: str) -> np.ndarray:
        at = self.tables[0].get(word)
        if at is not None:
            return self.rows[at]
        for n in LENGTHS:
            table = self.tables[n]
            ids = [table[g] for g in grams(word, n) if g in table]
            if ids:
                return self.rows[ids].mean(0)
        return np.zeros(len(self.langs), np.float32)

    def classify(self, text: str | None) -> tuple[str, float]:
        """Best language and its share of the likelihood; ``und`` for a text without letters."""
        words = Counter(letter_runs(text)) if text else None
        if not words:
            return "und", 0.0
        if not self.langs:
            return "und", 0.0
        if self.found is None or len(self.cache) + len(words) > CACHE:
            self.cache = {}
            self.found = np.empty((max(CACHE, len(words)) + 1, len(self.langs)), np.float32)
        ids, counts = np.empty(len(words), np.int64), np.fromiter(words.values(), float, len(words))
        for i, word in enumerate(words):
            at = self.cache.get(word)
            if at is None:
                at = self.cache[word] = len(self.cache)
                self.found[at] = self.vector(word)
            ids[i] = at
        total = counts @ self.found[ids]
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.clip(total - total[best], -700, 0)).sum())


def train(docs: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on rows (doc_id, text, lang) with a language: at most about ``max_docs`` of each, chosen by doc_id.

    Counts are summed by Spark; words and n-grams that occur twice in a language's sample reach the driver, so the sample
    bounds the model.
    """
    docs = docs.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    share = docs.groupBy("lang").agg((F.lit(float(max_docs)) / F.count("*")).alias("share"))
    pick = F.abs(F.xxhash64(F.lit("language"), F.col("doc_id")) % 1_000_000) < F.col("share") * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.update((lang, w) for w in letter_runs(text or ""))
            got: Counter = Counter({(lang, 0, w): c for (lang, w), c in words.items()})
            for (lang, w), c in words.items():
                for n in LENGTHS:
                    for g in grams(w, n):
                        got[lang, n, g] += c
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in got]), pa.array([k[1] for k in got], pa.int32()), pa.array([k[2] for k in got]), pa.array(list(got.values()), pa.int64())],
                ["lang", "kind", "token", "n"],
            )

    small = share.limit(MAX_BROADCAST_LANGS + 1).count() <= MAX_BROADCAST_LANGS
    picked = docs.join(F.broadcast(share) if small else share, "lang").where(pick).select("lang", "text")
    counts = picked.mapInArrow(run, "lang string, kind int, token string, n long").groupBy("lang", "kind", "token").agg(F.sum("n").alias("n"))
    kept = counts.where((F.col("n") > 1) | (F.col("kind") == 1)).toArrow().to_pandas()
    langs = sorted(kept.lang.unique())
    tables: dict[int, dict[str, int]] = {}
    rows, start = [], 0
    for kind in (0, *LENGTHS):
        part = kept[kept.kind == kind]
        tokens = sorted(part.token.unique())
        tables[kind] = {t: start + i for i, t in enumerate(tokens)}
        n = np.full((len(tokens), len(langs)), 0.5)
        if len(part):
            n[part.token.map(tables[kind]).to_numpy() - start, part.lang.map({x: i for i, x in enumerate(langs)}).to_numpy()] += part.n.to_numpy()
        rows.append(np.log(n / n.sum(0)) if len(tokens) else n)
        start += len(tokens)
    return Model(langs, tables, np.concatenate(rows).astype(np.float32) if langs else np.zeros((0, 0), np.float32))


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Add ``lang_pred`` and ``score``, in place of columns so named, to every row from its whole text; null or letterless text: ``und``, 0."""
    docs = without(docs, "lang_pred", "score")
    schema = docs.select("*").schema.add("lang_pred", "string").add("score", "double")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [shared.value.classify(t) for t in batch.column(text).to_pylist()]
            new = [pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)

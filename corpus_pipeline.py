"""The corpus pipeline: five stages, each of which reads the documents that its predecessor kept and wrote."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import decontaminate, jaccard, passages, toxicity
from tidewire.llm.op4_mixing import mix_by_quality
from tidewire.llm.tables import shared_folder, table

#: Some stages have no SQL (trained classifier, components, edit distance): see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def aside(docs: DataFrame, *names: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """Documents whose own columns of these names have others for a while, and what gives them back, with all columns in order."""
    taken = {n.lower() for n in names}
    held = [f"_own_{i}" if c.lower() in taken else c for i, c in enumerate(docs.columns)]
    return docs.toDF(*held), lambda out: out.select([F.col(f"`{x}`").alias(c) for x, c in zip(held, docs.columns)])


def with_row_key(docs: DataFrame) -> DataFrame:
    """Add ``_row``: a number of doc_id and text that is never null, so rows with a null or repeated doc_id are told apart."""
    return docs.withColumn("_row", F.xxhash64("doc_id", "text"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below 0.5 by a classifier of the labels of this input."""
    model = toxicity.train_from_labels(docs, table(spark, sf_dir, "labels"))
    held, back = aside(docs, "score")
    return back(toxicity.score(held, model).where("score < 0.5"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of every near-duplicate group, one without an id only where no other is in the group.

    Shingles of five words, similarity of 0.8 or more. Rows of equal doc_id are judged by their texts; equal rows stay once.
    """
    keyed = with_row_key(docs)
    groups = jaccard.near_duplicates(keyed.select(F.col("_row").alias("doc_id"), "text"), k=5, percent=80)
    groups = groups.select(F.col("doc_id").alias("_row"), "component_id").distinct()
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"]
    kept = keyed.select("_row", "doc_id").join(groups, "_row").groupBy("component_id").agg(first.alias("_row")).select("_row")
    return keyed.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(docs.columns)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 13-word windows of earlier documents; documents left without words go, others keep their layout."""
    held, back = aside(docs, "n_words", "n_removed")
    out = passages.drop_repeated_passages(held, keep_layout=True).where("n_removed = 0 OR n_removed < n_words")
    return back(out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)))


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found; rows with a null or repeated doc_id each by their own text."""
    keyed = with_row_key(docs)
    leaks = decontaminate.matches(keyed.select(F.col("_row").alias("doc_id"), "text"), table(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("_row")).distinct()
    return keyed.join(leaks, "_row", "left_anti").select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each remaining document."""
    return mix_by_quality(docs, table(spark, sf_dir, "labels"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("substring dedup", drop_repeated_passages),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("mixing sources to target weights", mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages; what each but the last returns is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = shared_folder(spark)
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs.write.parquet(path := f"{folder}/stage{number}")
            docs = spark.read.parquet(path)
    return docs

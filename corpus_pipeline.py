"""Documents to packed training sequences, in stages that are written and read again.

The stages return the columns of their input, whatever they are called, but for the
last, which returns pieces of packed sequences. Null texts, empty texts and texts without
a word are rejected by the first stage; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlake.llm import mil
from orderlake.llm.block_dedup import block_dedup
from orderlake.llm.bottom_k import one_of_each
from orderlake.llm.curriculum import mixed_documents
from orderlake.llm.retrieval_packing import retrieval_packing
from orderlake.llm.scratch import written

OWN = ("doc_id", "text", "source", "n_chars")


def _plain(docs: DataFrame) -> DataFrame:
    """Columns that the operators don't read under names that none of them uses."""
    return docs.select(*(F.col(f"`{c}`").alias(c if c in OWN else f"_given_{i}") for i, c in enumerate(docs.columns)))


def _named(result: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` again, under their names and in their order."""
    return result.select(*(F.col(c if c in OWN else f"_given_{i}").alias(c) for i, c in enumerate(docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input's labels, does not reject."""
    plain = _plain(docs)
    model = mil.train(plain, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality")
    return _named(mil.score(plain, model).where(F.col("score") >= 0.3), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id."""
    return _named(one_of_each(_plain(docs)), docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 50 words or more that a smaller document has; texts that lose all words go."""
    cleaned = block_dedup(_plain(docs), window=50)
    cut = F.col("n_removed") > 0
    out = cleaned.where(~cut | (F.col("n_removed") < F.col("n_words")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(cut, F.length("kept_text")).otherwise(F.col("n_chars")))
    return _named(out.withColumn("text", F.when(cut, F.col("kept_text")).otherwise(F.col("text"))), docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources, in training order: a document is there as often as it is taken."""
    return _named(mixed_documents(_plain(docs)), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2,048 tokens."""
    return retrieval_packing(docs.select("doc_id", "text"), "word_bpe_49k.json")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The classifier is trained, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

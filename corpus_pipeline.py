"""A training corpus out of ``documents``, stage by stage.

Every stage reads what its predecessor wrote, and all but the last return the columns of
``documents``: rejected documents are gone, the others are as they were.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dossier.llm import copies, decontaminate, langid, pieces, suffixes
from dossier.llm.common import small_batches
from dossier.session import shared_dir


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language learned from the labelled ones."""
    return langid.in_known_language(small_batches(spark) and docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies, by fingerprints and by shingle sets."""
    return copies.deduplicate(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand earlier in the corpus."""
    return suffixes.remove_repeats(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document left, with a proof that they decode to its text."""
    return pieces.encode(docs).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language identification", known_language),
    ("near duplicates", one_of_each),
    ("repeated passages", without_repeats),
    ("benchmark decontamination", without_benchmarks),
    ("token pieces", tokenized),
]

# Hashes of 64 bits over vectors, fingerprints and merges are not for SQL: the tests hold the
# stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order. Each result is written to the shared folder and read again."""
    small_batches(spark)
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs

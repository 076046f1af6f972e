"""A training corpus from ``documents``: quality, near duplicates, benchmark leaks, secrets, token ids.

Every stage takes all that its predecessor kept, written as Parquet and read again. All stages but the last give
back the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glintscan.llm import decontamination, ngram_join, quality_rules, secrets, word_bpe
from glintscan.llm.common import cut, drop
from glintscan.llm.queries import table, vocabulary


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the least id."""
    return ngram_join.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.redact(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, as a count and digests of ids and decoded text."""
    return word_bpe.roundtrip(docs, vocabulary())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", benchmark),
    ("secret_scans", without_secrets),
    ("bpe", tokens),
]

#: Greedy tiling and merging by rank have no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each one's result written to the shared folder; what the next has read goes."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        done, docs = docs, cut(stage(spark, docs, sf_dir), "stage")
        drop(done)
    return docs

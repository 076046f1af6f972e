"""Quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on at most ``TRAIN_ROWS`` labelled rows, those with the smallest id hashes, whatever the
size of the tables; every text is then scored whole, inside tasks. Only statistics of the text enter.

A null or empty text has the statistics of an empty text and gets a score like any other. Rows are scored
one by one, so repeated rows get equal scores. Null labels and labels of unknown documents are passed over;
a document that is labelled twice counts with its larger label. Without labels of both kinds the score is
the smoothed share of label 1 (0.5 where there is none).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.boosting import Forest, fit
from glintscan.llm.common import raw, small_batches
from glintscan.llm.textstats import FEATURES, Document

#: Labelled rows to learn from, at most.
TRAIN_ROWS = 20_000


def statistics(texts: pa.Array) -> np.ndarray:
    return np.array([Document(t).vector() for t in raw(texts)], float).reshape(-1, FEATURES)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled(labels: DataFrame, label: str, rows: int, doc_id: str = "doc_id") -> DataFrame:
    """(_id, _y) of at most ``rows`` labelled documents, by the hash of their ids: small enough to broadcast."""
    known = labels.filter(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(F.max(label).alias("_y"))
    return known.orderBy(F.xxhash64("_id"), "_id").limit(rows)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", rows: int = TRAIN_ROWS) -> Forest:
    """A forest from the labelled rows of ``labels``; pass only those that may be learnt from."""
    small_batches(docs.sparkSession)
    chosen = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_t")).join(F.broadcast(labelled(labels, label, rows, doc_id)), "_id")
    # an id that stands in many rows counts once, with its least text
    chosen = chosen.groupBy("_id").agg(F.first("_y").alias("_y"), F.min("_t").alias("_t"))

    @F.arrow_udf("array<double>")
    def vectors(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            x = statistics(column)
            yield pa.ListArray.from_arrays(np.arange(0, x.size + 1, FEATURES, dtype=np.int32), x.ravel())

    found = chosen.select(vectors("_t").alias("x"), "_y", F.xxhash64("_id").alias("_h")).toArrow().sort_by("_h")
    x = found["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, FEATURES)
    return fit(x, found["_y"].to_numpy().astype(float))


def score(text: Column, forest: Forest) -> Column:
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array(forest.score(statistics(column)), pa.float64())

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, threshold: float = 0.3, label: str = "quality", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``held_out``, ``score`` and ``predicted``; fold ``held`` of ``folds`` is not learnt from."""
    forest = train(docs, labels.filter(remainder(F.col(doc_id), folds) != held), label, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"), score(F.col(text), forest).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

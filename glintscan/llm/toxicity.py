"""Toxicity: non-negative positive-unlabelled learning of a linear word model.

Confirmed toxic documents are the positives, any text is unlabelled. With the class prior ``pi`` the risk is
``pi * R+(positives) + max(0, R-(unlabelled) - pi * R-(positives))``: the part for negatives is corrected for
the positives that hide among the unlabelled, and where over-fitting drives it below zero its gradient is
turned round (Kiryo et al., 2017). Features are the counts (up to ``SATURATED``) of words (ASCII lower-cased, ASCII
punctuation dropped) and word beginnings, from a vocabulary of those that mark positives against unlabelled text best.

Every document is unlabelled text once (an id in several rows with its least text), in the vocabulary's counts and in the fit. Rows of equal features become
one with a weight; weights are dealt over shards of about ``SHARD`` rows, each shard fits a model with all positives,
and the models' mean, weighted by rows, is the result (parameter mixing). No task holds more than a shard, whatever one
text or source makes up, and sums are of whole numbers, so that the model does not depend on the order of rows. Only
confirmed positives are bounded: ``POSITIVES``, those with the smallest id hashes (a parameter of ``train``).

Every text is scored whole, inside tasks. A null or empty text has no word and gets the model's score for that. Repeated
rows get equal scores; an empty table gives no rows; further columns of any name are not read. Without a positive
document the score is the prior (0.5 without labels).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, drop, raw, small_batches
from glintscan.llm.quality_classifier import remainder

#: Parameters of ``train``: most positive documents, unlabelled rows of a shard, features.
POSITIVES, SHARD, VOCABULARY = 4_000, 16_000, 512
#: Features that a task counts before it hands the counts on, and the fraction of a weight that is summed.
HELD, UNIT = 500_000, 1 << 22
#: A word must occur in so many documents.
LEAST_DOCUMENTS = 6
#: Occurrences of a feature in a text from which more make no difference: else one very long text decides the fit.
SATURATED = 16
#: Standard errors by which its share among the positives must exceed that among the unlabelled.
LEAST_Z = 5.0
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACES).split()


def features(word: bytes) -> tuple[bytes, ...]:
    """The word itself and its beginnings of 4 to 7 bytes, which inflected forms share."""
    return (word, *(b"^" + word[:k] for k in range(4, min(8, len(word)))))


class Hits(dict):
    """By word, the numbers of its features in a vocabulary; forgets all words when it has grown large."""

    def __init__(self, vocabulary: list[bytes]):
        super().__init__()
        self.index = {f: i for i, f in enumerate(vocabulary)}

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) > 500_000:
            self.clear()
        own = self[word] = tuple(self.index[f] for f in features(word) if f in self.index)
        return own

    def of(self, text: bytes | None) -> list[int]:
        count = Counter(i for w in words(text) for i in self[w])
        return sorted(i for i, n in count.items() for _ in range(min(n, SATURATED)))


@dataclass(frozen=True)
class WordModel:
    vocabulary: list[bytes]
    weights: np.ndarray
    bias: float

    def scores(self, batches: Iterator[list[bytes | None]]) -> Iterator[np.ndarray]:
        hits = Hits(self.vocabulary)
        for texts in batches:
            z = np.array([self.bias + self.weights[hits.of(t)].sum() for t in texts], float)
            yield 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def nnpu(
    rows: np.ndarray, cols: np.ndarray, positive: np.ndarray, width: int, prior: float, steps: int = 400, rate: float = 0.1, l2: float = 1e-4, weight: np.ndarray | None = None
) -> tuple[np.ndarray, float]:
    """Adam on the non-negative PU risk of the logistic loss; ``rows``/``cols`` are the cells of the design, one for each
    occurrence, and ``weight`` tells how many equal rows one stands for."""
    n, w = len(positive), np.zeros(width + 1)
    w[-1] = np.log(prior / (1 - prior))
    p, u = positive, ~positive
    share = np.ones(n) if weight is None else weight.astype(float)
    share = share / np.where(p, share[p].sum(), share[u].sum())
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        z = np.bincount(rows, w[cols], n) + w[-1]
        s = 1 / (1 + np.exp(-np.clip(z, -700, 700)))  # d/dz of log(1+e^z); that of log(1+e^-z) is s - 1
        negative = np.logaddexp(0, z) * share
        slack = negative[u].sum() - prior * negative[p].sum()
        g = share * np.where(p, -prior * s, s)
        if slack < 0:
            g = -g
        else:
            g[p] += prior * share[p] * (s[p] - 1)
        grad = np.append(np.bincount(cols, g[rows], width), g.sum()) + np.append(l2 * w[:-1], 0)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def frequencies(texts: DataFrame) -> DataFrame:
    """Documents in which each feature ``w`` occurs: ``p`` of those with ``_p``, ``u`` of the others."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[bool, Counter] = {True: Counter(), False: Counter()}

        def flush() -> pa.RecordBatch:
            both = list(count[True].keys() | count[False].keys())
            p, u = ([count[kind][w] for w in both] for kind in (True, False))
            count[True].clear()
            count[False].clear()
            return pa.RecordBatch.from_pydict({"w": pa.array(both, pa.binary()), "p": pa.array(p, pa.int64()), "u": pa.array(u, pa.int64())})

        for b in batches:
            for p, t in zip(b["_p"].to_pylist(), raw(b["_t"]), strict=True):
                count[p].update({f for w in set(words(t)) for f in features(w)})
                if len(count[p]) >= HELD:
                    yield flush()
        yield flush()

    return texts.select("_p", "_t").mapInArrow(counted, "w binary, p long, u long").groupBy("w").agg(F.sum("p").alias("p"), F.sum("u").alias("u"))


def once(texts: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Each ``_id`` with its least ``_t`` (rows without an id stay), and the tables written for that.

    Only ids are shuffled, and the texts of ids that stand in several rows.
    """
    again = cut(texts.groupBy("_id").count().filter("count > 1 AND _id IS NOT NULL").select("_id"), "ids")
    if again.isEmpty():
        return texts, [again]
    least = cut(texts.join(again, "_id", "left_semi").groupBy("_id").agg(F.min("_t").alias("_t")), "least")
    return texts.join(again, "_id", "left_anti").unionByName(least), [again, least]


def dealt(rows: DataFrame, shards: int) -> DataFrame:
    """Distinct rows ``_c`` of count ``_n`` over the shards: a count is split as evenly as whole numbers allow."""
    parts = F.least(F.col("_n"), F.lit(shards)).cast("int")
    part = rows.withColumn("_m", parts).withColumn("_i", F.explode(F.sequence(F.lit(0), parts - 1)))
    more = (F.col("_i") < F.col("_n") % F.col("_m")).cast("long")
    return part.select("_c", F.pmod(F.xxhash64("_c") + F.col("_i"), F.lit(shards)).alias("_s"), (F.floor(F.col("_n") / F.col("_m")) + more).cast("long").alias("_n"))


def design(rows: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (row, column) and weights of rows of features, in the order of their features."""
    rows = sorted(rows)
    lengths = [len(c) for c, _ in rows]
    return np.repeat(np.arange(len(rows)), lengths), np.array([i for c, _ in rows for i in c], int), np.array([n for _, n in rows], int)


def train(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES, shard: int = SHARD, vocabulary_size: int = VOCABULARY
) -> WordModel:
    """A model from the positives among ``labels`` and from all ``docs`` as unlabelled text; pass only labels that may be learnt from.

    At most ``positives`` positive documents enter the fit, each id once (with its least text if it stands in several
    rows); class prior, vocabulary counts, unlabelled text and scores cover all rows.
    """
    small_batches(docs.sparkSession)
    key = F.col(doc_id)
    known = labels.filter(key.isNotNull() & F.col(label).isNotNull()).groupBy(key.alias("_id")).agg(F.max(label).alias("_y"))
    n, toxic = known.agg(F.count("*"), F.sum(F.col("_y").cast("int"))).first()
    prior = ((toxic or 0) + 1) / (n + 2)
    untold = WordModel([], np.zeros(0), float(np.log(prior / (1 - prior))))
    if not toxic:
        return untold
    chosen = known.filter("_y = 1").select("_id").orderBy(F.xxhash64("_id"), "_id").limit(positives)
    texts, scratch = once(docs.select(key.alias("_id"), F.col(text).cast("string").alias("_t")))
    sample = cut(texts.join(F.broadcast(chosen), "_id"), "toxicity")
    np_, nu = sample.count(), texts.count()
    if not np_:
        return untold

    share = (F.col("p") + F.col("u")) / (np_ + nu)
    apart = (F.col("p") / np_ - F.col("u") / nu) / F.sqrt(share * (1 - share) * (1 / np_ + 1 / nu) + 1e-12)
    told = frequencies(sample.select(F.lit(True).alias("_p"), "_t").union(texts.select(F.lit(False), "_t")))
    marking = told.filter((F.col("p") + F.col("u") >= LEAST_DOCUMENTS) & (apart >= LEAST_Z)).orderBy(apart.desc(), "w")
    vocabulary = [bytes(r["w"]) for r in marking.limit(vocabulary_size).collect()]
    width = len(vocabulary)

    @F.arrow_udf("array<int>")
    def present(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        hits = Hits(vocabulary)
        for column in batches:
            yield pa.array([hits.of(t) for t in raw(column)], pa.list_(pa.int32()))

    def alike(rows: DataFrame) -> DataFrame:
        return rows.select(present("_t").alias("_c")).groupBy("_c").agg(F.count("*").alias("_n"))

    confirmed = [(tuple(r["_c"]), r["_n"]) for r in alike(sample).collect()]

    def fit(group: pa.Table) -> pa.Table:
        rows_p, cols_p, weight_p = design(confirmed)
        rows_u, cols_u, weight_u = design([(tuple(c), m) for c, m in zip(group["_c"].to_pylist(), group["_n"].to_pylist(), strict=True)])
        positive = np.arange(len(weight_p) + len(weight_u)) < len(weight_p)
        rows, cols = np.append(rows_p, rows_u + len(weight_p)), np.append(cols_p, cols_u)
        weights, bias = nnpu(rows, cols, positive, width, prior, weight=np.append(weight_p, weight_u))
        scaled = np.rint(np.append(weights, bias) * int(weight_u.sum()) * UNIT).astype("i8")
        return pa.table({"_k": np.arange(width + 1, dtype="i4"), "_w": scaled})

    shards = dealt(alike(texts), max(1, round(nu / shard)))
    fitted = shards.groupBy("_s").applyInArrow(fit, "_k int, _w long").groupBy("_k").agg(F.sum(F.col("_w").cast("decimal(38,0)")).alias("_w"))
    mean = np.zeros(width + 1)
    for r in fitted.collect():
        mean[r["_k"]] = int(r["_w"]) / (nu * UNIT)
    drop(sample, *scratch)
    return WordModel(vocabulary, mean[:-1], float(mean[-1]))


def score(text: Column, model: WordModel) -> Column:
    @F.arrow_udf("double")
    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for z in model.scores(map(raw, batches)):
            yield pa.array(z, pa.float64())

    return scored(text.cast("string"))


def classify(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, threshold: float = 0.7, label: str = "toxic", doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document ``held_out``, ``score`` and ``predicted``; fold ``held`` of ``folds`` is not learnt from."""
    model = train(docs, labels.filter(remainder(F.col(doc_id), folds) != held), label, doc_id, text)
    scored = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(remainder(F.col(doc_id), folds) == held, F.lit(False)).alias("held_out"), score(F.col(text), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))

"""Quality rules as a short-circuit cascade.

A document is kept when every rule accepts it. The verdict does not depend on the order of the rules, but
the work does: each rule's cost and rejection rate are measured on a bounded sample, the rules run in order
of rejections per second, and a document leaves at the first rule that rejects it. Statistics are computed
lazily, so rules that are never reached cost nothing.

Nulls and empty texts have no words and fail the base rules. Rows are judged one by one: repeated rows get
equal verdicts, an empty table gives an empty result, and only the named columns are looked at.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import raw, small_batches
from glintscan.llm.textstats import Document

#: Rows of the sample on which rules are measured, and the longest text (in bytes) that it takes.
SAMPLE_ROWS, SAMPLE_BYTES = 512, 1 << 18


@dataclass(frozen=True)
class Rule:
    """``rejects`` tells whether a document fails; ``base`` rules fail a document whatever else it has."""

    name: str
    rejects: Callable[[Document], bool]
    base: bool = False


RULES = (
    Rule("few_words", lambda d: d.n_words < 50, base=True),
    Rule("repeated_words", lambda d: 100 * d.n_repeat_words > 50 * d.n_words, base=True),
    Rule("symbols", lambda d: 10 * d.n_symbols > d.n_words),
    Rule("duplicate_lines", lambda d: d.n_dup_lines >= 3 and 10 * d.n_dup_lines > 3 * len(d.lines)),
    Rule("shouting", lambda d: 2 * d.n_upper > d.word_chars),
    Rule("digits", lambda d: 10 * d.n_digits > 3 * d.word_chars),
    Rule("word_length", lambda d: not 2 * d.n_words <= d.word_chars <= 20 * d.n_words),
)


@dataclass(frozen=True)
class Measured:
    rule: Rule
    seconds: float
    rejected: float

    @property
    def gain(self) -> float:
        """Share of documents rejected per second spent on one."""
        return self.rejected / max(self.seconds, 1e-9)


def measure(texts: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> list[Measured]:
    """Mean cost and rejection rate of each rule alone, on documents with nothing computed yet."""
    found = []
    for rule in rules:
        docs = [Document(t) for t in texts]
        began = time.perf_counter()
        rejected = sum(map(rule.rejects, docs))
        found.append(Measured(rule, (time.perf_counter() - began) / max(1, len(docs)), rejected / max(1, len(docs))))
    return found


def cascade(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> tuple[Rule, ...]:
    """The rules in the order in which to try them on ``docs``."""
    small_batches(docs.sparkSession)
    t = F.col(text)
    sample = docs.filter(F.octet_length(t) <= SAMPLE_BYTES).filter(F.pmod(F.xxhash64(t), F.lit(8)) == 0).select(F.encode(t, "UTF-8")).take(SAMPLE_ROWS)
    return tuple(m.rule for m in sorted(measure([bytes(r[0]) for r in sample], rules), key=lambda m: (-m.gain, m.seconds)))


def first_failed(doc: Document, order: tuple[Rule, ...]) -> Rule | None:
    return next((r for r in order if r.rejects(doc)), None)


def verdict(order: tuple[Rule, ...], text: str = "text") -> Column:
    """Boolean column: every rule accepts the text. Later rules are not run once one has rejected."""

    @F.arrow_udf("boolean")
    def accepted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([first_failed(Document(t), order) is None for t in raw(column)], pa.bool_())

    return accepted(F.col(text).cast("string"))


def keep(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that pass, with all their columns."""
    return docs.filter(verdict(cascade(docs, text, rules), text))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def assess(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per document the base measures, ``base_failed`` and ``kept``.

    The cascade decides ``kept`` first; measures that it did not need are then filled in for the report.
    """
    order = cascade(docs, text, rules)
    base = tuple(r for r in rules if r.base)
    fields = ", ".join(f"{m} long" for m in MEASURES)

    def one(text: bytes | None) -> tuple:
        """The cascade first, then what it left out; the document's words go before the next one comes."""
        d = Document(text)
        failed = first_failed(d, order)
        return (*(getattr(d, m) for m in MEASURES), failed is not None and (failed.base or any(r.rejects(d) for r in base)), failed is None)

    @F.arrow_udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')},base_failed:boolean,kept:boolean>")
    def judged(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            rows = list(map(one, raw(column)))
            kinds = [pa.int64()] * len(MEASURES) + [pa.bool_()] * 2
            yield pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [*MEASURES, "base_failed", "kept"])

    return docs.select(F.col(doc_id).alias("doc_id"), judged(F.col(text).cast("string")).alias("_q")).select("doc_id", "_q.*")

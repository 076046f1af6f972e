"""Divergence of sources by inclusion-exclusion over the supports of their terms.

Within a language each source, and the language itself, gives every kept term a smoothed share ``p`` of 10^9, which
depends on the term's count there alone. The distance of two shares is ``f = floor((p - q)^2 / (p + q))``. Few of the terms
occur in both of two sources, so the sum of ``f`` over all kept terms is taken apart:

- all terms as if neither source had them: a constant;
- terms of one source as if the other lacked them: priced from the histogram of that source's counts;
- terms of both: joined by their postings, which correct the two former.

Sources of a language come in blocks of about ``BLOCK``; a term's postings are one row for each block that has it, and
rows of blocks meet, not rows of sources. Tasks add up their part for pairs of sources before anything is exchanged.

Null texts, languages and sources count as empty. Repeated rows count as often as they stand there. A language without
kept terms has pairs of value 0 and no terms; an empty table gives an empty result. Only the named columns are looked
at. Texts are counted in sections, so a very long one takes memory for its distinct terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintscan.llm.common import cut, drop, raw, small_batches

#: Documents of a language that a term must be in, parts that shares are counted in, and added to each count.
LEAST_DOCUMENTS, SCALE, SMOOTH = 10, 1_000_000_000, 2
#: Terms listed for each source; sources of a block; distinct terms and matrices that a task holds.
TOP, BLOCK, HELD, MATRICES = 10, 64, 1_000_000, 256
_SECTION = 1 << 20
#: Letters in lower case and bytes of other scripts stay, all else parts terms.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def sections(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a bounded part of it at a time."""
    at = 0
    while at < len(text):
        end = len(text) if len(text) - at <= _SECTION else at + _SECTION
        part = text[at:end].translate(_TERMS)
        if end < len(text):  # the last term may go on; a longer one than a section is read as it grows
            whole = part.rfind(b" ") + 1
            while not whole and end < len(text):
                end = min(len(text), end + _SECTION)
                part = text[at:end].translate(_TERMS)
                whole = part.rfind(b" ") + 1 if end < len(text) else len(part)
            part = part[:whole]
        at += len(part)
        yield part.split()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, d) of ``docs`` (lang, source, _t): occurrences and documents, added up within a task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple, Counter] = {}
        within: dict[tuple, Counter] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for (lang, source), terms in total.items():
                d, n = within[lang, source], len(terms)
                columns = [pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array(list(terms), pa.binary())]
                columns += [pa.array(list(terms.values()), pa.int64()), pa.array(list(map(d.__getitem__, terms)), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "d"])
            total.clear()
            within.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(b["lang"].to_pylist(), b["source"].to_pylist(), raw(b["_t"]), strict=True):
                every, own = total.setdefault((lang, source), Counter()), set()
                documents = within.setdefault((lang, source), Counter())
                before = len(every)
                for terms in sections(text or b""):
                    every.update(terms)
                    own.update(terms)
                documents.update(own)
                held += len(every) - before
                if held > HELD:
                    yield from flush()
                    held = 0
        yield from flush()

    found = docs.mapInArrow(of, "lang string, source string, term binary, n long, d long")
    return found.withColumn("term", F.col("term").cast("string"))


def share(n: Column, total: Column, terms: Column) -> Column:
    """``1 + floor(10^9 (n + 2) / (total + 2 terms))``; 0 where a language has no terms."""
    whole = F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * (n + SMOOTH).cast("decimal(20,0)"), (total + SMOOTH * terms).cast("decimal(20,0)"))
    return F.when(terms > 0, 1 + whole.cast("long")).otherwise(F.lit(0).cast("long"))


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _distances(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """``f`` of all pairs, exact: squares stay below 2^63."""
    d = p[:, None] - q[None, :]
    return d * d // np.maximum(p[:, None] + q[None, :], 1)


class Sums:
    """Sums for pairs of sources, in one matrix for each pair of blocks; handed on when there are many."""

    SCHEMA = "lang string, lo long, hi long, value long"

    def __init__(self) -> None:
        self.held: dict[tuple, np.ndarray] = {}  # two layers: the sum, and whether anything was added

    def add(self, lang: str, a: int, b: int, rows: np.ndarray, columns: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        m = self.held.get((lang, a, b))
        shape = (int(rows.max(initial=0)) + 1, int(columns.max(initial=0)) + 1)
        if m is None or m.shape[1] < shape[0] or m.shape[2] < shape[1]:
            old = np.zeros((2, 0, 0), np.int64) if m is None else m
            m = self.held[lang, a, b] = np.zeros((2, max(old.shape[1], shape[0]), max(old.shape[2], shape[1])), np.int64)
            m[:, : old.shape[1], : old.shape[2]] = old
        at = np.ix_(rows, columns)
        m[0][at] += value
        m[1][at] = 1
        if len(self.held) > MATRICES:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        for (lang, a, b), (m, there) in self.held.items():
            i, j = np.nonzero(there)
            x, y = (a << 32) + i, (b << 32) + j
            lo, hi = np.minimum(x, y), np.maximum(x, y)
            apart = lo < hi
            columns = [pa.array([lang] * int(apart.sum()), pa.string()), *(pa.array(v[apart]) for v in (lo, hi, m[i, j]))]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "lo", "hi", "value"])
        self.held.clear()


def _lists(column: pa.ListArray) -> Callable[[int], list[np.ndarray]]:
    """The three number fields of each row's list of structs, as views of the whole column."""
    at, values = column.offsets.to_numpy(), column.values
    fields = [f.to_numpy(zero_copy_only=False) for f in (values.field(0), values.field(1), values.field(2))]
    return lambda k: [f[at[k] : at[k + 1]] for f in fields]


def one_sided(cells: DataFrame, blocks: DataFrame) -> DataFrame:
    """Prices of each source's terms as if other sources lacked them, less the constant; and that constant, from bare rows."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for b in batches:
            for r in b.to_pylist():
                p0 = np.array([r["p0"]], np.int64)
                other_i = np.array([x["i"] for x in r["sources"]], np.int64)
                other = np.array([x["p0"] for x in r["sources"]], np.int64)
                none = _distances(p0, other)[0]
                if r["cells"] is None:  # every pair's constant is added once, by the source with the less number
                    value = r["terms"] * none * ((r["block"] << 32) + r["i"] < (r["other"] << 32) + other_i)
                else:
                    p, n = (np.array([x[k] for x in r["cells"]], np.int64) for k in ("p", "n"))
                    value = n @ (_distances(p, other) - none)
                yield from sums.add(r["lang"], r["block"], r["other"], np.array([r["i"]]), other_i, value[None, :])
        yield from sums.flush()

    met = cells.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).join(blocks, ["lang", "other"])
    return met.select("lang", "block", "i", "other", "p0", "terms", "cells", "sources").mapInArrow(of, Sums.SCHEMA)


def overlaps(postings: DataFrame) -> DataFrame:
    """What terms of both sources change in the sums of ``one_sided``. Rows of ``postings`` are those of a term and a block."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = Sums()
        for batch in batches:
            left, right = _lists(batch["a"]), _lists(batch["b"])
            where = zip(batch["lang"].to_pylist(), batch["x"].to_pylist(), batch["y"].to_pylist(), strict=True)
            for k, (lang, x, y) in enumerate(where):
                (ia, p, p0), (ib, q, q0) = (side(k) for side in (left, right))
                # both there, less one or the other alone, and neither once more
                value = _distances(p, q) - _distances(p, q0) - _distances(p0, q) + _distances(p0, q0)
                if x == y:  # within a block a pair is met from either side
                    value *= ia[:, None] < ib[None, :]
                yield from sums.add(lang, x, y, ia, ib, value)
        yield from sums.flush()

    side = lambda block, name: postings.select("lang", "term", F.col("block").alias(block), F.col("entries").alias(name))
    met = side("x", "a").join(side("y", "b"), ["lang", "term"]).filter("x <= y")
    return met.select("lang", "x", "y", "a", "b").mapInArrow(of, Sums.SCHEMA)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", top: int = TOP, least: int = LEAST_DOCUMENTS) -> DataFrame:
    """Per (lang, source): its distance to each other source of the language (part ``pair``), and the terms that it has most
    beyond the language's share (part ``term``, the first ``top``): item, value, rank."""
    small_batches(docs.sparkSession)
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    given = docs.select(empty(lang).alias("lang"), empty(source).alias("source"), F.col(text).cast("string").alias("_t"))
    counts = cut(counted(given).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("d").alias("d")), "counts")
    by_term = counts.groupBy("lang", "term").agg(F.sum("d").alias("d"), F.sum("n").alias("all")).filter(F.col("d") >= least).drop("d")
    kept = cut(counts.drop("d").join(by_term, ["lang", "term"]), "kept")
    drop(counts)

    # sources by number: their block, and their place in it
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    whole = kept.groupBy("lang", "term").agg(F.first("all").alias("all")).groupBy("lang").agg(F.count("*").alias("terms"), F.sum("all").alias("all_total"))
    groups = given.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").fillna(0, ["total"])
    size = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("blocks"))
    groups = groups.join(size, "lang").join(whole, "lang", "left").fillna(0, ["terms", "all_total"])
    groups = groups.withColumn("block", F.pmod(F.xxhash64("source"), "blocks"))
    groups = groups.withColumn("i", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("source")) - 1).cast("long"))
    groups = cut(groups.withColumn("p0", share(F.lit(0), F.col("total"), F.col("terms"))), "groups")

    priced = kept.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    entry = F.struct("i", "p", "p0")
    postings = priced.repartition("lang", "term").groupBy("lang", "term", "block").agg(F.collect_list(entry).alias("entries"))
    # counts of a source as a histogram, in rows of counts of one magnitude
    histogram = kept.groupBy("lang", "source", "n").agg(F.count("*").alias("k")).join(groups, ["lang", "source"])
    histogram = histogram.withColumn("p", share(F.col("n"), F.col("total"), F.col("terms")))
    about = ["lang", "block", "i", "p0", "terms", "blocks"]
    part = (F.floor(F.log2(F.col("n").cast("double"))) * 8 + F.pmod("n", F.lit(8))).alias("part")
    cells = histogram.groupBy(*about, part).agg(F.collect_list(F.struct("p", F.col("k").alias("n"))).alias("cells")).drop("part")
    bare = groups.select(*about, F.lit(None).cast(cells.schema["cells"].dataType).alias("cells"))
    blocks = groups.groupBy("lang", F.col("block").alias("other")).agg(F.collect_list(F.struct("i", "p0")).alias("sources"))

    sides = one_sided(cells.union(bare.select(*cells.columns)), blocks).union(overlaps(postings))
    sides = sides.groupBy("lang", "lo", "hi").agg(F.sum("value").alias("value"))
    number = (F.shiftleft("block", 32) + F.col("i")).alias("number")
    named = groups.select("lang", number, "source")
    first, other = (named.select("lang", F.col("number").alias(k), F.col("source").alias(n)) for k, n in (("lo", "source"), ("hi", "item")))
    pairs = sides.join(first, ["lang", "lo"]).join(other, ["lang", "hi"])
    pairs = pairs.select("lang", F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))).alias("s"), "value").select("lang", "s.*", "value")
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(ranked).alias("rank"))

    over = priced.withColumn("q", share(F.col("all"), F.col("all_total"), F.col("terms"))).filter("p > q")
    over = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    return pairs.union(over.withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= top))

"""Substring dedup by prefix-partitioned suffix trees.

A window of ``window`` words is a repeat when its words also start in a document with a smaller id; every word
that a repeat covers is removed. Suffixes are looked at from anchors: of the ``k``-word grams of a window the one
with the least hash, which two equal windows share at the same place, so about one suffix in twenty is needed.

1. Anchors are counted by the hash of their gram, the prefix of their suffix. A prefix that only one document
   has starts no repeat; documents without a repeated prefix are not looked at again.
2. Suffixes with repeated prefixes are dealt to tasks by prefix, each with the words that its windows reach on
   both sides. A task grows the trees of its suffixes level by level, to the right and, for what precedes the
   anchor, to the left: the suffixes in one node have equal words down to its depth. A pair of nodes whose
   depths add up to a window is a repeat, and its least document keeps it.
3. A prefix with more than ``group`` suffixes would not fit a task. Its prefixes are lengthened to whole windows:
   then a group is one node, and a partial aggregation finds its least document without gathering it.

Words are runs of anything but ASCII white space. Null and empty texts have no words. Rows without an id keep
all words and take no part; rows that share an id never repeat each other. Repeated rows come out once each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, every_salt, raw, salt, small_batches
from glintscan.llm.shingles import WordHashes, windows

#: Words of a gram; suffixes that a task takes for one prefix; words looked at in one piece.
GRAM, GROUP, PIECE = 10, 32_768, 1 << 20
SALTS = 8


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have, n = 1, len(x)
    while 2 * have <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    return np.minimum(x[: n - width + 1], x[width - have : n - have + 1])


def anchors(words: list[bytes], hashes: WordHashes, window: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For pieces of a text: gram hashes and positions of the anchors, and the first and last start of the windows of each.

    Pieces overlap, so that each window lies in one of them.
    """
    h = hashes.of(words)
    for begin in range(0, max(1, len(h) - window + 1), PIECE - window + 1):
        part = h[begin : begin + PIECE]
        if len(part) < window:
            return
        gram = windows(part, GRAM)
        low = np.uint64(PIECE - 1)
        least = sliding_least((gram & ~low) | np.arange(len(gram), dtype=np.uint64), window - GRAM + 1)
        at = (least & low).astype(np.int64)  # the anchor of each window
        first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
        last = np.r_[first[1:], len(at)] - 1
        yield gram[at[first]].view(np.int64), at[first] + begin, first + begin, last + begin


def _levels(start: np.ndarray, room: np.ndarray, step: int, depth: int, flat: np.ndarray, width: int) -> list[np.ndarray]:
    """Node of each suffix at every depth up to ``depth``, reading ``flat`` from ``start`` on; -1 past ``room`` words."""
    node = np.zeros(len(start), np.int64)
    out = [node]
    for d in range(depth):
        inside = (d < room) & (node >= 0)
        key = node[inside] * width + flat[start[inside] + step * d]
        node = np.full(len(start), -1, np.int64)
        node[inside] = np.unique(key, return_inverse=True)[1]
        out.append(node)
    return out


def repeats(contexts: list[bytes], doc: np.ndarray, left: np.ndarray, wins: np.ndarray, window: int) -> np.ndarray:
    """Matrix (suffixes x windows): the ``j``-th window of a context starts in a smaller document too.

    A context holds ``wins`` windows from its first word on; the anchor is word ``left``.
    """
    split = [c.split() for c in contexts]
    lens = np.fromiter(map(len, split), np.int64, len(split))
    number = {w: i for i, w in enumerate({w for c in split for w in c})}
    flat = np.fromiter((number[w] for c in split for w in c), np.int64, lens.sum())
    at = np.r_[0, np.cumsum(lens)[:-1]] + left
    right = _levels(at, lens - left, 1, window, flat, len(number) + 1)
    before = _levels(at - 1, left, -1, int(left.max(initial=0)), flat, len(number) + 1)
    out = np.zeros((len(split), int(wins.max(initial=0))), bool)
    for o, lower in enumerate(before):
        rows = np.nonzero((o <= left) & (left - o < wins))[0]  # has the window that starts o words before the anchor
        key = lower[rows] * len(split) + right[window - o][rows]
        node = np.unique(key, return_inverse=True)[1]
        least = np.full(len(rows), np.iinfo(np.int64).max)
        np.minimum.at(least, node, doc[rows])
        again = rows[doc[rows] > least[node]]
        out[again, left[again] - o] = True
    return out


def removed_ranges(docs: DataFrame, window: int, group: int) -> DataFrame:
    """(_id, _h, start, end): word ranges that repeats cover; ``docs`` has _id, _h (hash of the text) and _t."""

    def anchored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for b in batches:
            grams, rows = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, (d, t) in enumerate(zip(b["_id"].to_pylist(), raw(b["_t"]), strict=True)):
                if d is not None and t:
                    for g, *_ in anchors(t.split(), hashes, window):
                        grams.append(g)
                        rows.append(np.full(len(g), i))
            at = pa.array(np.concatenate(rows))
            yield pa.RecordBatch.from_arrays([b["_id"].take(at), b["_h"].take(at), pa.array(np.concatenate(grams))], ["_id", "_h", "gram"])

    found = cut(docs.mapInArrow(anchored, "_id long, _h long, gram long"), "anchors")
    stats = found.groupBy("gram").agg(F.min("_id").alias("least"), F.max("_id").alias("most"), F.count("*").alias("n")).filter("least < most")
    some = found.withColumn("s", salt(F.struct("_id", "_h"), SALTS)).join(stats.select("gram", (F.col("n") > group).alias("large"), every_salt(SALTS).alias("s")), ["gram", "s"])
    wanted = cut(some.groupBy("_id", "_h").agg(F.collect_set(F.when(~F.col("large"), F.col("gram"))).alias("grams"), F.collect_set(F.when(F.col("large"), F.col("gram"))).alias("large")), "wanted")
    looked = docs.join(wanted.hint("merge"), ["_id", "_h"], "left")  # an outer join, so that one exchange of texts serves all steps

    def contexts(column: str, whole: bool) -> object:
        def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hashes = WordHashes()
            schema = pa.schema([("gram", pa.int64()), ("_id", pa.int64()), ("_h", pa.int64()), ("start", pa.int64()), ("left", pa.int64()), ("wins", pa.int64()), ("context", pa.binary())])
            for b in batches:
                rows = []
                for d, h, t, grams in zip(b["_id"].to_pylist(), b["_h"].to_pylist(), raw(b["_t"]), b[column].to_pylist(), strict=True):
                    if not grams:
                        continue
                    words, own = t.split(), np.array(grams, np.int64)
                    for g, at, first, last in anchors(words, hashes, window):
                        for i in np.nonzero(np.isin(g, own))[0]:
                            if whole:
                                for s in range(first[i], last[i] + 1):
                                    rows.append((0, d, h, s, 0, 1, xxhash.xxh3_128_digest(b" ".join(words[s : s + window]))))
                            else:
                                rows.append((int(g[i]), d, h, int(first[i]), int(at[i] - first[i]), int(last[i] - first[i] + 1), b" ".join(words[first[i] : last[i] + window])))
                    if len(rows) >= 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        return of

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(list(batches), pa.schema([("gram", pa.int64()), ("_id", pa.int64()), ("_h", pa.int64()), ("start", pa.int64()), ("left", pa.int64()), ("wins", pa.int64()), ("context", pa.binary())]))
        # whole groups at a time, so that a task's matrices stay small
        rows = rows.take(pa.array(np.argsort(rows["gram"].to_numpy(), kind="stable")))
        gram = rows["gram"].to_numpy()
        ends = np.r_[np.nonzero(gram[1:] != gram[:-1])[0] + 1, len(gram)] if len(gram) else []
        begin = 0
        for i, end in enumerate(ends):
            if end - begin < GROUP and i + 1 < len(ends):
                continue
            part = rows.slice(begin, end - begin)
            begin = end
            start = part["start"].to_numpy()
            again = repeats(part["context"].to_pylist(), part["_id"].to_numpy(), part["left"].to_numpy(), part["wins"].to_numpy(), window)
            edge = np.diff(np.pad(again, ((0, 0), (1, 1))).astype(np.int8), axis=1)
            row, first = np.nonzero(edge == 1)
            _, last = np.nonzero(edge == -1)
            yield pa.RecordBatch.from_arrays([part["_id"].combine_chunks().take(pa.array(row)), part["_h"].combine_chunks().take(pa.array(row)), pa.array(start[row] + first), pa.array(start[row] + last - 1 + window)], ["_id", "_h", "start", "end"])

    fields = "gram long, _id long, _h long, start long, left long, wins long, context binary"
    ranges = looked.select("_id", "_h", "_t", "grams").mapInArrow(contexts("grams", False), fields).repartition("gram").mapInArrow(trees, "_id long, _h long, start long, end long")
    if not wanted.filter(F.size("large") > 0).isEmpty():
        # used twice in one query: the exchange of texts is the same as above, so only the windows are made twice
        whole = looked.select("_id", "_h", "_t", "large").mapInArrow(contexts("large", True), fields).select("_id", "_h", "start", "context")
        least = whole.groupBy("context").agg(F.min("_id").alias("least"), F.max("_id").alias("most")).filter("least < most").select("context", "least", every_salt(SALTS).alias("s"))
        again = whole.withColumn("s", salt(F.struct("_id", "start"), SALTS)).join(least, ["context", "s"]).filter("_id > least")
        ranges = ranges.union(again.select("_id", "_h", "start", F.col("start") + window))
    return ranges


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 50, group: int = GROUP) -> DataFrame:
    """Per row ``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (the words that stay, joined by single spaces)."""
    if window < GRAM:
        raise ValueError(f"a window needs {GRAM} words")
    small_batches(docs.sparkSession)
    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.xxhash64(text).alias("_h"), F.col(text).cast("string").alias("_t"))
    ranges = removed_ranges(given, window, group).groupBy("_id", "_h").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, gone, texts = [], [], []
            for t, ranges in zip(raw(b["_t"]), b["ranges"].to_pylist(), strict=True):
                words = (t or b"").split()
                stays = np.ones(len(words), bool)
                for r in ranges or ():
                    stays[r["start"] : r["end"]] = False
                n.append(len(words))
                gone.append(len(words) - int(stays.sum()))
                texts.append(b" ".join(words if gone[-1] == 0 else [words[i] for i in np.nonzero(stays)[0]]))
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(texts, pa.binary())], ["doc_id", "n_words", "n_removed", "kept"])

    return given.join(ranges.hint("merge"), ["_id", "_h"], "left").select("_id", "_t", "ranges").mapInArrow(kept, "doc_id long, n_words long, n_removed long, kept binary")

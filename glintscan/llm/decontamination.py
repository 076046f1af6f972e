"""Benchmark decontamination by greedy string tiling.

A document is held against the benchmark items with which it shares a seed, a run of ``LEAST`` words. For such
a pair the longest common runs of words are marked first, then shorter ones among the words still free, each
length by running Karp-Rabin hashes (Wise's RKR-GST), down to ``LEAST`` words: tiles never overlap, and their
order does not matter, so reordered passages count in full. The share of an item's words under tiles is its
coverage; a document is contaminated when it covers an item to at least ``COVERAGE``.

Words are runs of ASCII letters, digits and non-ASCII characters, lower-cased in ASCII. Items of fewer than
``LEAST`` words are matched whole, as one tile; null items, items without words, and null or empty texts match
nothing. Rows are judged one by one; repeated rows and repeated items change nothing. Ties go to the least item id.
Items go to the tasks in blocks of at most ``BLOCK_BYTES`` of text; where there are several, each block's matches are
written down, by the digest of the text, before the next block is sent out, so that one is held at a time.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, fresh, raw, small_batches
from glintscan.llm.shingles import rolled

LEAST, COVERAGE, BLOCK_BYTES = 5, 0.5, 32 << 20
_SPACES = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().translate(_SPACES).split()


def _matches(item: np.ndarray, text: np.ndarray, free_item: np.ndarray, free_text: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least ``length`` free words: (words, place in the item, place in the text)."""
    at_item = [np.nonzero(np.convolve(f, np.ones(length, int), "valid") == length)[0] if len(f) >= length else np.zeros(0, int) for f in (free_item, free_text)]
    hi, ht = rolled(item.astype(np.uint64), length)[at_item[0]], rolled(text.astype(np.uint64), length)[at_item[1]]
    places = defaultdict(list)
    for h, p in zip(hi.tolist(), at_item[0].tolist(), strict=True):
        places[h].append(p)
    found = []
    for h, t in zip(ht.tolist(), at_item[1].tolist(), strict=True):
        for p in places.get(h, ()):
            if p and t and free_item[p - 1] and free_text[t - 1] and item[p - 1] == text[t - 1]:
                continue  # part of a longer run
            n = 0
            while p + n < len(item) and t + n < len(text) and free_item[p + n] and free_text[t + n] and item[p + n] == text[t + n]:
                n += 1
            if n >= length:
                found.append((n, p, t))
    return found


def tiles(item: np.ndarray, text: np.ndarray, least: int = LEAST, length: int = 20) -> list[tuple[int, int, int]]:
    """Greedy tiling of an item by a text, both as word numbers: (words, place in the item, place in the text)."""
    free_item, free_text = np.ones(len(item), bool), np.ones(len(text), bool)
    out, length = [], max(least, min(length, len(item)))
    while True:
        heap = [(-n, p, t) for n, p, t in _matches(item, text, free_item, free_text, length)]
        heapq.heapify(heap)
        if heap and -heap[0][0] > 2 * length:
            length = -heap[0][0]
            continue
        while heap:
            n, p, t = heapq.heappop(heap)
            free = free_item[p : p - n] & free_text[t : t - n]
            if free.all():
                free_item[p : p - n] = free_text[t : t - n] = False
                out.append((-n, p, t))
                continue
            # a longer tile covers a part: what is free waits for its turn by its own length
            edges = np.flatnonzero(np.diff(np.r_[False, free, False]))
            for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
                if end - start >= length:
                    heapq.heappush(heap, (start - end, p + start, t + start))
        if length == least:
            return out
        length = max(least, length // 2)


class Items:
    """A block of benchmark items: their words numbered from 1, their seeds by hash, and short ones by length and hash."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        self.number: dict[bytes, int] = {}
        self.items: dict[int, np.ndarray] = {}
        seeds, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        self.short: dict[int, dict[int, int]] = defaultdict(dict)
        for item_id, text in rows:
            ids = np.array([self.number.setdefault(w, len(self.number) + 1) for w in words(text)], np.int32)
            if len(ids) >= LEAST:
                self.items[item_id] = ids
                seeds.append(np.unique(rolled(ids.astype(np.uint64), LEAST)))
                owners.append(np.full(len(seeds[-1]), item_id, np.int64))
            elif len(ids):
                (h,) = rolled(ids.astype(np.uint64), len(ids)).tolist()
                self.short[len(ids)][h] = min(item_id, self.short[len(ids)].get(h, item_id))
        # seeds in order, each with its items side by side: 16 bytes for a word of the benchmark
        every, owner = np.concatenate(seeds), np.concatenate(owners)
        order = np.argsort(every, kind="stable")
        self.sorted, self.owner = every[order], owner[order]

    def best(self, text: bytes | None, coverage_least: float = COVERAGE) -> tuple[float, int, int] | None:
        """Coverage, item and number of tiles of the item that a text covers most (ties: the least id); items that cannot reach ``coverage_least`` are left out."""
        get = self.number.get
        own = words(text)
        ids = np.fromiter((get(w, 0) for w in own), np.int64, len(own))
        whole = [self.short[n][h] for n in list(self.short) for h in self.short[n].keys() & set(rolled(ids.astype(np.uint64), n).tolist())]
        found = (1.0, min(whole), 1) if whole else None
        if len(ids) < LEAST or not len(self.sorted):
            return found
        known = np.convolve(ids > 0, np.ones(LEAST, int), "valid") == LEAST
        at = np.nonzero(known)[0]
        if not len(at):
            return found
        h = rolled(ids.astype(np.uint64), LEAST)[at]
        first, last = np.searchsorted(self.sorted, h), np.searchsorted(self.sorted, h, "right")
        hit = first < last
        shared = defaultdict(list)
        for p, x, y in zip(at[hit].tolist(), first[hit].tolist(), last[hit].tolist(), strict=True):
            for item in self.owner[x:y].tolist():
                shared[item].append(p)
        for item, places in sorted(shared.items()):
            ids_item = self.items[item]
            if LEAST * len(set(places)) < coverage_least * len(ids_item):
                continue
            # only words under seeds can lie under tiles; a break between them keeps runs apart
            under = np.unique(np.add.outer(places, np.arange(LEAST)).ravel())
            breaks = np.nonzero(np.diff(under) > 1)[0] + 1
            part = np.insert(ids[under].astype(np.int64), breaks, -np.arange(1, len(breaks) + 1))
            found_tiles = tiles(ids_item, part)
            coverage = sum(n for n, _, _ in found_tiles) / len(ids_item)
            if found is None or (coverage, -item) > (found[0], -found[1]):
                found = (coverage, item, len(found_tiles))
        return found


def blocks(benchmark: DataFrame, item_id: str, text: str) -> tuple[Iterator[list[tuple[int, bytes]]], int]:
    """All items, a bounded block at a time, and the number of blocks."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).filter("i is not null and t is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("t").cast("long"))).first()[0] or 0
    n = 2 * size // BLOCK_BYTES + 1
    block = lambda k: [(r["i"], bytes(r["t"])) for r in rows.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k).select("i", F.encode("t", "UTF-8").alias("t")).collect()]
    return map(block, range(n)), n


def _best(text: Column, items: object, coverage: float) -> Column:
    @F.arrow_udf("struct<coverage:double,item_id:long,tiles:long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            found = [items.value.best(t, coverage) for t in raw(column)]
            yield pa.array([None if f is None else {"coverage": f[0], "item_id": f[1], "tiles": f[2]} for f in found], pa.struct([("coverage", pa.float64()), ("item_id", pa.int64()), ("tiles", pa.int64())]))

    return of(text)


def matched(docs: DataFrame, benchmark: DataFrame, name: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """``docs`` with a column ``name``: coverage, item and tiles of the item that each text covers most, of those that
    can reach ``coverage``; null without one."""
    small_batches(docs.sparkSession)
    sc, t = docs.sparkSession.sparkContext, F.col(text).cast("string")
    known, n = blocks(benchmark, item_id, item_text)
    if n == 1:
        return docs.withColumn(name, _best(t, sc.broadcast(Items(next(known))), coverage))
    found = []
    for rows in known:
        held = sc.broadcast(Items(rows))
        told = docs.select(F.sha2(t, 256).alias("_digest"), _best(t, held, coverage).alias("_match")).filter("_match is not null").distinct()
        found.append(cut(told, "matches"))
        held.unpersist()
    key = fresh(docs, "digest")
    best = F.max_by("_match", F.struct("_match.coverage", -F.col("_match.item_id"))).alias(name)
    every = reduce(DataFrame.union, found).groupBy(F.col("_digest").alias(key)).agg(best)
    return docs.withColumn(key, F.sha2(t, 256)).join(every, key, "left").select(*(F.col(c) for c in (*docs.columns, name)))


def assess(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """Per row ``contaminated``, and coverage (0 without a match), item and tiles of the best match."""
    found = matched(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_t")), benchmark, "m", "_t", coverage=coverage)
    share = F.coalesce("m.coverage", F.lit(0.0))
    return found.select("doc_id", (share >= coverage).alias("contaminated"), share.alias("coverage"), "m.item_id", F.coalesce("m.tiles", F.lit(0)).cast("long").alias("tiles"))


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", coverage: float = COVERAGE) -> DataFrame:
    """The rows of ``docs`` that cover no item."""
    own = fresh(docs, "match")
    found = matched(docs, benchmark, own, text, coverage=coverage)
    return found.filter(F.coalesce(f"{own}.coverage", F.lit(0.0)) < coverage).select(*docs.columns)

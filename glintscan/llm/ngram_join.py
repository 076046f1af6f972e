"""N-gram Jaccard join by token-combination prefixes; gives each document the component of its links.

Two documents link when the Jaccard similarity of their sets of word shingles reaches a threshold.

1. Documents with equal sets form a class, whose least id stands for it; copies are never compared again.
2. Tokens (shingle hashes) are ordered from rare to frequent. Frequent ones are told from a bounded sample and
   come last; the others are ordered by their exact number of classes, counted in hash buckets. In this order
   two linked sets have their first common token in the first ``n - ceil(t n) + 1`` tokens of both, so a class
   whose prefix holds only tokens of its own links with nothing and is dropped.
3. Rare tokens are indexed alone. A pair that has only frequent tokens in common shares, if it links, at least
   ``2/7 (n + m) - 1`` pairs of tokens that are neighbours in both orders (at 0.75; each token of one set alone
   parts at most one pair): for frequent tokens prefixes are extended to about half of these combinations.
4. Classes that share an index key fall into one family; families come from components over (member, least
   member) edges, so keys with many members never yield pairs. Each family is verified exactly, in blocks,
   from counts of common tokens; only edges that join parts leave a task. In a family of more than one block,
   all blocks meet the first one. What is not joined by then meets another block only where one of both is not
   in the family's largest part; in a family of many blocks, only if it shares an index key with a member there.

Sets are compared by 64-bit hashes of words and shingles, carried whole. A null or empty text has no shingles and links with
nothing. Rows that share an id count as one node; rows without an id get a null component. Repeated rows
come out once for each input row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import bucket_count, cut, drop, every_salt, fresh, raw, salt, small_batches
from glintscan.llm.components import components
from glintscan.llm.shingles import WordHashes, mixed, shingle_set

#: Documents of the sample, their longest text in bytes, and the sampled classes that make a token frequent.
SAMPLE_ROWS, SAMPLE_BYTES, FREQUENT = 8_192, 1 << 16, 8
#: Tokens that a task gathers before it deals them to buckets; members and tokens of a block of verification.
FLUSH, BLOCK_MEMBERS, BLOCK_TOKENS = 400_000, 1_024, 500_000
#: Text bytes that a bucket of tokens stands for; rows of an Arrow batch that a task gives back.
TOKEN_BUCKET, OUT_ROWS = 2 << 20, 50_000
#: Blocks of a family up to which its members are compared with all blocks, whether they share an index key or not.
FEW_BLOCKS = 16
SALTS = 16


def _sets(texts: list[bytes | None], k: int, hashes: WordHashes) -> Iterator[np.ndarray]:
    for t in texts:
        yield shingle_set((t or b"").lower().split(), hashes, k)


def _class(s: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63)


def _among(s: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each of ``s`` stands in the sorted ``known``, and whether it does."""
    if not len(known):
        return np.zeros(len(s), np.int64), np.zeros(len(s), bool)
    at = np.minimum(np.searchsorted(known, s), len(known) - 1)
    return at, known[at] == s


def _rows(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(b[c].to_pylist() for c in names), strict=True)


def frequent_tokens(docs: DataFrame, k: int) -> np.ndarray:
    """Tokens of at least ``FREQUENT`` classes in the sample: at most a fixed share of the sample's tokens."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        own = {_class(s): s for b in batches for s in _sets(raw(b["_t"]), k, hashes)}
        tokens, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *own.values()]), return_counts=True)
        yield pa.RecordBatch.from_pydict({"t": pa.array(tokens[n >= FREQUENT].view(np.int64))})

    sized = docs.filter(F.octet_length("_t").between(1, SAMPLE_BYTES))
    chosen = sized.select(F.xxhash64("_id", F.octet_length("_t")).alias("_h")).orderBy("_h").limit(SAMPLE_ROWS).distinct()
    sample = sized.withColumn("_h", F.xxhash64("_id", F.octet_length("_t"))).join(F.broadcast(chosen), "_h", "left_semi").limit(2 * SAMPLE_ROWS)
    found = sample.select("_t").coalesce(1).mapInArrow(counted, "t long").toArrow()["t"].to_numpy()
    return np.sort(found.view(np.uint64))


def described(docs: DataFrame, k: int, frequent: object) -> DataFrame:
    """(doc_id, n, cls, hot): size and class of each document's set; ``hot`` numbers its frequent tokens."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), frequent.value
        for b in batches:
            n, cls, hot = [], [], []
            for s in _sets(raw(b["_t"]), k, hashes):
                n.append(len(s))
                cls.append(_class(s) if len(s) else None)
                at, hit = _among(s, known)
                hot.append(at[hit].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([b["_id"], pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(hot, pa.binary())], ["doc_id", "n", "cls", "hot"])

    return docs.mapInArrow(of, "doc_id long, n long, cls long, hot binary")


def token_bytes(buckets: int) -> int:
    """Bytes that hold what is left of a 64-bit token once its bucket is known."""
    return -(-(((1 << 64) - 1) // buckets).bit_length() // 8)


def shared_tokens(docs: DataFrame, k: int, frequent: object) -> DataFrame:
    """(cls, rare): the tokens that at least two classes have, but for the frequent ones, from rare to frequent, as packed 64-bit hashes.

    Tasks deal packed tokens to buckets by hash: a row holds a bucket's classes, how many tokens each has, and
    the tokens divided by the number of buckets, which loses nothing. A bucket stands for a fixed amount of
    input; tasks sort their rows by bucket, or class, and hold one at a time.
    """
    buckets = bucket_count(docs, least=256, each=TOKEN_BUCKET)
    wide = token_bytes(buckets)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known, seen = WordHashes(), frequent.value, set()
        own: list[np.ndarray] = []
        classes: list[int] = []

        def flush() -> pa.RecordBatch:
            lens = np.fromiter(map(len, own), np.int64, len(own))
            tokens, owner = np.concatenate([np.zeros(0, np.uint64), *own]), np.repeat(np.array(classes, np.int64), lens)
            at = (tokens % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            tokens, owner, at = tokens[order] // np.uint64(buckets), owner[order], at[order]
            packed = np.ascontiguousarray(tokens.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :wide]
            starts = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0] if len(at) else np.zeros(0, np.int64)
            rows = {"bucket": [], "cls": [], "lens": [], "tokens": []}
            for i, j in zip(starts, [*starts[1:], len(at)], strict=False):
                o = owner[i:j]
                runs = np.nonzero(np.r_[True, o[1:] != o[:-1]])[0]
                rows["bucket"].append(int(at[i]))
                rows["cls"].append(o[runs].astype("<i8").tobytes())
                rows["lens"].append(np.diff(np.r_[runs, len(o)]).astype("<u4").tobytes())
                rows["tokens"].append(packed[i:j].tobytes())
            own.clear()
            classes.clear()
            return pa.RecordBatch.from_pydict(rows, pa.schema([("bucket", pa.int64()), ("cls", pa.binary()), ("lens", pa.binary()), ("tokens", pa.binary())]))

        held = 0
        for b in batches:
            for s in _sets(raw(b["_t"]), k, hashes):
                c = _class(s)
                if not len(s) or c in seen:
                    continue
                if len(seen) < 500_000:
                    seen.add(c)
                own.append(s[~_among(s, known)[1]])
                classes.append(c)
                held += len(own[-1])
                if held >= FLUSH:
                    yield flush()
                    held = 0
        yield flush()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in groupby(_rows(batches, "bucket", "cls", "lens", "tokens"), key=lambda r: r[0]):
            owners, packed = [], []
            for _, cls, lens, tokens in rows:
                owners.append(np.repeat(np.frombuffer(cls, "<i8"), np.frombuffer(lens, "<u4")))
                packed.append(tokens)
            eight = np.zeros((sum(map(len, owners)), 8), np.uint8)
            eight[:, :wide] = np.frombuffer(b"".join(packed), np.uint8).reshape(-1, wide)
            token, owner = eight.view("<u8").ravel(), np.concatenate(owners)
            del eight, owners, packed
            order = np.argsort(token)
            token, owner = token[order], owner[order]
            equal = np.r_[False, token[1:] == token[:-1], False]
            some = equal[1:] | equal[:-1]
            token, owner = token[some], owner[some]
            order = np.lexsort((owner, token))
            token, owner = token[order], owner[order]
            new = np.r_[True, (token[1:] != token[:-1]) | (owner[1:] != owner[:-1])][: len(token)]
            token, owner = token[new], owner[new]  # a class may have been dealt by several tasks
            _, back, df = np.unique(token, return_inverse=True, return_counts=True)
            df = df[back]
            many = df >= 2
            full = token[many] * np.uint64(buckets) + np.uint64(bucket)
            out = pa.RecordBatch.from_arrays([pa.array(owner[many]), pa.array(np.minimum(df[many], 1 << 30).astype(np.int32)), pa.array(full.view(np.int64))], ["cls", "df", "token"])
            yield from (out.slice(i, OUT_ROWS) for i in range(0, out.num_rows, OUT_ROWS))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cls, parts, held, done = [], [], 0, []
        for b in batches:
            c, t = b["cls"].to_numpy(), b["token"].to_numpy()
            starts = np.nonzero(np.r_[True, c[1:] != c[:-1]])[0] if len(c) else []
            for i, j in zip(starts, [*starts[1:], len(c)], strict=False):
                if not cls or cls[-1] != c[i]:
                    done += [b"".join(parts)] if cls else []
                    parts = []
                    if held >= FLUSH:
                        yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "rare": pa.array(done, pa.binary())})
                        cls, done, held = [], [], 0
                    cls.append(int(c[i]))
                parts.append(t[i:j].astype("<i8").tobytes())
                held += int(j - i)
        done += [b"".join(parts)] if cls else []
        yield pa.RecordBatch.from_pydict({"cls": pa.array(cls, pa.int64()), "rare": pa.array(done, pa.binary())})

    dealt = docs.select("_t").mapInArrow(deal, "bucket long, cls binary, lens binary, tokens binary")
    counted = dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(count, "cls long, df int, token long")
    return counted.repartition("cls").sortWithinPartitions("cls", "df", "token").mapInArrow(gather, "cls long, rare binary")


def index_keys(n: int, rare: np.ndarray, hot: np.ndarray, percent: int) -> np.ndarray:
    """Index keys of a set of ``n`` tokens: ``rare`` are its shared rare tokens in order, ``hot`` its frequent ones.

    Tokens that no other class has come first in the order and need no key.
    """
    least = -(-percent * n // 100)
    prefix = n - least + 1
    keys = rare[: max(0, prefix - (n - len(rare) - len(hot)))]
    if len(hot) < least:
        return keys
    pairs = np.sort(mixed(hot[:-1] * np.uint64(0x9E3779B97F4A7C15) + hot[1:] + np.uint64(1)))
    # overlap o >= t/(1+t) (n + m), m >= t n, and 3 o - n - m - 1 neighbours stay together
    t = percent / 100
    together = max(1, int(np.ceil((3 * t / (1 + t) - 1) * (1 + t) * n - 1 - 1e-9)))
    return np.concatenate([keys, pairs[: max(0, len(pairs) - together + 1)]])


def linked(sets: list[np.ndarray], n: np.ndarray, ids: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Edges that join the members of each linked part of a block, found from exact counts of common tokens."""
    m = len(sets)
    lens = np.fromiter(map(len, sets), np.int64, m)
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    member = np.repeat(np.arange(m), lens)
    order = np.argsort(token, kind="stable")
    members, first = member[order], np.r_[0, np.cumsum(np.bincount(token))]
    ends = np.r_[0, np.cumsum(lens)]
    part, edges = np.arange(m), []
    for x in range(1, m):
        own = token[ends[x] : ends[x + 1]]
        a, size = first[own], first[own + 1] - first[own]
        at = np.repeat(a - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        common = np.bincount(members[at], minlength=m)[:x]
        for y in np.nonzero(100 * common >= percent * (n[x] + n[:x] - common))[0]:
            if part[x] != part[y]:
                part[part == part[x]] = part[y]
                edges.append((int(ids[x]), int(ids[y])))
    return edges


def verify(members: DataFrame, task: list[str], percent: int) -> DataFrame:
    """(a, b) edges between members that meet in a task; ``members`` has id, n and packed tokens."""

    def of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("id")
        sets = [np.frombuffer(x, "<u8") for x in table["tokens"].to_pylist()]
        edges = linked(sets, table["n"].to_numpy(), table["id"].to_numpy(), percent)
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return members.groupBy(*task).applyInArrow(of, "a long, b long")


def across(large: DataFrame, keys: DataFrame, edges: DataFrame) -> DataFrame:
    """Members of families of several blocks, once for each pair of blocks (low, high) in which they have still to be compared.

    All blocks have met the first one. Two members of other blocks and of different parts (as linked by ``edges``)
    meet if one of them is outside the largest part of the family; two members of that part are joined already. In a
    family of more than ``FEW_BLOCKS`` blocks they must share an index key too. To look that up takes a row for each
    key of a member, which is more than a copy of the member for each of a few blocks.
    """
    part = components(edges).withColumnRenamed("node", "id")
    parts = large.select("id", "family", "block", "blocks").join(part, "id", "left").select("id", "family", "block", "blocks", F.coalesce("component", "id").alias("part"))
    main = parts.groupBy("family", "part").count().groupBy("family").agg(F.max_by("part", F.struct("count", "part")).alias("main")).withColumn("s", every_salt(SALTS))
    told = parts.withColumn("s", salt(F.col("id"), SALTS)).join(main, ["family", "s"]).select("id", "family", "block", "blocks", "part", (F.col("part") != F.col("main")).alias("rest")).filter("block > 0")
    told = cut(told, "parts")

    def visits(at: DataFrame, *by: str) -> DataFrame:
        there = at.groupBy(*by, F.col("block").alias("other")).agg(F.max("rest").alias("any"), F.min("part").alias("first"), F.max("part").alias("last")).withColumn("s", every_salt(SALTS))
        near = at.withColumn("s", salt(F.col("id"), SALTS)).join(there, [*by, "s"])
        return near.filter("block <> other and (rest or any) and not (first = last and first = part)").select("id", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"))

    few, many = told.filter(F.col("blocks") <= FEW_BLOCKS), told.filter(F.col("blocks") > FEW_BLOCKS)
    found = visits(few, "family")
    if not many.isEmpty():
        held = keys.join(many.filter("rest").select("id"), "id", "left_semi").select("key").distinct()
        found = found.union(visits(keys.join(held, "key", "left_semi").join(many, "id"), "family", "key"))
    return large.select("family", "id", "n", "tokens").join(found.distinct(), "id")


def link(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", k: int = 5, percent: int = 75) -> DataFrame:
    """Per row ``doc_id``, ``n_shingles`` and ``component_id``; sets link at a Jaccard similarity of ``percent`` %.

    The bound on combinations of frequent tokens needs a threshold over 50 %.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must lie above 50")
    spark = docs.sparkSession
    small_batches(spark)
    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"))
    frequent = spark.sparkContext.broadcast(frequent_tokens(given, k))
    base = cut(described(given, k, frequent), "sets")
    classes = base.filter("cls is not null and doc_id is not null").groupBy("cls").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("hot").alias("hot"))

    shared = shared_tokens(given.filter("_id is not null"), k, frequent)
    fit = F.coalesce(F.octet_length("rare") / 8, F.lit(0)) + F.octet_length("hot") / 4
    left = classes.join(shared, "cls", "left").filter(100 * fit >= percent * F.col("n"))
    left = cut(left.select("id", "n", F.coalesce("rare", F.lit(b"")).alias("rare"), "hot"), "candidates")

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for id_, n, rare, hot in _rows([b], "id", "n", "rare", "hot"):
                keys = index_keys(n, np.frombuffer(rare, "<u8"), np.frombuffer(hot, "<u4").astype(np.uint64), percent)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), id_))], ["key", "id"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [r + (np.frombuffer(h, "<u4").astype("<u8") | np.uint64(1 << 63)).tobytes() for r, h in _rows([b], "rare", "hot")]
            yield pa.RecordBatch.from_arrays([b["id"], b["n"], pa.array(rows, pa.binary())], ["id", "n", "tokens"])

    keys = cut(left.mapInArrow(keyed, "key long, id long"), "keys")
    least = keys.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most").withColumn("s", every_salt(SALTS))
    stars = keys.withColumn("s", salt(F.col("id"), SALTS)).join(least, ["key", "s"]).select("id", "least").distinct()
    family = components(stars, "id", "least").select(F.col("node").alias("id"), F.col("component").alias("family"))

    members = left.mapInArrow(packed, "id long, n long, tokens binary").join(family, "id")
    members = cut(members, "members")
    drop(left)
    sized = members.groupBy("family").agg(F.ceil(F.greatest(F.count("*") / BLOCK_MEMBERS, F.sum(F.octet_length("tokens") / 8) / BLOCK_TOKENS)).alias("blocks"))
    sized = sized.withColumn("s", every_salt(SALTS))
    placed = members.withColumn("s", salt(F.col("id"), SALTS)).join(sized, ["family", "s"]).drop("s").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    meets = F.when(F.col("block") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    edges = cut(verify(placed.withColumn("task", F.explode(meets)), ["family", "task"], percent), "links")
    large = placed.filter("blocks > 2")
    if not large.isEmpty():
        edges = edges.union(cut(verify(across(large, keys, edges), ["family", "low", "high"], percent), "links"))
    drop(members, keys)
    found = components(edges).withColumnRenamed("node", "id")

    named_classes = classes.select("cls", "id", "copies").join(found, "id", "left").filter("copies > 1 or component is not null")
    label = named_classes.select("cls", F.coalesce("component", "id").alias("component"), every_salt(SALTS).alias("s"))
    salted = base.select("doc_id", F.col("n").alias("n_shingles"), "cls", salt(F.col("doc_id"), SALTS).alias("s"))
    joined = salted.join(label, ["cls", "s"], "left")
    return joined.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept: that with the least id."""
    own = fresh(docs, "gone")
    gone = link(docs, doc_id, text).filter("doc_id <> component_id").select(F.col("doc_id").alias(own)).distinct()
    return docs.join(gone, F.col(doc_id) == F.col(own), "left_anti")

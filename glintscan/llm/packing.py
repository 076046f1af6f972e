"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Documents become pieces, which are dealt at random over nodes of about ``NODE`` pieces. A node packs its pieces by
best-fit decreasing. Bins with at most ``NEARLY`` tokens of room are finished; the others go on as single items.
``FAN`` nodes at a time are merged, their items packed by best fit again, until one node is left: as many rounds as
the tree is high.

What a node hands on is bounded without any effect on the outcome. Best fit leaves it at most one bin that is not over
half full, for the second would have been put into the first. Two bins over half full never fit together, so each join
needs one of the others: at most ``FAN`` of them meet in a node, and bins of equal fill are alike. So of the bins with
a given fill over a half no more than ``FAN`` for each round ahead can ever be used. The rest are finished at once.

A null text counts as empty: its only token is the end mark. Repeated rows are packed as often as they stand there. An
empty table gives an empty result, and only the named columns are looked at. A text is encoded in sections, so that a
very long one takes memory for its ids, not for a list of its words.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache
from struct import pack as packed_ints

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, raw, small_batches
from glintscan.llm.word_bpe import byte_letters

#: Tokens of a sequence, and the id that ends a document.
SEQUENCE, END = 2048, 0
#: Pieces of a node, nodes that are merged into one, and tokens of room with which a bin is finished.
NODE, FAN, NEARLY = 8192, 8, 16
#: Chunks of text that a worker remembers, and characters of a section.
REMEMBERED, SECTION = 1_000_000, 1 << 20

_WHITE = "\t-\r\x20\x85\xa0  -     　"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"
#: Pieces of text between which the pre-tokeniser always cuts: a word, a run of marks, or all up to white space.
_CHUNKS = re.compile(
    rf" ?[{_LETTERS}]++(?=[!-@\[-`{{-~{_WHITE}]|\Z)| ?[{_MARKS}]++(?=[{_LETTERS}0-9{_WHITE}]|\Z)"
    rf"| ?[^{_WHITE}]+|[{_WHITE}]+(?![^{_WHITE}])|[{_WHITE}]"
)
#: A place where a text may be cut into sections: before a space between two words.
_SAFE = re.compile(rf"(?<=[A-Za-z]) (?=[{_LETTERS}])")
#: White space other than spaces and line feeds.
_ODD = re.compile("[\t\x0b-\r" + _WHITE[_WHITE.index("\x85") :] + "]").search


class Encoder(dict):
    """Ids of chunks of text, four little-endian bytes each, as the tokenizers library gives them.

    Chunks are remembered. For byte-level vocabularies whose ids follow the order of their merges, those that are not are
    merged by rank; for all other files, and for texts that hold special tokens, the library encodes whole texts.
    """

    def __init__(self, path: str):
        super().__init__()
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.ranks = self._by_rank(spec)

    @staticmethod
    def _by_rank(spec: dict) -> object | None:
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
        if not (plain and bytewise and spec.get("normalizer") is None):
            return None
        vocab = model["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        if any(a >= b for a, b in zip(made, made[1:], strict=False)):
            return None
        import tiktoken

        byte = {c: b for b, c in enumerate(byte_letters())}
        added = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(map(byte.__getitem__, t)): i for t, i in vocab.items() if t not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, chunk: str) -> bytes:
        if len(self) > REMEMBERED:
            self.clear()
        if chunk.isascii() or _KNOWN(chunk):
            ids = self.ranks.encode_ordinary(chunk)
        else:  # letters that only the library's own tables are sure to class as it does
            ids = self.whole.encode(chunk, add_special_tokens=False).ids
        out = self[chunk] = packed_ints(f"<{len(ids)}I", *ids)
        return out

    def encode(self, text: str) -> bytes:
        if self.ranks is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        out, at = [], 0
        while at < len(text):
            m = _SAFE.search(text, at + SECTION) if len(text) > SECTION else None
            end = m.start() if m else len(text)
            out += map(self.__getitem__, self.chunks(text[at:end] if at or m else text))
            at = end
        return b"".join(out)

    @staticmethod
    def chunks(text: str) -> list[str]:
        """Chunks of a text; where all white space is single spaces and line feeds, without a pattern."""
        if _ODD(text) or text[0] in " \n" or text[-1] in " \n" or any(x in text for x in ("  ", "\n\n", " \n", "\n ")):
            return _CHUNKS.findall(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if "\0" not in text else _CHUNKS.findall(text)


_KNOWN = re.compile(rf"[\x00-\x7f {_LETTERS}]*\Z").match


@lru_cache(maxsize=1)
def _encoder(path: str) -> Encoder:
    own = SparkFiles.get(os.path.basename(path))
    return Encoder(own if os.path.exists(own) else path)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def pieces(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """Pieces of documents: place, length and checksum of their ids, the ids themselves if asked for, and a random ``deal``.

    A document of up to ``size`` tokens, its end mark included, is one piece. The pieces of a longer one have ``size``
    tokens each, but for the first, which takes what is over.
    """
    small_batches(docs.sparkSession)
    docs.sparkSession.sparkContext.addFile(vocabulary)
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * ids]
    names = [*(f.split()[0] for f in PIECES.split(", ")), *["ids"] * ids]
    end = packed_ints("<I", END)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, n = _encoder(vocabulary), 0
        # a number of the row, mixed: repeated ids are dealt apart, and a repeated task deals alike
        seed = TaskContext.get().partitionId() << 40
        for b in batches:
            rows = []
            for doc, t in zip(b["_id"].to_pylist(), raw(b["_t"]), strict=True):
                own = encoder.encode((t or b"").decode("utf-8", "replace")) + end
                total = len(own) // 4
                first = total % size or size
                for piece, stop in enumerate(range(first, total + 1, size)):
                    start = stop - size if piece else 0
                    part = own[4 * start : 4 * stop]
                    n += 1
                    deal = ((seed + n) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 2
                    rows.append((doc, piece, start, stop - start, zlib.crc32(part), deal ^ deal >> 31, *[part] * ids))
            columns = zip(*rows, strict=True) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    given = docs.select(F.col(doc_id).cast("long").alias("_id"), F.col(text).cast("string").alias("_t"))
    return given.mapInArrow(of, PIECES + ", ids binary" * ids)


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: the bin and the place in it of each length, and the fill of each bin."""
    bins, places = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: list[int] = []
    room: dict[int, list[int]] = {}
    there = 0  # bit r: some bin has room for exactly r
    order = np.argsort(-lengths, kind="stable")
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        if n > size:
            raise ValueError(f"an item of {n} does not fit {size}")
        if fits := there >> n:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                there ^= 1 << r
        else:
            r, b = size, len(fill)
            fill.append(0)
        bins[i], places[i] = b, fill[b]
        fill[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
            there |= 1 << r - n
    return bins, places, np.array(fill, np.int64)


def handed_on(fill: np.ndarray, size: int, rounds: int) -> np.ndarray:
    """Which bins go on as items: those with room left that a later round could use (see above)."""
    on = np.zeros(len(fill), bool)
    if rounds:
        open_ = np.nonzero(size - fill > NEARLY)[0]
        open_ = open_[np.argsort(fill[open_], kind="stable")]
        value = fill[open_]
        rank = np.arange(len(value)) - np.searchsorted(value, value)
        on[open_[(2 * value <= size) | (rank < FAN * rounds)]] = True
    return on


def _nodes(count: int) -> list[int]:
    """Nodes of each round, from the pieces' own to the last."""
    n = [max(1, round(count / NODE))]
    while n[-1] > 1:
        n.append(-(-n[-1] // FAN))
    return n


def pack(items: DataFrame, size: int = SEQUENCE, length: str = "length", deal: str = "deal") -> DataFrame:
    """``items`` with ``sequence_id`` and ``offset`` in place of ``deal``; read twice, so give it written down."""
    nodes = _nodes(items.count())
    fields = [f for f in items.schema.fields if f.name != deal]
    names = [f.name for f in fields]

    def local(table: pa.Table) -> pa.Table:
        bins, places, fill = best_fit(table[length].to_numpy(), size)
        on = handed_on(fill, size, len(nodes) - 1)
        ids = (table["_node"][0].as_py() << 24) + bins
        out = table.select(names).append_column("_bin", pa.array(ids)).append_column("_at", pa.array(places))
        return out.append_column("_fill", pa.array(fill[bins])).append_column("_on", pa.array(on[bins]))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", _bin long, _at long, _fill long, _on boolean"
    dealt = items.withColumn("_node", F.pmod(F.col(deal), F.lit(nodes[0])))
    found = cut(dealt.groupBy("_node").applyInArrow(local, schema), "packed")
    own = [F.col(f"`{n}`") for n in names]
    done = found.select(*own, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    if len(nodes) == 1:
        return done
    units = found.filter("_on and _at = 0").select(F.col("_bin").alias("unit"), F.col("_fill").alias("fill"), F.shiftright("_bin", 24).alias("node"))
    rounds = []
    for k in range(1, len(nodes)):
        rounds.append(cut(_merged(units, size, len(nodes) - 1 - k), "merged"))
        units = rounds[-1].filter("goes_on and unit = into").select("unit", F.col("filled").alias("fill"), "node")
    # from the last round down: where a unit of this round came to lie in the end
    at = rounds.pop().select("unit", "into", "shift")
    for r in reversed(rounds):
        above = at.select(F.col("unit").alias("into"), F.col("into").alias("last"), F.col("shift").alias("more"))
        at = r.join(above, "into", "left").select("unit", F.coalesce("last", "into").alias("into"), (F.col("shift") + F.coalesce("more", F.lit(0))).alias("shift"))
    moved = found.filter("_on").join(at, F.col("_bin") == F.col("unit"))
    moved = moved.select(*own, F.col("into").alias("sequence_id"), (F.col("_at") + F.col("shift")).alias("offset"))
    stayed = found.filter("not _on").select(*own, F.col("_bin").alias("sequence_id"), F.col("_at").alias("offset"))
    return stayed.union(moved)


def _merged(units: DataFrame, size: int, rounds: int) -> DataFrame:
    """One round: ``FAN`` nodes become one; every unit with the unit that it is put into, and how far in."""

    def merge(table: pa.Table) -> pa.Table:
        unit = table["unit"].to_numpy()
        bins, places, fill = best_fit(table["fill"].to_numpy(), size)
        first = np.zeros(len(fill), np.int64)
        first[bins[places == 0]] = unit[places == 0]
        on = handed_on(fill, size, rounds)
        return pa.table({"unit": unit, "into": first[bins], "shift": places, "filled": fill[bins], "goes_on": on[bins], "node": table["node"].to_numpy()})

    up = units.withColumn("node", F.floor(F.col("node") / FAN).cast("long"))
    return up.groupBy("node").applyInArrow(merge, "unit long, into long, shift long, filled long, goes_on boolean, node long")


def packed(docs: DataFrame, vocabulary: str, doc_id: str = "doc_id", text: str = "text", size: int = SEQUENCE, ids: bool = False) -> DataFrame:
    """Per piece its document, place, length and checksum, the sequence that it is in, and its place there."""
    return pack(cut(pieces(docs, vocabulary, doc_id, text, size, ids), "pieces"), size)


def sequences(packed_pieces: DataFrame) -> DataFrame:
    """The sequences themselves, from pieces packed with their ids: ``ids`` of four little-endian bytes each, and the pieces' ends.

    A sequence has at most as many pieces as tokens, so a group is small.
    """
    part = F.struct("offset", "ids", "doc_id", "piece")
    rows = packed_pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p"))
    ends = F.transform("p", lambda x: x["offset"] + F.octet_length(x["ids"]) / 4).cast("array<long>")
    whole = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return rows.select("sequence_id", whole.alias("ids"), ends.alias("ends"), F.transform("p", lambda x: x["doc_id"]).alias("doc_ids"))

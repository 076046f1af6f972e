"""BPE encoding and decoding with a minimal acyclic transducer of frequent words.

The vocabulary file is a word-level BPE: text is normalised (NFC, white space, lower case), cut into words, and
each word's bytes are merged by rank. Words are counted over the whole corpus; the most frequent are compiled
into a minimal acyclic automaton whose words with equal endings share states. Numbers on its arcs add up to a
word's ordinal, which points to its ids. The automaton is written once, handed to the executors as a file and
memory-mapped there by their workers. Words outside it are merged exactly, so results never depend on it.

Texts are taken in pieces of bounded bytes and cut at ASCII white space. No word, composed letter or small letter depends on
what stands beyond it, so each distinct run in between is looked up once for the piece. Runs are remembered with their ids,
within a bound in bytes; those that are new are normalised and cut into words, which go through the automaton, or are merged,
side by side.

Letters, numbers, lower case and NFC are those of the tokenizers library, whose Unicode version is not Python's: where
the two classify a code point differently (``Unicode``), a text that holds one is normalised by the library's normalisers
and cut by classes that the library was asked for. A vocabulary file with another normaliser, another split or other
model options is refused.

A null text counts as empty and has no ids. Rows are encoded one by one; repeated rows have equal ids. Very long texts
are encoded whole. An empty table gives no rows; further columns of any name are not read.
"""

from __future__ import annotations

import heapq
import json
import mmap
import os
import re
import tempfile
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator
from bisect import bisect_left
from functools import cached_property, lru_cache
from itertools import chain
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Regex, normalizers, pre_tokenizers

from glintscan.llm.common import cut, raw, small_batches

#: Words compiled into the automaton, and the longest of them in bytes.
LEXICON, LONGEST = 100_000, 64
_NEVER = (1 << 60, -1)
#: No id, and no part of two: ids have less than 24 bits.
_BETWEEN = b"\xff" * 4
#: Bytes of runs that a task counts before it hands the counts on, and that a worker remembers with their ids, twice over at most.
HELD, REMEMBERED = 32 << 20, 24 << 20
#: What a run in a dictionary takes beside its letters and ids: the heads of two objects, and its place.
PLACE = 130
#: Bytes of text that are cut and encoded at a time; a longer text is a piece of its own.
PIECE = 2 << 20
#: Words that go through the automaton, or are merged, side by side: what they take fits a processor's cache.
ABREAST = 2048
_WHITE = "\t-\r\x20\x85\xa0  -     　"


# The one normaliser and the one split that are encoded here, as vocabulary files write them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}


def supported(spec: dict) -> None:
    """Raises where a vocabulary file asks for anything that is not done here."""
    model, cuts = spec["model"], spec.get("pre_tokenizer") or {}
    steps = cuts.get("pretokenizers", [])
    refused = []
    if model.get("type", "BPE") != "BPE":
        refused.append("model type")
    refused += [k for k in ("unk_token", "dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges") if model.get(k)]
    if spec.get("normalizer") != NORMALIZER:
        refused.append("normalizer")
    if cuts.get("type") != "Sequence" or steps[:1] != [SPLIT] or [s["type"] for s in steps[1:]] != ["ByteLevel"] or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
        refused.append("pre_tokenizer")
    refused += ["added_tokens." + k for k in ("single_word", "lstrip", "rstrip", "normalized") if any(t.get(k) for t in spec.get("added_tokens", []))]
    if refused:
        raise ValueError(f"vocabulary file not supported: {', '.join(refused)}")


def _class(points: Iterable[str]) -> str:
    """The inside of a regular expression's class of these code points, as ranges."""
    runs: list[list[int]] = []
    for c in sorted(map(ord, points)):
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in runs)


@lru_cache(maxsize=1)
def unicode_classes() -> dict[str, str]:
    """The library's ``letters`` and ``numbers``, and code points ``unsettled`` between it and Python, each as a class.

    The library is asked about every code point that any version of Unicode has assigned: planes 0 to 3 and 14.
    """
    points = [chr(c) for c in (*range(0xD800), *range(0xE000, 0x40000), *range(0xE0000, 0xE1000)) if c != 10]
    text = "".join(points)

    def members(kind: str) -> set[str]:
        others = pre_tokenizers.Split(Regex(rf"\p{{{kind}}}+"), "removed").pre_tokenize_str(text)
        return set(points) - set("".join(part for part, _ in others))

    def differ(asked: list[tuple[str, str]], there, here) -> set[str]:
        """Code points whose probe the library answers otherwise than Python."""
        answers = there("\n".join(probe for _, probe in asked)).split("\n")
        return {c for (c, probe), answer in zip(asked, answers, strict=True) if answer != here(probe)}

    def nfc(probe: str) -> str:
        return unicodedata.normalize("NFC", probe)

    letters, numbers = members("L"), members("N")
    unsettled = (letters ^ set(regex.findall(r"\p{L}", text))) | (numbers ^ set(regex.findall(r"\p{N}", text)))
    unsettled |= {c for c in points if unicodedata.category(c) == "Cn"}
    unsettled |= differ([(c, c) for c in points], normalizers.Lowercase().normalize_str, lambda c: c.replace("Σ", "σ").lower())
    whole = normalizers.NFC().normalize_str
    unsettled |= differ([(c, c) for c in points], whole, nfc)
    unsettled |= differ([(c, unicodedata.normalize("NFD", c)) for c in points if unicodedata.decomposition(c)], whole, nfc)
    marks = [c for c in points if unicodedata.combining(c)]
    unsettled |= differ([(c, "\u0345" + c) for c in marks], whole, nfc) | differ([(c, c + "\u0334") for c in marks], whole, nfc)
    return {"letters": _class(letters), "numbers": _class(numbers), "unsettled": _class(unsettled)}


def joined(values: pa.Array, counts: np.ndarray) -> tuple[list[int], memoryview]:
    """Where the next ``counts`` of ``values`` (large_binary, made just now) begin and end in all of them one after another."""
    _, offsets, held = values.buffers()
    ends = np.concatenate([[0], np.cumsum(counts)])
    at = np.frombuffer(offsets, "<i8")[ends].tolist() if len(values) else [0] * len(ends)
    return at, memoryview(held or b"")


def pieces(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of at most ``PIECE`` bytes, or of one text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
        yield texts.slice(at, to - at)
        at = to


def runs_of(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """All runs between ASCII white space, one text's after another's, and how many each text has."""
    runs = pc.ascii_split_whitespace(texts)
    coded = runs.flatten().cast(pa.large_binary() if pa.types.is_large_string(texts.type) else pa.binary()).dictionary_encode()
    return coded, np.asarray(runs.value_lengths(), np.int64)


class Unicode:
    """The library's view of texts that hold a code point on which it and Python disagree."""

    def __init__(self, letters: str, numbers: str, unsettled: str):
        # a class with many ranges beyond the 16-bit code points is slow: those are told apart among distinct letters
        low = re.sub(r"\\U000[1-9a-f]\w{4}-\\U\w{8}|\\U0010\w{4}-\\U\w{8}", "", unsettled)
        self._maybe = re.compile(f"[{low}\U00010000-\U0010ffff]").search
        self._surely = re.compile(f"[{unsettled}]").search
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_WHITE}{letters}{numbers}]+").findall
        self.normal = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str

    def unsettled(self, text: str) -> bool:
        return not text.isascii() and self._maybe(text) is not None and self._surely("".join(set(text))) is not None


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b if b in plain else next(rest)) for b in range(256)]


class Bpe:
    """The vocabulary with exact merging of one word; words are UTF-8 bytes, already normalised."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        supported(spec)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.pairs[self.vocab[a], self.vocab[b]] = rank, self.vocab[a + b]
        names = {**{i: t for t, i in self.vocab.items()}, **{i: t for t, i in self.special.items()}}
        self.names = pa.array([names.get(i, "").encode() + b" " for i in range(max(names) + 1)], pa.large_binary())
        if len(self.names) >> 24:
            raise ValueError("vocabulary file not supported: ids of over 24 bits")
        letters = byte_letters()
        self.inner = [self.vocab.get(c) for c in letters]
        self.final = [self.vocab.get(c + self.suffix) for c in letters]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.words = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+").findall
        # the same for texts of many runs, with the spaces between them
        self.words_between = regex.compile(rf" |'s|'t|'re|'ve|'m|'ll|'d|\p{{L}}+|\p{{N}}|[^{_WHITE}\p{{L}}\p{{N}}]+").findall
        self.ascii_between = re.compile(rb" |[a-z]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9]+").findall

    def merge(self, word: bytes) -> bytes:
        """Ids of a word, little-endian in four bytes each: the leftmost pair of least rank is merged first."""
        ids = [self.inner[b] for b in word[:-1]]
        ids.append(self.final[word[-1]])
        if None in ids:
            ids = [i for i in ids if i is not None]
        if len(ids) > 48:
            return self._merge_long(ids)
        pairs = self.pairs
        ranks = [pairs.get(p, _NEVER) for p in zip(ids, ids[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best is _NEVER:
                break
            i = ranks.index(best)
            ids[i : i + 2] = [best[1]]
            del ranks[i]
            if i:
                ranks[i - 1] = pairs.get((ids[i - 1], ids[i]), _NEVER)
            if i < len(ranks):
                ranks[i] = pairs.get((ids[i], ids[i + 1]), _NEVER)
        return pack(f"<{len(ids)}I", *ids)

    def _merge_long(self, ids: list[int]) -> bytes:
        """The same for a long word, with a heap of pairs and linked neighbours."""
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.pairs[p][0], i, *p, self.pairs[p][1]) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.pairs]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = new, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (p := (ids[k], ids[after[k]])) in self.pairs:
                    rank, made = self.pairs[p]
                    heapq.heappush(heap, (rank, k, *p, made))
        return np.array([i for i in ids if i >= 0], "<u4").tobytes()

    @cached_property
    def _ranked(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs as ascending numbers, and for each its rank and new id as one number; a pair above all others closes both."""
        n = len(self.names) + 1
        found = sorted((a * n + b, rank * n + new) for (a, b), (rank, new) in self.pairs.items())
        return np.array([k for k, _ in found] + [n * n], np.int64), np.array([v for _, v in found] + [_NEVER[0]], np.int64)

    def merge_all(self, words: list[bytes]) -> list[bytes]:
        """The same for many words at once, those of about equal length side by side."""
        if None in self.inner or None in self.final:
            return list(map(self.merge, words))
        out: list[bytes] = [b""] * len(words)
        groups: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            groups.setdefault((len(w) + 3) // 4, []).append(i)
        for quarter, places in groups.items():
            for k in range(0, len(places), ABREAST):
                few = [words[i] for i in places[k : k + ABREAST]]
                found = map(self.merge, few) if quarter > 8 or len(few) < 16 else self._merge_rows(few, 4 * quarter)
                for i, ids in zip(places[k : k + ABREAST], found, strict=True):
                    out[i] = ids
        return out

    def _merge_rows(self, words: list[bytes], width: int) -> Iterator[bytes]:
        """Merges a row for each word, its ids from the left, one pair in every row at a time; ``n - 1`` is no id."""
        n, (keys, ranks) = len(self.names) + 1, self._ranked
        letters = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), "u1").reshape(-1, width)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ids = np.full((len(words), width + 1), n - 1, np.int64)
        column = np.arange(width)
        ids[:, :-1] = np.where(column < size[:, None] - 1, np.array(self.inner, np.int64)[letters], n - 1)
        every = np.arange(len(words))
        ids[every, size - 1] = np.array(self.final, np.int64)[letters[every, size - 1]]

        def ranked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            pair = a * n + b
            at = np.searchsorted(keys, pair)
            return np.where(keys[at] == pair, ranks[at], _NEVER[0])

        done, open_ = np.empty((len(words), width), "<u4"), every
        rank = ranked(ids[:, :-1], ids[:, 1:])
        while len(open_):
            first = rank.argmin(1)
            best = rank[every[: len(first)], first]
            more = best < _NEVER[0]
            done[open_[~more]] = ids[~more, :-1]
            open_, ids, rank, first, best = open_[more], ids[more], rank[more], first[more], best[more]
            row, new = every[: len(first)], best % n
            # what stands behind the pair's left moves up by one place
            moved = column + (column > first[:, None])
            ids[:, :-1] = np.take_along_axis(ids, moved, 1)
            rank[:, :-1] = np.take_along_axis(rank, moved[:, :-1], 1)
            ids[row, first], rank[:, -1] = new, _NEVER[0]
            rank[row, first] = ranked(new, ids[row, first + 1])
            inside = first > 0
            row, first = row[inside], first[inside]
            rank[row, first - 1] = ranked(ids[row, first - 1], new[inside])
        kept, held = (done != n - 1).sum(1).tolist(), done.tobytes()
        for i, k in enumerate(kept):
            yield held[4 * width * i : 4 * (width * i + k)]

    @staticmethod
    def normal(text: str) -> str:
        """NFC and lower case, letter by letter (a final sigma is no exception)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def parts(self, text: str) -> Iterator[tuple[str, int | None]]:
        """A text's runs of ordinary text, and special tokens with their ids."""
        at = 0
        for m in self.cut.finditer(text) if self.cut else ():
            yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        yield text[at:], None

    def decode(self, rows: list[bytes]) -> list[bytes]:
        """The texts of rows of ids: names with a space between them, all rows' names taken at once."""
        at, text = joined(self.names.take(pa.array(np.frombuffer(b"".join(rows), "<u4"))), np.array([len(x) // 4 for x in rows], np.int64))
        return [bytes(text[a : max(a, b - 1)]) for a, b in zip(at, at[1:], strict=False)]


class Lexicon:
    """A minimal acyclic automaton in flat arrays; state ``s`` has the arcs ``first[s]`` up to ``first[s + 1]``."""

    ARRAYS = ("first", "final", "label", "target", "number", "offset", "ids")

    def __init__(self, path: str):
        with open(path, "rb") as f:
            head = json.loads(f.readline())
            base = f.tell()
            held = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
        for name in self.ARRAYS:
            kind, at, n = head[name]
            size = n * int(kind[-1])
            setattr(self, name, held[base + at : base + at + size].cast("B" if size == n else "I"))
        self.root, self.classes = head["root"], head["classes"]

    def get(self, word: bytes) -> bytes | None:
        state, ordinal, first, label = self.root, 0, self.first, self.label
        for byte in word:
            end = first[state + 1]
            arc = bisect_left(label, byte, first[state], end)
            if arc == end or label[arc] != byte:
                return None
            ordinal += self.number[arc]
            state = self.target[arc]
        if not self.final[state]:
            return None
        return self.ids[self.offset[ordinal] : self.offset[ordinal + 1]].tobytes()

    @cached_property
    def _arcs(self) -> tuple[np.ndarray, ...]:
        """State and label of each arc as one number, ascending, with a last one above all; its target and number; final states."""
        first = np.asarray(self.first, np.int64)
        keys = np.repeat(np.arange(len(first) - 1), np.diff(first)) * 256 + np.asarray(self.label)
        return np.append(keys, len(first) * 256), np.asarray(self.target, np.int64), np.asarray(self.number, np.int64), np.asarray(self.final, bool)

    def get_all(self, words: list[bytes]) -> list[bytes | None]:
        """The same for many words: each step takes the next byte of all that are still under way."""
        keys, target, number, final = self._arcs
        out: list[bytes | None] = []
        for k in range(0, len(words), ABREAST):
            few = words[k : k + ABREAST]
            letters, size = np.frombuffer(b"".join(few), "u1"), np.fromiter(map(len, few), np.int64, len(few))
            start, found = np.cumsum(size) - size, np.full(len(few), -1)
            at, state, ordinal, step = np.arange(len(few)), np.full(len(few), self.root), np.zeros(len(few), np.int64), 0
            while len(at):
                over = size[at] == step
                there = over & final[state]
                found[at[there]] = ordinal[there]
                at, state, ordinal = at[~over], state[~over], ordinal[~over]
                key = state * 256 + letters[start[at] + step]
                arc = np.searchsorted(keys, key)
                on = keys[arc] == key
                arc = arc[on]
                at, state, ordinal, step = at[on], target[arc], ordinal[on] + number[arc], step + 1
            out += [self.ids[self.offset[n] : self.offset[n + 1]].tobytes() if n >= 0 else None for n in found.tolist()]
        return out

    @staticmethod
    def build(words: Iterable[bytes], outputs: Iterable[bytes], path: str) -> None:
        """Writes the automaton of distinct ``words`` in ascending order, each with its ids.

        States are registered from the end of the words on, as soon as no later word can change them: two
        states with the same arcs and finality become one.
        """
        register: dict[tuple, int] = {}
        rows: list[tuple[bool, list[tuple[int, int, int]], int]] = []  # final, (label, target, number), words below
        open_: list[tuple[bool, list[tuple[int, int]]]] = [(False, [])]
        path_: bytes = b""

        def close(depth: int) -> None:
            while len(open_) > depth + 1:
                final, arcs = open_.pop()
                key = (final, tuple(arcs))
                state = register.get(key)
                if state is None:
                    state = register[key] = len(rows)
                    numbered, below = [], int(final)
                    for label, target in arcs:
                        numbered.append((label, target, below))
                        below += rows[target][2]
                    rows.append((final, numbered, below))
                open_[-1][1].append((path_[len(open_) - 1], state))

        ids: list[bytes] = []
        for word, out in zip(words, outputs, strict=True):
            common = next((i for i, (a, b) in enumerate(zip(path_, word, strict=False)) if a != b), min(len(path_), len(word)))
            close(common)
            for _ in word[common:]:
                open_.append((False, []))
            open_[-1] = (True, open_[-1][1])
            path_ = word
            ids.append(out)
        close(0)
        final, arcs = open_.pop()
        numbered, below = [], int(final)
        for label, target in arcs:
            numbered.append((label, target, below))
            below += rows[target][2]
        rows.append((final, numbered, below))
        arcs_ = [a for _, r, _ in rows for a in r]
        arrays = {
            "first": np.cumsum([0, *(len(r) for _, r, _ in rows)]).astype("<u4"), "final": np.array([f for f, _, _ in rows], "u1"),
            "label": np.array([a[0] for a in arcs_], "u1"), "target": np.array([a[1] for a in arcs_], "<u4"), "number": np.array([a[2] for a in arcs_], "<u4"),
            "offset": np.cumsum([0, *(len(x) // 4 for x in ids)]).astype("<u4"), "ids": np.frombuffer(b"".join(ids), "<u4"),
        }
        head, at = {"root": len(rows) - 1, "classes": unicode_classes()}, 0
        for name, array in arrays.items():
            head[name] = (array.dtype.str, at, len(array))
            at += -(-array.nbytes // 8) * 8
        with open(path, "wb") as f:
            line = json.dumps(head).encode()
            f.write(line + b" " * (-(len(line) + 1) % 8) + b"\n")
            for array in arrays.values():
                f.write(array.tobytes() + b"\0" * (-array.nbytes % 8))


@lru_cache(maxsize=2)
def _bpe(path: str) -> Bpe:
    return Bpe(path)


def _shipped(path: str) -> str:
    """Where a task finds the vocabulary file that the driver has handed out."""
    own = SparkFiles.get(os.path.basename(path))
    return own if os.path.exists(own) else path


@lru_cache(maxsize=1)
def _words(bpe_path: str, lexicon: str) -> Words:
    """One memory of words for all tasks of a worker."""
    return Words(_bpe(bpe_path), Lexicon(SparkFiles.get(lexicon)))


class Words(dict):
    """Ids of each run without ASCII white space, as bytes: remembered, else of its words, from the automaton or merged.

    What is remembered is set aside after a piece when it is too much, and taken back where it occurs again.
    """

    def __init__(self, bpe: Bpe, lexicon: Lexicon | None):
        super().__init__()
        self.bpe, self.lexicon = bpe, lexicon
        self.unicode = Unicode(**(lexicon.classes if lexicon else unicode_classes()))
        self.aside: dict[bytes, bytes] = {}
        self.held = 0

    def rows(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text; a null has none."""
        texts = pc.fill_null(texts, "")
        coded, counts = runs_of(texts)
        found = pa.array(self.lookup(coded.dictionary.to_pylist()), pa.large_binary())
        at, held = joined(found.take(coded.indices), counts)
        out = [bytes(held[a:b]) for a, b in zip(at, at[1:], strict=False)]
        special = {i for s in self.bpe.special for i in np.flatnonzero(pc.match_substring(texts, s)).tolist()}
        for i in special:
            out[i] = self.encode(raw(texts.slice(i, 1))[0].decode("utf-8", "replace"))
        if self.held > REMEMBERED:
            self.aside.clear()
            self.aside.update(self)
            self.clear()
            self.held = 0
        return out

    def encode(self, text: str) -> bytes:
        out = []
        for part, special in self.bpe.parts(text):
            out += [pack("<I", special)] if special is not None else self.lookup(part.encode("utf-8", "surrogatepass").split())
        return b"".join(out)

    def lookup(self, runs: list[bytes]) -> list[bytes]:
        out = list(map(self.get, runs))
        absent = [i for i, ids in enumerate(out) if ids is None]
        for i in absent:
            out[i] = self.aside.get(runs[i])
        new = [i for i in absent if out[i] is None]
        for i, ids in zip(new, self.fresh([runs[i] for i in new]), strict=True):
            out[i] = ids
        for i in absent:
            run, ids = runs[i], out[i]
            if len(run) <= LONGEST:
                self[run] = ids
                self.held += len(run) + len(ids) + PLACE
        return out

    def fresh(self, runs: list[bytes]) -> list[bytes]:
        """Ids of new runs, whose words are found for many runs at once."""
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        texts = ["" if r.isascii() else r.decode("utf-8", "replace") for r in runs]
        for i, text in enumerate(texts):
            kinds[0 if not text else 1 + self.unicode.unsettled(text)].append(i)
        plain, settled, unsettled = kinds
        words = [self.bpe.ascii_between(b" ".join([runs[i] for i in plain]).lower())]
        words.append([w.encode("utf-8", "surrogatepass") for w in self.bpe.words_between(self.bpe.normal(" ".join([texts[i] for i in settled])))])
        words.append([w.encode("utf-8", "surrogatepass") for i in unsettled for w in (*self.unicode.words(self.unicode.normal(texts[i])), " ")][:-1])
        ids = self.of_words(list(set(chain.from_iterable(words)) - {b" "}))
        ids[b" "] = _BETWEEN
        out = [b""] * len(runs)
        for places, found in zip(kinds, words, strict=True):
            if places:
                for i, x in zip(places, b"".join(map(ids.__getitem__, found)).split(_BETWEEN), strict=True):
                    out[i] = x
        return out

    def of_words(self, words: list[bytes]) -> dict[bytes, bytes]:
        found = dict(zip(words, self.lexicon.get_all(words), strict=True)) if self.lexicon else dict.fromkeys(words)
        rest = [w for w, ids in found.items() if ids is None]
        found.update(zip(rest, self.bpe.merge_all(rest), strict=True))
        return found


def counts(columns: Iterable[pa.Array], bpe: Bpe) -> Iterator[pa.RecordBatch]:
    """Words and how often they occur; a word has a row each time that the counted runs take ``HELD`` bytes, and at the end."""
    count: dict[bytes, int] = {}
    held = 0

    def flush() -> pa.RecordBatch:
        found: Counter = Counter()
        while count:  # runs between white space, in which words are found once for all
            chunk, n = count.popitem()
            for w in (chunk.decode(),) if chunk.isalpha() else bpe.words(bpe.normal(chunk.decode("utf-8", "replace"))):
                if len(w) <= LONGEST:
                    found[w] += n
        return pa.RecordBatch.from_pydict({"w": pa.array([w.encode() for w in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    for texts in chain.from_iterable(map(pieces, columns)):
        coded, _ = runs_of(pc.ascii_lower(pc.fill_null(texts, "")))
        for run, n in zip(coded.dictionary.to_pylist(), np.bincount(coded.indices, minlength=len(coded.dictionary)).tolist(), strict=True):
            if run in count:
                count[run] += n
                continue
            count[run] = n
            held += len(run) + PLACE
            if held > HELD:
                yield flush()
                held = 0
    yield flush()


def frequent_words(docs: DataFrame, bpe_path: str, text: str, size: int = LEXICON) -> list[bytes]:
    """The most frequent words of the whole corpus, at most ``size`` of them, in ascending order.

    Only a histogram of the counts (64 bins a power of two) and the words taken come to the driver.
    """

    docs.sparkSession.sparkContext.addFile(bpe_path)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counts((b["_t"] for b in batches), _bpe(_shipped(bpe_path)))
        pa.default_memory_pool().release_unused()

    small_batches(docs.sparkSession)
    words = docs.select(F.col(text).cast("string").alias("_t")).mapInArrow(counted, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    # a word that occurs once is not frequent; the counts of the others are cut at a bin's edge
    words = cut(words.filter((F.col("n") > 1) & (F.octet_length("w") <= LONGEST)).withColumn("bin", F.floor(F.log2(F.col("n").cast("double")) * 64).cast("int")), "words")
    taken, least = 0, None
    for r in words.groupBy("bin").count().orderBy(F.desc("bin")).collect():
        taken += r["count"]
        if taken > size:
            break
        least = r["bin"]
    # where the top bin alone holds too many words, the most frequent of it, ties in the order of words
    few = words.orderBy(F.desc("n"), "w").limit(size) if least is None else words.filter(F.col("bin") >= least)
    return sorted(bytes(r["w"]) for r in few.select("w").collect())


def compiled(spark: SparkSession, words: list[bytes], bpe_path: str) -> str:
    """Compiles ``words`` and hands the file to the executors; returns the name under which they find it."""
    bpe, name = _bpe(bpe_path), f"lexicon-{uuid.uuid4().hex}.bin"
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), name)
    Lexicon.build(words, map(bpe.merge, words), path)
    spark.sparkContext.addFile(path)
    spark.sparkContext.addFile(bpe_path)
    return name


def encoded(text: Column, lexicon: str, bpe_path: str) -> Column:
    """Struct of ``ids`` (four little-endian bytes each) and ``decoded`` (their text)."""

    @F.arrow_udf("struct<ids:binary,decoded:binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        path = _shipped(bpe_path)
        bpe, words = _bpe(path), _words(path, lexicon)
        for column in batches:
            for texts in pieces(column):
                ids = words.rows(texts)
                yield pa.StructArray.from_arrays([pa.array(ids, pa.binary()), pa.array(bpe.decode(ids), pa.binary())], ["ids", "decoded"])
        pa.default_memory_pool().release_unused()  # the worker waits for other tasks with what it remembers alone

    return of(text.cast("string"))


def roundtrip(docs: DataFrame, bpe_path: str, doc_id: str = "doc_id", text: str = "text", lexicon: int = LEXICON) -> DataFrame:
    """Per row the number of ids, and digests of the ids and of the text decoded from them.

    Ids and decoded texts stay inside the task; ``encoded`` gives them as columns.
    """
    name = compiled(docs.sparkSession, frequent_words(docs, bpe_path, text, lexicon), bpe_path)
    found = docs.select(F.col(doc_id).alias("doc_id"), encoded(F.col(text), name, bpe_path).alias("e"))
    return found.select("doc_id", (F.octet_length("e.ids") / 4).cast("long").alias("n_tokens"), F.sha2("e.ids", 256).alias("ids_sha256"), F.sha2("e.decoded", 256).alias("decoded_sha256"))

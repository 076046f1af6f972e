"""Divergence of sources, packing and repair of conversations against brute force, with the awkward cases of each."""

import hashlib
import heapq
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from glintscan.llm import conversations, divergence, packing, queries

DOCS = "doc_id long, text string, lang string, source string, item string, value string, length string"


def audited(rows, top=10, least=10):
    """Definition: every kept term of a language in every pair of its sources."""
    count, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        w = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
        count[lang, source].update(w)
        documents[lang].update(set(w))
    out = []
    for lang, source in groups:
        kept = sorted(t for t, d in documents[lang].items() if d >= least)
        own = lambda s: [count[lang, s][t] for t in kept]  # noqa: E731, B023
        share = lambda n: [1 + 10**9 * (c + 2) // (sum(n) + 2 * len(kept)) for c in n]  # noqa: E731, B023
        others = [s for x, s in groups if x == lang]
        f = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = [("pair", s, sum(map(f, share(own(source)), share(own(s))))) for s in others if s != source]
        whole = [sum(count[lang, s][t] for s in others) for t in kept]
        terms = [("term", t, f(p, q)) for t, c, p, q in zip(kept, own(source), share(own(source)), share(whole), strict=True) if c and p > q]
        for part in (pairs, sorted(terms, key=lambda x: (-x[2], x[1].encode()))[:top]):
            out += [(lang, source, *x, i + 1) for i, x in enumerate(sorted(part, key=lambda x: (-x[2], x[1].encode())))]
    return Counter(out)


def test_divergence(spark, monkeypatch):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}" for a in ("Um", "ré", "k", "Ωo", "ß") for b in "abcdefgh"]
    rows = []
    for i in range(300):
        source = f"s{rng.randrange(9)}"
        own = vocabulary[:: 1 + int(source[1]) % 4]
        rows.append((i, " ".join(rng.choice(own) + rng.choice(["", ",", "1", "_"]) for _ in range(rng.randrange(30))), rng.choice(["x", "y"]), source, "a", "b", "c"))
    rows += [(900, None, "x", None, "a", "b", "c"), (901, "only", None, "s1", "a", "b", "c"), (902, "rare words", "z", "s1", "a", "b", "c"), (903, "", "z", "s2", "a", "b", "c")]
    rows += [rows[5]] * 3 + [(904, "uma " * 4000, "x", "s3", "a", "b", "c"), (None, "uma kb", "y", "s8", "a", "b", "c")]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    want = audited(rows)
    for block, held in ((64, divergence.HELD), (2, 20)):  # one block of sources; several, and tasks that hold little
        monkeypatch.setattr(divergence, "BLOCK", block)
        monkeypatch.setattr(divergence, "HELD", held)
        monkeypatch.setattr(divergence, "MATRICES", 1 if block == 2 else 256)
        assert Counter(map(tuple, divergence.audit(docs).collect())) == want
    assert divergence.audit(docs.limit(0)).count() == 0


def test_terms_in_sections(monkeypatch):
    monkeypatch.setattr(divergence, "_SECTION", 7)
    for text in ("", "a", "ab" * 40, "éé " * 9 + "long" * 8 + " b1c", "1 2 3", "x" * 7 + " " + "y" * 6):
        assert [t for s in divergence.sections(text.encode()) for t in s] == text.lower().encode().translate(divergence._TERMS).split()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary("byte_bpe_50k.json"))


TEXTS = [
    None, "", " ", "\n\n a\n", "Don't we've  x\t\ty .", "a.'s 'sx ''s", "naïve café — 3½ m² ٣٤ Ⅷ", "Ωμέγα 東京 　 x\x85y\x1cz", "word " * 3000, "áb c‍d 🙂🙂", "<|endoftext|> a<|endoftext|>",
    "x" * 5000, "l'été, l'an'", "\x00a \x00", "1 22 333,4.5", " lead", "trail ", "a\nb\nc d", "don't\nI'll 'em", "ﬁ ŉ ǆ ɐ ɏ", "ʼn’s it’s", "tab\there", "  x",
]


def test_ids_are_those_of_the_library(library, monkeypatch):
    rng = random.Random(12)
    letters = "aé Ab'st.,\n\t1²ßΩ東́-_　\xa0"
    texts = [t for t in TEXTS if t] + ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 30))) for _ in range(4000)]
    encoder = packing.Encoder(queries.vocabulary("byte_bpe_50k.json"))
    assert encoder.ranks is not None
    for section in (packing.SECTION, 3):
        monkeypatch.setattr(packing, "SECTION", section)
        for t in texts:
            assert np.frombuffer(encoder.encode(t), "<u4").tolist() == library.encode(t, add_special_tokens=False).ids, t
    other = packing.Encoder(queries.vocabulary("word_bpe_49k.json"))  # not by bytes: the library does it all
    assert other.ranks is None and len(other.encode("Some words")) > 0


@pytest.mark.parametrize("node", [packing.NODE, 6])
def test_packing(spark, library, monkeypatch, node):
    monkeypatch.setattr(packing, "NODE", node)
    monkeypatch.setattr(packing, "FAN", 2)
    rng = random.Random(13)
    texts = TEXTS + ["word " * rng.randrange(1, 4500) for _ in range(120)] + ["few words"] * 9
    rows = [(i, t, "x", "y", "z", "u", "v") for i, t in enumerate(texts)]
    docs = spark.createDataFrame([*rows, rows[8]], DOCS).repartition(3)
    found = packing.packed(docs, queries.vocabulary("byte_bpe_50k.json"), ids=True).cache()
    got = found.drop("ids").collect()
    want = Counter()
    for i, t in [*enumerate(texts), (8, texts[8])]:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for piece, end in enumerate(range(first, len(ids) + 1, 2048)):
            start = end - 2048 if piece else 0
            want[i, piece, start, end - start, zlib.crc32(np.array(ids[start:end], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 2048
    least = -(-sum(n for b in bins.values() for _, n in b) // 2048)
    assert len(bins) <= 1.1 * least + 1
    for r in packing.sequences(found).collect():
        assert len(r["ids"]) == 4 * r["ends"][-1] and list(r["ends"]) == sorted(r["ends"])
    assert packing.packed(docs.limit(0), queries.vocabulary("byte_bpe_50k.json")).count() == 0


def test_what_a_node_hands_on_changes_nothing(monkeypatch):
    """Merging with all open bins, and with those that are handed on, ends in as many bins."""
    rng = np.random.default_rng(3)
    monkeypatch.setattr(packing, "NEARLY", 0)

    def rounds(nodes, keep):
        done, left = 0, len(nodes)
        while len(nodes) > 1:
            left = -(-len(nodes) // packing.FAN)
            ahead = 0
            while packing.FAN**ahead < left:
                ahead += 1
            merged = []
            for k in range(left):
                items = np.concatenate(nodes[k * packing.FAN : (k + 1) * packing.FAN])
                fill = packing.best_fit(items, 100)[2]
                on = packing.handed_on(fill, 100, ahead) if keep else np.full(len(fill), left > 1)
                done += int((~on).sum())
                merged.append(fill[on])
            nodes = merged
        return done + len(nodes[0]) if left > 1 else done

    monkeypatch.setattr(packing, "FAN", 3)
    for _ in range(30):
        nodes = []
        for _ in range(27):
            fill = packing.best_fit(rng.integers(1, 101, rng.integers(1, 60)), 100)[2]
            nodes.append((fill, packing.handed_on(fill, 100, 3)))
        every = rounds([f for f, _ in nodes], False)
        assert every == rounds([f[on] for f, on in nodes], True) + sum(int((~on).sum()) for _, on in nodes)


TURNS = "conv_id long, turn long, role string, text string, edit string, fault string"


def repaired(rows):
    """Definition: the cheapest edits by a search over turns and states, ties by the initials."""
    rows = [(c, n, r if r is not None else " ", t if t is not None else " ") for c, n, r, t, *_ in rows]
    out = {}
    for conv in {c for c, *_ in rows}:
        turns = []
        for _, n, role, text in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3])):
            kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if n is None else n}".encode()) % 20
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            turns += [(n, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        faults, seen = [], set()
        for _, role, text in turns:
            words = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
            seen.add((role, text))
        heap, settled = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, q, made = heapq.heappop(heap)
            if (i, q) in settled:
                continue
            settled.add((i, q))
            if i == len(turns) and q in (0, 3):
                break
            to, then = ("user", 2) if q != 2 else ("assistant", 3)
            heapq.heappush(heap, (cost + 5, audit + "I", i, then, (*made, f"{to}:")))
            if i < len(turns):
                _, role, text = turns[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, q, made))
                if faults[i] not in ("blank", "duplicate"):
                    more = cost + 5 * (faults[i] == "truncated")
                    heapq.heappush(heap, (more + 1, audit + "R", i + 1, then, (*made, f"{to}:{text}")))
                    if role[:1] == to[0] or role[:1] == "s" and q == 0:
                        heapq.heappush(heap, (more, audit + "K", i + 1, 1 if role[:1] == "s" else then, (*made, f"{role}:{text}")))
        known = [n for n, *_ in turns if n is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[:1] for _, r, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(made).encode()).hexdigest())
    return out


def test_repair(spark):
    rng = random.Random(14)
    rows = []
    for conv in range(150):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["system", "user", "assistant", "user", "assistant", "tool", "", None, "unknown"])
            rows.append((conv, rng.choice([turn, turn, turn, None, turn + 3]), role, rng.choice(["Yes.", "No!", "cut off", "", " \n", None, "One.\n", "é", "a b?", "Yes."]), "x", "y"))
    rows += [(None, 1, "user", "A.", "x", "y"), (None, None, "assistant", "B.", "x", "y")] + rows[:3] * 2
    rows += [(500, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}." + " long" * 50 * (t % 7 == 0), "x", "y") for t in range(3000)]
    turns = conversations.prepared(spark.createDataFrame(rows, TURNS).repartition(5))
    found = conversations.report(conversations.damaged(turns)).collect()
    want = repaired(rows)
    assert {None if r[0] is None else int(r[0]): tuple(r)[1:] for r in found} == want and len(found) == len(want)
    assert conversations.report(turns.limit(0)).count() == 0
    # the repaired turns themselves make the digests, and follow the grammar
    conv = defaultdict(list)
    audit = defaultdict(str)
    for r in conversations.edits(conversations.damaged(turns)).collect():
        audit[r["conv_id"]] += r["edit"]
        if r["place"] is not None:
            conv[r["conv_id"]].append((r["place"], r["role"], r["text"]))
    for r in found:
        own = sorted(conv[r["conv_id"]])
        assert [p for p, *_ in own] == list(range(len(own)))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for _, a, b in own).encode()).hexdigest() == r["repaired_sha256"]
        assert re.fullmatch("(s?(ua)+)?", "".join(a[:1] for _, a, _ in own)) and audit[r["conv_id"]] == r["audit"]

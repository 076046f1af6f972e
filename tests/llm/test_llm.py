"""The operators against brute force on small fixtures, with the awkward cases of each."""

import hashlib
import json
import math
import random
import re
import sys
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from glintscan.llm import components, decontamination, licenses, ngram_join, quality_classifier, quality_rules, queries, secrets, substring_dedup, toxicity, warc, word_bpe
from glintscan.llm.boosting import fit
from glintscan.llm.shingles import rolled

DOCS = "doc_id long, text string, n_words string, component_id string"  # extra columns with clashing names

LETTERS = str.maketrans("0123456789", "aeioustnrl")


def words(rng, n, vocabulary=3000):
    return [f"w{rng.randrange(vocabulary)}".translate(LETTERS) for _ in range(n)]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    base = words(rng, 400)
    passage = words(rng, 60)
    out = [None, "", "  \n ", "one", "one", "a b c d"]
    for k in range(30):  # a family of near copies, from close to far
        w = list(base)
        for _ in range(k):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    out += [" ".join(base)] * 5 + [" ".join(base).upper()]
    out += [" ".join(words(rng, 50) + passage + words(rng, rng.randrange(5, 90))) for _ in range(12)]
    out += [" ".join(words(rng, rng.randrange(1, 200))) for _ in range(20)] + [" ".join(words(rng, 20000)), " ".join(passage[:50]), "é ü " * 40]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[40], (None, texts[10], "x", "y")], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def test_ngram_join(docs, none, texts, monkeypatch):
    sets = [shingles(t) for t in texts]
    part = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    want = Counter((i, len(s), part[i]) for i, s in enumerate(sets))
    want[40, len(sets[40]), part[40]] += 1
    want[None, len(sets[10]), None] += 1
    for members, few in ((ngram_join.BLOCK_MEMBERS, 16), (4, 16), (4, 2)):  # one block a family; many blocks; many that meet by keys
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", members)
        monkeypatch.setattr(ngram_join, "FEW_BLOCKS", few)
        assert Counter(map(tuple, ngram_join.link(docs).collect())) == want
    assert ngram_join.link(none).count() == 0
    stay = {r["doc_id"] for r in ngram_join.representatives(docs.filter("doc_id is not null")).collect()}
    assert stay == {i for i in range(len(texts)) if part[i] == i}


def components_of(sets, percent=75):
    part = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                old, new = max(part[i], part[j]), min(part[i], part[j])
                part = [new if p == old else p for p in part]
    return part


def test_ngram_join_of_a_chain_of_keys(spark, monkeypatch):
    """Neighbours share keys all along, but only some of them link: one family, many blocks, few links."""
    rng = random.Random(12)
    pieces = [words(rng, 44, 10**6) for _ in range(60)]
    texts = [" ".join(pieces[i] + pieces[i + 1] + words(rng, 4, 10**6)) for i in range(59)]
    for i in rng.sample(range(59), 15):
        w = texts[i].split()
        w[rng.randrange(len(w))] = "changed"
        texts.append(" ".join(w))
    rng.shuffle(texts)
    part = components_of([shingles(t) for t in texts])
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    for few in (16, 2):
        monkeypatch.setattr(ngram_join, "BLOCK_MEMBERS", 6)
        monkeypatch.setattr(ngram_join, "FEW_BLOCKS", few)
        assert {r["doc_id"]: r["component_id"] for r in ngram_join.link(rows).collect()} == dict(enumerate(part))
    assert 50 < len(set(part)) < 74


def test_tokens_are_carried_whole():
    for buckets in (256, 257, 65_535, 65_536, 100_003):
        n = ngram_join.token_bytes(buckets)
        for token in (0, 1, (1 << 64) - 1, 0x9E3779B97F4A7C15):
            left = np.array([token], np.uint64) // np.uint64(buckets)
            packed = left.view(np.uint8)[:n].tobytes()
            assert int.from_bytes(packed, "little") * buckets + token % buckets == token


def test_index_keys_keep_every_link():
    rng = random.Random(3)
    for _ in range(300):
        n = rng.randrange(3, 60)
        a = set(rng.sample(range(100), n))
        b = {x for x in a if rng.random() < 0.9} | set(rng.sample(range(200, 300), rng.randrange(0, 1 + n // 6)))
        if not b or 100 * len(a & b) < 75 * len(a | b):
            continue
        keys = [set(ngram_join.index_keys(len(s), np.array([], np.uint64), np.array(sorted(s), np.uint64), 75).tolist()) for s in (a, b)]
        assert keys[0] & keys[1]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 3), (None, 5)] + [(200, 200 + i) for i in range(1, 60)]
    got = dict(components.components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100} | {i: 200 for i in range(200, 260)}


def test_substring_dedup(docs, none, texts):
    first, want = {}, Counter()
    rows = [(i, t) for i, t in enumerate(texts)]
    for i, t in rows:
        w, gone = (t or "").encode().split(), set()
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                gone.update(range(j, j + 50))
        want[i, len(w), len(gone), b" ".join(x for j, x in enumerate(w) if j not in gone)] += 1 + (i == 40)
    plain = texts[10].encode().split()
    want[None, len(plain), 0, b" ".join(plain)] += 1
    for group in (substring_dedup.GROUP, 3):  # all in trees; prefixes lengthened to whole windows
        assert Counter((r["doc_id"], r["n_words"], r["n_removed"], bytes(r["kept"])) for r in substring_dedup.dedup(docs, group=group).collect()) == want
    assert substring_dedup.dedup(none).count() == 0


def test_quality_rules(docs, none, texts):
    rows = quality_rules.assess(docs).collect()
    assert len(rows) == len(texts) + 2 and quality_rules.assess(none).count() == 0
    for r in rows:
        if r["doc_id"] is not None:
            w = re.findall(r"[^\x20\x09-\x0D]+", texts[r["doc_id"]] or "")
            grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
            hit = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
            assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(hit))
            assert r["base_failed"] == (len(w) < 50 or 2 * len(hit) > len(w)) and not (r["kept"] and r["base_failed"])
    kept = {r["doc_id"] for r in rows if r["kept"]}
    assert {r["doc_id"] for r in quality_rules.keep(docs).collect()} == kept and quality_rules.keep(docs).columns == docs.columns


def test_trees_against_plain_loops():
    rng = np.random.default_rng(5)
    x, y = rng.random((600, 4)), (rng.random(600) < 0.4).astype(float)
    y[x[:, 2] > 0.7] = 1
    forest = fit(x, y, trees=5, depth=3)
    for row, s in zip(x[:50], forest.score(x[:50]), strict=True):
        z = forest.start
        for t in range(5):
            node = 0
            for _ in range(3):
                node = 2 * node + 1 + int(row[forest.feature[t, node]] > forest.threshold[t, node])
            z += forest.leaf[t, node - 7]
        assert abs(1 / (1 + np.exp(-z)) - s) < 1e-12
    # the first split is the best of all features and bin edges
    p = 1 / (1 + np.exp(-forest.start))
    g, h = p - y, np.full(600, p * (1 - p))
    best = -np.inf
    for f in range(4):
        for cut in np.unique(np.quantile(x[:, f], np.linspace(0, 1, 65)[1:-1])):
            left = x[:, f] <= cut
            if h[left].sum() >= 3 and h[~left].sum() >= 3:
                best = max(best, g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2))
    left = x[:, forest.feature[0, 0]] <= forest.threshold[0, 0]
    assert abs(g[left].sum() ** 2 / (h[left].sum() + 2) + g[~left].sum() ** 2 / (h[~left].sum() + 2) - best) < 1e-9


def test_risk_goes_down_by_its_gradient():
    """Steps of the fit lower the corrected risk, computed here by its definition, and its minimum is one by differences."""
    rng = np.random.default_rng(8)
    positive = np.arange(300) < 60
    design = (rng.random((300, 6)) < np.where(positive[:, None], [0.6, 0.5, 0.2, 0.2, 0.2, 0.2], 0.2)).astype(float)
    rows, cols = np.nonzero(design)
    prior = 0.2

    def risk(w, bias):
        z = design @ w + bias
        loss = lambda s, of: np.logaddexp(0, s * z[of]).mean()
        return prior * loss(-1, positive) + max(0.0, loss(1, ~positive) - prior * loss(1, positive)) + 1e-4 / 2 * (w**2).sum()

    w, bias = toxicity.nnpu(rows, cols, positive, 6, prior, steps=3000, rate=0.02)
    best = risk(w, bias)
    assert best < risk(np.zeros(6), np.log(prior / (1 - prior))) and w[0] > 0.5
    for k in range(7):
        for step in (-1e-2, 1e-2):
            moved = np.append(w, bias)
            moved[k] += step
            assert risk(moved[:-1], moved[-1]) >= best - 1e-5


def test_weights_stand_for_repeated_rows():
    rng = np.random.default_rng(3)
    grid, positive, weight = (rng.random((40, 5)) < 0.4).astype(int), np.arange(40) < 10, rng.integers(1, 6, 40)
    one, many = np.nonzero(grid), np.nonzero(np.repeat(grid, weight, axis=0))
    want = toxicity.nnpu(*many, np.repeat(positive, weight), 5, 0.2)
    got = toxicity.nnpu(*one, positive, 5, 0.2, weight=weight)
    assert np.allclose(want[0], got[0]) and abs(want[1] - got[1]) < 1e-9


def test_unlabelled_rows_are_dealt_whole_and_evenly(spark):
    counts = {(): 70_001, (1,): 5, (1, 2): 1, (3,): 3, (2, 2): 12}
    rows = spark.createDataFrame([(list(c), n) for c, n in counts.items()], "_c array<int>, _n long")
    for shards in (1, 2, 7, 50):
        got, load = dict.fromkeys(counts, 0), dict.fromkeys(range(shards), 0)
        for r in toxicity.dealt(rows, shards).collect():
            got[tuple(r["_c"])] += r["_n"]
            load[r["_s"]] += r["_n"]
        assert got == counts and max(load.values()) - min(load.values()) <= 2 * len(counts)


def test_toxicity_does_not_depend_on_the_order_of_rows_and_uses_all_shards(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(words(rng, 40) + (["vile"] * 4 if i % 4 == 0 else [])), "", "") for i in range(400)] + [(None, "plain", "", "")]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    models = [toxicity.train(d, labels, shard=100) for d in (docs, docs.repartition(5))]
    assert models[0].vocabulary == models[1].vocabulary and (models[0].weights == models[1].weights).all() and models[0].bias == models[1].bias
    whole = toxicity.train(docs, labels)
    vile = whole.vocabulary.index(b"vile")
    assert models[0].weights[vile] > 0.5 and whole.weights[vile] > 0.5 and models[0].weights[vile] != whole.weights[vile]


def test_repeated_ids_are_learnt_from_once(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(words(rng, 60) + (["vile"] * 4 if i % 3 == 0 else [])), "", "") for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int").withColumn("quality", F.col("toxic"))
    once, often = spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows + [rows[3]] * 300, DOCS)
    for module in (quality_classifier, toxicity):
        got = [{r["doc_id"]: r["score"] for r in module.classify(d, labels).collect()} for d in (once, often)]
        assert got[0].keys() == got[1].keys() and all(abs(got[0][i] - got[1][i]) < 1e-9 for i in got[0])
    tall = spark.createDataFrame([*rows, (500, "vile " * 200_000, "", "")], DOCS)
    assert toxicity.classify(tall, labels).filter("doc_id = 500").first()["predicted"] == 1


def test_boosting_learns_an_interaction():
    x = np.random.default_rng(0).random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.3)).astype(float)
    forest = fit(x[:3000], y[:3000])
    assert ((forest.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    assert len(fit(x[:5], np.ones(5)).feature) == 0


@pytest.mark.parametrize("module, label", [(quality_classifier, "quality"), (toxicity, "toxic")])
def test_classifiers(spark, none, module, label):
    rng = random.Random(1)
    rows = [(i, " ".join(words(rng, 80) + (["vile", "@@", "##"] * 6 if i % 3 == 0 else [])), "", "") for i in range(300)]
    docs = spark.createDataFrame([*rows, (900, None, "", ""), (901, "", "", ""), rows[5]], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(None, 1), (7, None), (5000, 1)], f"doc_id long, {label} int")
    got = module.classify(docs, labels).collect()
    assert len(got) == 303 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 300]
    assert held and sum(r["predicted"] == (r["doc_id"] % 3 == 0) for r in held) >= 0.95 * len(held)
    assert module.classify(none, labels).count() == 0
    assert module.classify(docs, labels.limit(0)).count() == 303


def test_secrets(spark, none):
    rng = random.Random(5)
    token = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(40))
    cases = ["", None, 'é Token = "abcdef" password:abc', "secret: token: abcdefg", "key AKIA" + "A" * 16 + " AKIA" + "B" * 15, "x" + "0af" * 8 + "g " + "a" * 23, f"see {token} here", "ggggg1111" * 5, "api_key='" + "0123456789abcdef" * 2 + "'"]
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(cases)], DOCS)
    got = {r["doc_id"]: r for r in secrets.scan(rows).collect()}
    spans = [got[i]["spans"] for i in range(len(cases))]
    assert spans[:6] == ["", "", "assign:2:17", "", "access:4:24", "hex:1:25"]
    assert spans[6:] == ["random:4:44", "", "assign:0:41,hex:9:41"]
    assert got[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() == got[6]["base_sha256"]
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert masked[2] == 'é [SECRET]" password:abc' and masked[6] == "see [SECRET] here" and masked[8] == "[SECRET]'" and masked[1] is None
    assert secrets.scan(none).count() == 0


def test_secrets_in_names_and_mixed_alphabets(spark):
    rng = random.Random(8)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    secret = lambda more, n: "".join(rng.choice(letters + more) for _ in range(n - 4)) + "a1" + more
    a, b, c, d = secret("+/", 40), secret("-_", 40), secret("+/", 42), secret("-_", 39)
    cases = [f"AWS_SECRET_ACCESS_KEY={a}", f"PRIVATE_KEY={b} x", f"GET /v1?key={d}&sig={c}==", f"A={a}={b}", "=" + a, f"{a}{b}"]
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(cases)] + [(100 + i, f"LOG_LINE=g1{'g' * 30 + 'h' * 20}", "", "") for i in range(30)], DOCS)
    got = {r["doc_id"]: r["text"] for r in secrets.redact(rows).collect()}
    assert [got[i] for i in range(6)] == ["AWS_SECRET_ACCESS_KEY=[SECRET]", "PRIVATE_KEY=[SECRET] x", "GET /v1?key=[SECRET]&sig=[SECRET]", "A=[SECRET]=[SECRET]", "=[SECRET]", "[SECRET]"]
    assert all("g1gggg" in got[100 + i] for i in range(30))
    short = spark.createDataFrame([("a1" + "=" * 20,)], "t string").select(secrets.rounded(secrets.battery(F.col("t"))).alias("s"))
    assert short.first()["s"] is None


def test_base_spans_against_python(spark):
    rng = random.Random(41)
    bits = ["password", "Token", "api_key", "apikey", "secret", "SECRET", "passwd", '"', "'", " ", "  ", ":", "=", "é", "\n", "abc", "abcdef+/", "AKIA", "ABCDEFGHIJKLMNOP", "Z9", "0123456789abcdef", "deadbeef", "_", ".", "-", "x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(1, 60))) for _ in range(400)] + ["token=abcdef " * 3000]
    assign, access, hexa = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    for r in secrets.scan(rows).collect():
        t = texts[r["doc_id"]]
        kinds = [[m for m in assign.finditer(t) if len(m[2]) >= 6], [m for m in access.finditer(t) if len(m[0]) >= 20], [m for m in hexa.finditer(t) if len(m[0]) >= 24]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == list(map(len, kinds))
        spans = sorted((m.start(), k, m.end()) for k, found in enumerate(kinds) for m in found)
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()


def _limits(steps):
    """The control by its definition, for one class: tokens of lower steps are reported."""
    m, limit = len(steps), 0
    random_tokens = min((k + secrets.ERRORS * math.sqrt(k + 1)) / (1 - 10 ** (-u / 20)) for u in secrets.UPPER for k in [sum(s < u for s in steps)])
    p = sorted(10 ** (-s / 20) for s in steps)
    last = max((k for k, x in enumerate(p, 1) if x * m <= secrets.Q * k), default=0)
    for step in sorted(set(steps)):
        reported = sum(s <= step for s in steps)
        names = reported - random_tokens * (1 - 10 ** (-(step + 1) / 20))
        if names <= secrets.Q * reported and not (last and 10 ** (-step / 20) <= p[last - 1]):
            limit = step + 1
    return limit


def test_false_discovery_control_against_the_definition(spark):
    rng = random.Random(43)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    texts = ["a1" + ("".join(rng.choice(letters) for _ in range(28)) if i % 2 else "".join(rng.choice("gh") for _ in range(28))) for i in range(600)]
    rows = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)
    steps = [r["s"] for r in rows.select(secrets.rounded(secrets.battery(F.col("text"))).alias("s")).collect()]
    limit = _limits(steps)
    assert secrets.thresholds(rows) == {4: limit} and 250 <= sum(s < limit for s in steps) <= 320
    assert sum(r["n_random"] for r in secrets.scan(rows).collect()) == sum(s < limit for s in steps)
    cases = [(c, s) for c in range(30) for s in [int(rng.expovariate(rng.choice((0.05, 0.1, 0.3)))) for _ in range(rng.choice((1, 2, 5, 40, 300)))]]
    got = {r["cls"]: r["limit"] for r in secrets.limits_of(spark.createDataFrame(cases, "cls int, step int").groupBy("cls", "step").count()).collect()}
    for c in range(30):
        assert got.get(c, 0) == _limits([s for k, s in cases if k == c])


def test_both_error_rates_of_the_control(spark):
    """Of ordinary names next to none are reported, alone or among random tokens; random tokens are."""
    rng = random.Random(1)
    words = "get set user order item cache line config path name value list map index count total file read write open close data table row column".split()
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    names = []
    while len(names) < 1500:
        parts = [rng.choice(words) for _ in range(rng.choice((4, 5, 6)))] + [str(rng.randrange(1, 1000))]
        names.append(rng.choice((parts[0] + "".join(w.title() for w in parts[1:]), "_".join(parts), "-".join(parts), "/".join(parts))))
    names = [n for n in names if len(n) >= secrets.SHORTEST]
    tokens = ["a1" + "".join(rng.choice(letters) for _ in range(n - 2)) for n in (20, 32, 40) for _ in range(400)]

    def reported(rows):
        df = spark.createDataFrame([(i, t, "", "") for i, t in enumerate(rows)], DOCS)
        found = secrets.scan(df).filter("n_random > 0").join(df, "doc_id").select("text").collect()
        return sum(r["text"] in set(names) for r in found), len(found)

    assert reported(names)[0] <= 0.005 * len(names)
    false, every = reported(names + tokens)
    # half of the 400 and 800 random tokens of the two classes lie above 0.5; the estimate may exceed by its standard errors
    margin = secrets.ERRORS * sum(math.sqrt(n / 2) / 0.5 for n in (400, 800))
    assert false <= secrets.Q * every + margin and every - false >= 0.9 * len(tokens)


def test_battery_against_plain_statistics(spark):
    """The three tests and their combination, with exact counts in plain Python."""
    rng = random.Random(11)
    tail = lambda z: 1 / (1 + math.exp(min(700.0, 0.07056 * z**3 + 1.5976 * z)))

    def plain(token, letters):
        at, n, k = [letters.index(c) for c in token], len(token), len(letters)
        share = sum((at.count(v) - n / k) ** 2 / (n / k) for v in range(k))
        chi = tail((share - (k - 1)) / math.sqrt(2 * (k - 1) * (1 - 1 / n)))
        high = [v >= k / 2 for v in at]
        runs, up = 1 + sum(a != b for a, b in zip(high, high[1:], strict=False)), sum(high)
        m = 2 * up * (n - up) / n
        spread = m * (m - 1) / (n - 1)
        run = 2 * tail(abs(runs - m - 1) / math.sqrt(spread)) if spread > 0 else 2.0 ** (1 - n)
        mean = sum(at) / n
        square = sum((v - mean) ** 2 for v in at)
        lag = sum((a - mean) * (b - mean) for a, b in zip(at, at[1:], strict=False))
        serial = 2 * tail(abs(lag / square + 1 / n) * math.sqrt(n)) if square else float(k) ** (1 - n)
        s = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (chi, run, serial))
        table = ((0.0, 0.0), *(secrets.TAIL if n >= 18 else secrets.TAIL_SHORT))
        for (a, u), (b, v) in zip(table, table[1:], strict=False):
            if s < b:
                return math.exp(-(u + (s - a) * (v - u) / (b - a)))
        return math.exp(-table[-1][1] * (s / table[-1][0]) ** 0.3)

    hexa, lower = "0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789"
    tokens = ["".join(rng.choice(pool) for _ in range(rng.randrange(8, 90))) for pool in (hexa, lower, "gh", "g1", "zz9") for _ in range(40)] + ["g" * 30, "0" * 20]
    rows = spark.createDataFrame([(t,) for t in tokens], "t string")
    for r in rows.select("t", secrets.battery(F.col("t")).alias("p")).collect():
        want = plain(r["t"], hexa if set(r["t"]) <= set(hexa) else lower)
        assert abs(math.log(r["p"]) - math.log(want)) < 1e-6 * max(1.0, abs(math.log(want)))


def test_random_tokens_are_not_thrown_out(spark):
    rng = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    token = lambda k, n: "a1" + "".join(rng.choice(letters[:k]) for _ in range(n - 2))
    rows = spark.createDataFrame([(i, token(*((62, 40), (36, 20))[i % 2]), "", "") for i in range(4000)], DOCS)
    assert sum(r["n_random"] + r["n_hex"] for r in secrets.scan(rows).select("n_random", "n_hex").collect()) >= 3998


def test_licenses_inside_lines_and_before_code(spark):
    header = licenses.TEMPLATES["gpl-header"]
    cases = ["Released under the MIT License. Copyright 2020 Foo Bar. All rights reserved by nobody.", f"# a file of ours\n{header}\nimport os\nx = 1\nfor i in range(9):\n    print(i, x)", "a license of the apache tribe, version of the story", "a\n" + "foo " * 300 + "licensed under the apache license version 2 0 " + "bar " * 300]
    rows = licenses.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(cases)], DOCS)).collect()
    assert {(r["doc_id"], r["license"], r["line"]) for r in rows} == {(0, "mit", 1), (1, "gpl-header", 2), (3, "apache-2.0", 2)}


def test_licenses_against_plain_sets(spark):
    """Every line, block and text against every template, by sets, without bounds or marks."""
    rng = random.Random(21)
    sets = {k: set(licenses.bigrams(v)) for k, v in licenses.TEMPLATES.items()}
    texts = []
    for _ in range(40):
        w = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = rng.choice(words(rng, 3))
        texts.append(rng.choice(["", "intro\n", "a\n\nb\n"]) + " ".join(w) + rng.choice(["", "\nend", "\n\nrest of it"]))
    got = {(r["doc_id"], r["license"]) for r in licenses.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(texts)], DOCS)).collect()}
    for i, t in enumerate(texts):
        for unit in {*t.split("\n"), *re.split(r"\n[ \t\r]*\n", t), t}:
            own = set(licenses.bigrams(unit))
            dice = {k: 2 * len(own & s) / (len(own) + len(s)) for k, s in sets.items()}
            best = max(dice, key=lambda k: (dice[k], k))
            assert dice[best] < licenses.THRESHOLD or (i, best) in got, (unit, best)


def test_licenses(spark, none):
    cases = ["Prose.\nLicensed under the Apache License, Version 2.0.\nMore.", "released under the mit license", "Nothing here", None, "", "This work is licensed under\nthe GNU General Public License, version 3"]
    rows = licenses.scan(spark.createDataFrame([(i, t, "", "") for i, t in enumerate(cases)], DOCS)).collect()
    assert sorted((r["doc_id"], r["license"], r["line"]) for r in rows) == [(0, "apache-2.0", 2), (1, "mit", 1), (5, "gpl-3.0", 0)]
    assert licenses.scan(none).count() == 0


def test_warc(spark):
    big = "é" * 400_000
    rows = [(1, "u 1", big), (2, "u\n2", "short"), (3, None, "short"), (4, "u", None), (5, "u", big), (6, "u", big), (6, "u", big), (None, "u", big), (7, "u", "WARC/1.1\r\n\r\n" * 50), (8, "u", "WARC/1.1\r\n\r\n" * 50)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    chunks = warc.archive(pages).cache()
    assert chunks.filter("length(data) > 262144").count() == 0 and chunks.filter("page_id = 1").count() == 4
    want = Counter()
    for page, _, t in rows:
        raw = (t or "").encode()
        first = {big: 1, rows[8][2]: 7}.get(t)
        again = first is not None and page is not None and page > first
        want[page, len(raw), hashlib.sha256(raw).hexdigest(), "revisit" if again else "response", first if again else None] += 1
    assert Counter(map(tuple, warc.records(chunks).collect())) == want
    assert warc.archive(pages.limit(0)).count() == 0
    assert chunks.groupBy("record_id", "chunk").count().filter("count > 1").count() == 0
    more = pages.withColumn("digest", F.lit("x")).withColumn("first", F.lit(1)).withColumn("_id", F.lit(2))
    assert Counter(map(tuple, warc.records(warc.archive(more)).collect())) == want


def naive_tiles(item, text, least):
    """Greedy string tiling by the definition: the longest free common run first, ties by place."""
    free_i, free_t, out = [True] * len(item), [True] * len(text), []
    while True:
        best = (least - 1, 0, 0)
        for p in range(len(item)):
            for t in range(len(text)):
                n = 0
                while p + n < len(item) and t + n < len(text) and free_i[p + n] and free_t[t + n] and item[p + n] == text[t + n]:
                    n += 1
                best = max(best, (n, -p, -t))
        n, p, t = best[0], -best[1], -best[2]
        if n < least:
            return out
        free_i[p : p + n] = free_t[t : t + n] = [False] * n
        out.append((n, p, t))


def test_tiles_against_the_definition():
    rng = random.Random(31)
    for k in range(600):
        item = np.array([rng.randrange(1, (60, 6, 3)[k % 3]) for _ in range(rng.randrange(3, 50))])
        text = np.array([rng.randrange(1, 60) for _ in range(rng.randrange(0, 40))] + list(item[rng.randrange(len(item)) :]) + [rng.randrange(1, 6)] + list(item[: rng.randrange(len(item))]))
        assert decontamination.tiles(item, text, 3) == naive_tiles(item.tolist(), text.tolist(), 3)
    item = [int(c) for c in "2122222212222111221212"]
    text = [int(c) for c in "122211122122222121222"]
    for length in (5, 20):
        found = decontamination.tiles(np.array(item), np.array(text), 5, length)
        assert found == naive_tiles(item, text, 5)


def test_rolled_hashes_are_those_of_equal_windows():
    x = np.random.default_rng(3).integers(0, 3, 500).astype(np.uint64)
    for k in (1, 2, 5, 20, 499, 500, 501):
        h = rolled(x, k)
        assert len(h) == max(0, 501 - k) and len(set(h.tolist())) == len({tuple(x[i : i + k].tolist()) for i in range(max(0, 501 - k))})


def test_decontamination_short_items_ties_and_blocks(spark, monkeypatch):
    rng = random.Random(6)
    item = words(rng, 30)
    bench = spark.createDataFrame([(5, " ".join(item)), (4, " ".join(item)), (9, "Only Four, short words"), (8, "!!"), (7, " ".join(words(rng, 30)))], "item_id long, text string")
    long = " ".join(words(rng, 30_000, 10**6) + item + ["a"] * 3000)
    cases = [" ".join(item), " ".join(item), "see only four short words here", "only four long words", long, None, "", "a " * 5000]
    shape = "doc_id long, text string, _digest string, _match string, m string"
    rows = spark.createDataFrame([(i, t, "", "", "") for i, t in enumerate(cases)] + [(0, cases[0], "", "", "")], shape)
    for size in (decontamination.BLOCK_BYTES, 100):  # one block; several
        monkeypatch.setattr(decontamination, "BLOCK_BYTES", size)
        got = Counter((r["doc_id"], r["contaminated"], r["item_id"]) for r in decontamination.assess(rows, bench).collect())
        assert got == Counter([(0, True, 4), (0, True, 4), (1, True, 4), (2, True, 9), (3, False, None), (4, True, 4), (5, False, None), (6, False, None), (7, False, None)])
        clean = decontamination.clean(rows, bench)
        assert clean.columns == rows.columns and sorted(r["doc_id"] for r in clean.collect()) == [3, 5, 6, 7]


def test_decontamination(spark, none):
    rng = random.Random(2)
    item = words(rng, 40)
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, " ".join(words(rng, 30))), (3, "too short"), (4, None)], "item_id long, text string")
    noise = lambda n: words(rng, n, 10**6)
    cases = [noise(30) + item + noise(10), noise(5) + item[20:] + noise(9) + item[:20], item[:10] + noise(50), noise(100), [w.upper() + "," for w in item]]
    rows = spark.createDataFrame([(i, " ".join(c), "", "") for i, c in enumerate(cases)] + [(8, None, "", ""), (9, "", "", "")], DOCS)
    got = {r["doc_id"]: r for r in decontamination.assess(rows, bench).collect()}
    assert [got[i]["contaminated"] for i in (0, 1, 2, 3, 4, 8, 9)] == [True, True, False, False, True, False, False]
    assert got[1]["tiles"] == 2 and got[1]["coverage"] == 1.0 and got[2]["coverage"] == 0.25
    assert {r["doc_id"] for r in decontamination.clean(rows, bench).collect()} == {2, 3, 8, 9}
    assert decontamination.assess(none, bench).count() == 0 and decontamination.clean(rows, bench.limit(0)).count() == 7


def test_decontamination_at_a_low_coverage(spark):
    rng = random.Random(4)
    item, noise = words(rng, 40), words(rng, 20, 10**6)
    bench = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    rows = spark.createDataFrame([(0, " ".join(item[:5] + noise[:9] + item[10:15] + noise[9:] + item[20:25]), "", "")], DOCS)
    (r,) = decontamination.assess(rows, bench, coverage=0.3).collect()
    assert r["contaminated"] and r["coverage"] == 0.375 and decontamination.clean(rows, bench, coverage=0.3).count() == 0


def test_bpe_equals_the_library(spark, docs, none):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.vocabulary()
    library = tokenizers.Tokenizer.from_file(path)
    extra = ["It's WE'LL <|endoftext|>don't stop", "Ὀδυσσεύς ΣΣ é café 中文 \U0001f44d\U0001f3fd 123", "a" * 300, "\x0b\x1c ​"]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"))
    given = {r["doc_id"]: r["text"] for r in rows.collect()}
    assert len(word_bpe.frequent_words(rows, path, "text", 2)) == 2  # ties at the cut
    for size in (0, 1000):  # all words merged; frequent words from the automaton
        for r in word_bpe.roundtrip(rows, path, lexicon=size).collect():
            ids = library.encode(given[r["doc_id"]] or "", add_special_tokens=False).ids
            assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert word_bpe.roundtrip(none, path).count() == 0


def test_bpe_equals_the_library_on_code_points_new_and_old():
    """The check over all code points finds none that differ; here every 31st, and those that Python does not know."""
    tokenizers = pytest.importorskip("tokenizers")
    library, words = tokenizers.Tokenizer.from_file(queries.vocabulary()), word_bpe.Words(word_bpe.Bpe(queries.vocabulary()), None)
    points = [*range(0, 0xD800, 31), *range(0xE000, 0x33480, 31), *range(0xE0000, 0xE0200, 31), 0x558, 0x58B, 0x88F, 0xC5C, 0x1C89, 0xA7CB, 0x10940, 0x10D50]
    texts = [f"x{chr(c)}1 {chr(c)}b\u0301{chr(c)}\u0316" for c in points] + ["\U0001f44d\U00010d50 " * 3_000]
    for text, e in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(words.encode(text), "<u4").tolist() == e.ids, ascii(text[:20])
    assert not words.unicode.unsettled("é 中文 \U0001f44d") and words.unicode.unsettled("\u1c89")


def test_bpe_of_batches_equals_the_library_and_merges_a_word_once(monkeypatch, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    library, bpe, rng = tokenizers.Tokenizer.from_file(queries.vocabulary()), word_bpe.Bpe(queries.vocabulary()), random.Random(8)
    known = sorted({w.encode() for w in ("the", "then", "é", "don", "'t", "!", *words(rng, 30))})
    word_bpe.Lexicon.build(known, map(bpe.merge, known), str(tmp_path / "lex"))
    lexicon = word_bpe.Lexicon(str(tmp_path / "lex"))
    assert lexicon.get_all([*known, b"", b"th", b"thex", b"zz", b"\xff"]) == [*map(bpe.merge, known), *[None] * 5]
    some = [bytes(rng.choice(b"abet'\xc3\xa9!") for _ in range(rng.randrange(1, 60))) for _ in range(5000)]
    assert bpe.merge_all(some) == list(map(bpe.merge, some))

    monkeypatch.setattr(word_bpe, "REMEMBERED", 300)
    merged, merge_all = Counter(), bpe.merge_all
    monkeypatch.setattr(bpe, "merge_all", lambda ws: merged.update(ws) or merge_all(ws))
    letters = "aeéÉ̖İΣσς'stTld1٣½.!-_ \n\t\x0b\x1c\x85　 Ᲊ\U00010d50中\U0001f44dÅÅ"
    for batch in range(40):
        texts = [None, "", " ", "\ń e ́x", "Unseenbefore, (unseenbefore) UNSEENBEFORE!", "a<|endoftext|>B's\n<|startoftext|> ́<|endoftext|>"]
        texts += ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(60)]
        texts += [" ".join(rng.choice(("the", "Then", "don't", "l'été", "x" * rng.randrange(1, 200), str(rng.random()))) for _ in range(rng.randrange(40))) for _ in range(20)]
        if not batch:
            held = word_bpe.Words(bpe, lexicon)
        ids = held.rows(pa.array([None, *texts], rng.choice((pa.string(), pa.large_string())))[1:])
        for text, found, decoded in zip(texts, ids, bpe.decode(ids), strict=True):
            want = library.encode(text or "", add_special_tokens=False).ids
            assert np.frombuffer(found, "<u4").tolist() == want, ascii(text)
            assert decoded.decode() == library.decode(want, skip_special_tokens=False), ascii(text)
    assert merged[b"unseenbefore"] == 1 and merged[b"the"] == 0 and len(held) + len(held.aside) < 2_000
    broken = [b"a\xe4\xb8 \xe4\xb8\xad\xff\xe4", b"\x80 \xc3", b"caf\xc3 <|endoftext|>\xe9"]
    for raw, found in zip(broken, held.rows(pa.array(broken).view(pa.string())), strict=True):
        assert np.frombuffer(found, "<u4").tolist() == library.encode(raw.decode("utf-8", "replace"), add_special_tokens=False).ids, raw
    assert bpe.decode([]) == held.rows(pa.array([], pa.string())) == []


def test_bpe_remembers_and_counts_within_bytes(monkeypatch):
    bpe, rng = word_bpe.Bpe(queries.vocabulary()), random.Random(5)
    monkeypatch.setattr(word_bpe, "REMEMBERED", 100_000)
    monkeypatch.setattr(word_bpe, "HELD", 100_000, raising=False)
    held, most = word_bpe.Words(bpe, None), 0
    some = [bytes(rng.choice(b"abcdefgh,;") for _ in range(60)) for _ in range(4000)]
    for k in range(0, 4000, 500):
        few = some[max(0, k - 100) : k + 500]
        assert held.rows(pa.array([run.decode() for run in few])) == [b"".join(map(bpe.merge, bpe.ascii_between(run))) for run in few]
        most = max(most, sum(map(sys.getsizeof, chain(held, held.values(), held.aside, held.aside.values()))))
    assert most < 2 * 100_000 + 2 * 600 * 350  # and twice the runs of a piece; all runs are over 700_000

    texts = [None, "", "The the THE, don't", *(" ".join(x.decode() for x in some[k : k + 50]) for k in range(0, 4000, 50)), "the " * 1000]
    want = Counter(w for t in texts for run in (t or "").lower().split() for w in bpe.words(bpe.normal(run)))
    got, rows = Counter(), 0
    for batch in word_bpe.counts([pa.array(texts[:40]), pa.array([], pa.string()), pa.array(texts[39:])[1:]], bpe):
        rows = max(rows, batch.num_rows)
        for w, n in zip(*batch.to_pydict().values(), strict=True):
            got[w.decode()] += n
    assert got == want and 10_000 < rows + len(want) and rows < len(want) / 2


def test_bpe_takes_a_batch_in_pieces(spark, monkeypatch):
    tokenizers = pytest.importorskip("tokenizers")
    library, rng = tokenizers.Tokenizer.from_file(queries.vocabulary()), random.Random(6)
    texts = [None, "", *(" ".join(words(rng, 150_000, 10**4)) for _ in range(3)), None, "é, end <|endoftext|>", ""]
    ids = [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    for r in word_bpe.roundtrip(rows, queries.vocabulary()).collect():
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids[r["doc_id"]], "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids[r["doc_id"]], skip_special_tokens=False).encode()).hexdigest()
    for size in (1, 1 << 20, 1 << 30):
        monkeypatch.setattr(word_bpe, "PIECE", size)
        for given in (pa.array(texts), pa.array(texts, pa.large_string())[1:], pa.array([None, None], pa.string()), pa.array([], pa.string())):
            cut = list(word_bpe.pieces(given))
            assert pa.chunked_array(cut, given.type).to_pylist() == given.to_pylist() and all(map(len, cut))
            assert all(len(x) == 1 or sum(len((t or "").encode()) for t in x.to_pylist()) <= size for x in cut)


def test_other_vocabulary_files_are_refused(tmp_path):
    with open(queries.vocabulary(), encoding="utf-8") as f:
        spec = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": None}, {"model": spec["model"] | {"byte_fallback": True}}):
        (tmp_path / "other.json").write_text(json.dumps(spec | change))
        with pytest.raises(ValueError, match=next(iter(change)) if "model" not in change else "byte_fallback"):
            word_bpe.Bpe(str(tmp_path / "other.json"))


def test_lexicon_is_exact_and_shares_endings(tmp_path):
    bpe = word_bpe.Bpe(queries.vocabulary())
    known = sorted({(a + b).encode() for a in ("walk", "talk", "jump", "é") for b in ("", "ed", "ing", "ings")})
    word_bpe.Lexicon.build(known, map(bpe.merge, known), str(tmp_path / "lex"))
    lexicon = word_bpe.Lexicon(str(tmp_path / "lex"))
    assert all(lexicon.get(w) == bpe.merge(w) for w in known)
    assert all(lexicon.get(w) is None for w in (b"", b"wal", b"walker", b"zz"))
    assert len(lexicon.final) < sum(map(len, known)) / 3


def test_pipeline_of_awkward_tables(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(13)
    good, shape = words(rng, 120, 10**6), "doc_id long, text string, lang string, source string, n_chars long"
    long = " ".join(words(rng, 30_000, 10**6))
    rows = [(1, " ".join(good), "en", None, 1), (1, " ".join(good), "en", None, 1), (2, None, None, None, None), (3, "", "en", "s", 0), (4, long, "en", "s", 1), (5, long, "en", "s", 1), (None, " ".join(words(rng, 100, 10**6)), "en", "s", 1)]
    for name, docs in (("full", rows), ("none", [])):
        at = str(tmp_path / name)
        spark.createDataFrame(docs, shape).write.parquet(at + "/documents.parquet")
        spark.createDataFrame([(1, None), (None, "x"), (2, " ".join(words(rng, 30)))], "item_id long, text string").write.parquet(at + "/benchmark.parquet")
        got = Counter(r["doc_id"] for r in corpus_pipeline.run(spark, at).collect())
        assert got == (Counter({1: 2, 4: 1, None: 1}) if docs else Counter())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(11)
    item = words(rng, 30)
    good = [words(rng, 120, 10**6) for _ in range(6)]
    texts = [" ".join(g) for g in good] + [" ".join(good[0]), " ".join(good[1] + ["x"]), " ".join(good[2][:60] + item + words(rng, 90, 10**6)), "too short", " ".join(w + "###" for w in good[3]), " ".join([*words(rng, 99, 10**6), 'token = "0123456789abcdef0123456789abcdef01234567"'])]
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, " ".join(item))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert {r["doc_id"] for r in docs.collect()} == {0, 1, 2, 3, 4, 5, 11}
    assert docs.filter("doc_id = 11").first()["text"].endswith("[SECRET]\"")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {0, 1, 2, 3, 4, 5, 11}

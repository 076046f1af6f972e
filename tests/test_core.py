import hashlib
import json
import math
import random
import re
import time
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glintscan.functions import text as fn
from glintscan.functions import validators
from glintscan.operators import extract, findings, scan
from glintscan.operators.ledger import Ledger
from glintscan.rules import catalog
from glintscan.rules.model import Rule
from glintscan.rules.samples import example
from glintscan.rules.translate import anchors, leading, least_run, to_java
from glintscan.sinks import writers
from glintscan.sources import cache, readers

KEY = "AKIA" + "ABCDEFGH234567MN"


def docs(spark, *rows):
    return spark.createDataFrame(list(rows), "source string, body string")


def test_all_rules_compile_and_match_in_java(spark):
    rules = catalog.built_in()
    assert len(rules) == 236 and len({r.id for r in rules}) == 236
    scan.matches(docs(spark, ("a", "nothing here: token secret key")), rules).count()
    java = spark.createDataFrame([(to_java(r.pattern),) for r in rules], "p string")
    assert java.select(F.rlike(F.lit("x"), F.col("p"))).count() == 236


@pytest.mark.parametrize("pattern, text, hit", [(r"\bkey", "ékey", True), (r"a\sb", "a\x0bb", False), (r"a.b", "a\rb", True), (r"a.b", "a\nb", False), (r"ab$", "ab\n", False), (r"(?i)key", "Key", True), (r"[a[b]+$", "[", True)])
def test_translation(spark, pattern, text, hit):
    assert spark.range(1).select(F.lit(text).rlike(to_java(pattern))).first()[0] is hit


def test_anchor_is_in_every_match():
    assert anchors(r"\bglpat-[0-9A-Za-z_\-]{20,40}\b") == ("glpat-",)
    assert anchors(r"(?i)(?:a|b)c") == () and set(anchors(r"\b(?:AKIA|ASIA|A3T[A-Z0-9])x")) == {"akia", "asia", "a3t"}
    for r in catalog.built_in():
        for seed in range(3):
            low = example(r.pattern, seed).lower()
            assert not anchors(r.pattern) or any(a in low for a in anchors(r.pattern)), r.id


def test_place_of_a_group():
    assert leading(r"(?i)ab([cd])", 1) == r"(?i)(ab)([cd])" and leading(r"a|b(c)", 1) is None and leading(r"(?:a(b))", 1) is None and leading(r"[(](x)", 1) == "([(])(x)"
    for r in catalog.built_in():
        if lead := leading(r.pattern, r.group):
            text = "..." + example(r.pattern) + " ..."
            a, b = re.search(r.pattern, text), re.search(lead, text)
            assert a.start(r.group) == b.end(1) and a[r.group] == b[r.group + 1]


def test_places_are_bytes_and_scores_follow_context(spark):
    rule = [r for r in catalog.built_in() if r.id == "aws.access_key_id"]
    rows = scan.scored(scan.matches(docs(spark, ("a", f"é = '{KEY}'"), ("b", f"\n\n  {KEY} example"), ("c", f"x{KEY}"), ("d", None), ("e", "")), rule)).orderBy("source").collect()
    assert [(r["source"], r["start"], r["line"], r["column"], round(r["confidence"], 4)) for r in rows] == [("a", 6, 1, 7, 0.95), ("b", 4, 3, 3, 0.65)]


def brute_matches(source, body, rules):
    """(id, value, byte offset, line, byte column) by Python's re, without comments in mind."""
    out = []
    for r in rules:
        for m in re.finditer(r.pattern, body, re.ASCII if "(?i" not in r.pattern else 0):
            g = r.group if r.group and m.group(r.group) else 0
            before = body[: m.start(g)]
            out.append((source, r.id, m[g], len(before.encode()), before.count("\n") + 1, len(before.rpartition("\n")[2].encode()) + 1))
    return out


def test_every_rule_against_python(spark):
    rules = catalog.built_in()
    rows = []
    for n, r in enumerate(rules):
        e = example(r.pattern, 5)
        rows += [(f"hit{n}", f"é\n a = '{e}';\n{e} {e[:-1]}"), (f"cut{n}", f"'{e[: len(e) // 2]}' x{e}x")]
    got = scan.matches(docs(spark, *rows).repartition(8), rules, comments=True).select("source", "id", "value", "start", "line", "column").collect()
    assert Counter(map(tuple, got)) == Counter(x for s, b in rows for x in brute_matches(s, b, rules))
    assert {r["id"] for r in got} == {r.id for r in rules}


def test_places_of_many_matches(spark):
    rng = random.Random(1)
    body = "".join(rng.choice(["k%03d" % rng.randrange(1000), " ", "é", "\n", "//# sourceMappingURL=k777"]) for _ in range(3000))
    rule = Rule("r", "r", "", "t", "low", r"k([0-9]{3})", group=1, prior=0.9)
    got = scan.scored(scan.matches(docs(spark, ("a", body)), [rule], comments=True)).orderBy("start").collect()
    raw, lines = body.encode(), body.split("\n")
    want = [(m.start(1), raw[: m.start(1)].count(b"\n") + 1, m.start(1) - (raw.rfind(b"\n", 0, m.start(1)) + 1) + 1) for m in re.finditer(rb"k([0-9]{3})", raw)]
    assert [(r["start"], r["line"], r["column"]) for r in got] == want and len(want) > 500
    for r in got:
        assert (r["drop_reason"] == "source_map_line") == ("sourceMappingURL=" in lines[r["line"] - 1])
        assert r["context"].encode() == raw[max(0, r["start"] - 96) : r["start"] + 3 + 96] or "\ufffd" in r["context"]


def test_findings_merge_by_value_and_type(spark):
    rule = [r for r in catalog.built_in() if r.id == "aws.access_key_id"]
    given = docs(spark, ("b", f"'{KEY}' '{KEY}'"), ("a", f"'{KEY}' example"))
    rows = findings.strict_matches(given, rule)
    (f,) = findings.with_locations(findings.merged(rows), findings.places(rows)).collect()
    assert (f["source"], round(f["confidence"], 2), [(x["source"], x["column"]) for x in f["locations"]]) == ("a", 0.95, [("a", 2), ("b", 2), ("b", 25)])
    assert findings.find(given, rule, ignore=[f"hash:{f['value_hash']}"]).count() == 0
    assert findings.find(given, rule, ignore=["rule:gitlab.*", "# note", ""]).count() == 1
    with pytest.raises(ValueError, match="line 1"):
        findings.ignored(["what"])


def test_comments_keep_offsets(spark):
    body = "a // b\n'x // y' /* c\nd */ e \"un // closed"
    out = spark.range(1).select(scan.without_comments(F.lit(body))).first()[0]
    assert out == "a     \n'x // y'     \n     e \"un // closed" and len(out) == len(body)


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(min_size=1, max_size=30), min_size=1, max_size=5))
def test_scalar_functions(spark, values):
    v = F.col("v")
    rows = spark.createDataFrame([(x,) for x in values], "v string").select("v", fn.entropy(v).alias("e"), fn.redact(v).alias("r"), fn.value_hash(v).alias("h"), fn.base62_crc32(v).alias("c"))
    for r in rows.collect():
        n = len(r["v"].encode())
        assert math.isclose(r["e"], -sum(k / n * math.log2(k / n) for k in Counter(r["v"]).values()), abs_tol=1e-9)
        c, digits = zlib.crc32(r["v"].encode()), ""
        for _ in range(6):
            c, d = divmod(c, 62)
            digits = fn.BASE62[d] + digits
        assert r["c"] == digits and len(r["h"]) == 16
        assert n > 8 or r["r"] == "*" * n


def test_globs():
    hit = lambda g, x: bool((p := catalog.glob_regex(g)) and re.search(p.replace(r"\z", r"\Z"), x))
    assert hit("*", "a/b") and hit("a*", "ab") and not hit("a*", "a/b") and hit("[a-c]x", "bx") and not hit("[^a]x", "ax") and not hit("[a", "a")


@pytest.mark.parametrize("pack", ['{}', '[{"id":"a"}]', '[{"id":"a","pattern":"(","severity":"high"}]', '[{"id":"a","pattern":"x","severity":"odd"}]', '[{"id":"a","pattern":"x","severity":"low","confidence_prior":2}]', '[{"id":"a","pattern":"x","severity":"low","group":1}]', '[{"id":"a","pattern":"x","severity":"low"},{"id":"a","pattern":"y","severity":"low"}]'])
def test_faulty_packs_are_refused(pack):
    with pytest.raises(ValueError):
        catalog.parse_pack(pack)


def test_pack_defaults():
    (r,) = catalog.parse_pack('[{"id":"a","pattern":"x","severity":"CRIT"}]')
    assert (r.severity, r.prior, r.kind) == ("critical", 0.55, "external")


def test_registry_covers_legacy(spark):
    rules = [r for r in catalog.built_in() if r.id in ("aws.access_key_id", "legacy:Aws Api Key")]
    both = docs(spark, ("a", f"k='{KEY}'"), ("b", f"k='{KEY}' example mock_"))
    told = {(r["source"], r["id"]): r["drop_reason"] for r in scan.assess(both, rules, min_confidence=0.7).collect()}
    assert told == {("a", "aws.access_key_id"): None, ("a", "legacy:Aws Api Key"): "covered", ("b", "aws.access_key_id"): "low_confidence", ("b", "legacy:Aws Api Key"): "low_confidence"}


def test_filters_of_legacy_matches(spark):
    rule = [catalog.legacy_rule("Hex", r"x([0-9a-f]{20,})"), next(r for r in catalog.built_in() if r.name == "Email")]
    own, h = "https://www.a.net/app.js", "0123456789abcdef0123"
    rows = [
        (own, f"u = 'https://cdn.b.org/x{h}'"), (own + "?1", f"u = 'https://cdn.a.net/x{h}'"), (own + "?2", f"p = 'font x{h}'"), (own + "?3", "m = 'joe@b.org'; n = 'joe@mail.a.net'; o = 'info@a.net'"),
        ("plain", f"u = 'https://cdn.b.org/x{h}'; m = 'joe@b.org'"), (own + "?4", f"y = '{'Z' * 60}x{h}{'Z' * 60}'"), (own + "?5", f"// x{h}\nz = 'x{h}';"),
    ]
    got = Counter((r["source"].replace(own, ""), r["value"], r["drop_reason"]) for r in scan.assess(docs(spark, *rows), rule).collect())
    want = [("", h, "foreign_address"), ("?1", h, None), ("?2", h, "encoded_media"), ("?3", "joe@b.org", "cross_domain"), ("?3", "joe@mail.a.net", None), ("?3", "info@a.net", "unwanted_email"), ("plain", h, None), ("plain", "joe@b.org", None), ("?4", h, "encoded_media"), ("?5", h, None)]
    assert got == Counter(want)
    kept = lambda **o: sorted(r["source"].replace(own, "") for r in scan.kept(scan.assess(docs(spark, *rows), rule[:1], **o)).collect())
    assert kept(domain="a.net") == ["?1", "?5"] and kept(extensions=[".js", "?1"]) == ["?1"] and kept(pattern="^0") == ["?1", "?5", "plain"] and kept(pattern="(") == [] and kept(internal=True) == []
    hashes = spark.createDataFrame([(hashlib.sha256(h.encode()).hexdigest()[:16],)], "value_hash string")
    assert findings.all_matches(docs(spark, *rows), rule[:1], known=hashes).count() == 0 and findings.all_matches(docs(spark, *rows), rule[:1], ignore=["rule:legacy:*"]).count() == 0


def strip(body):
    out, state, i = [], "", 0
    while i < len(body):
        c, two = body[i], body[i : i + 2]
        if not state and two in ("//", "/*"):
            out, state, i = [*out, "  "], two[1], i + 2
            continue
        if state == "*" and two == "*/":
            out, state, i = [*out, "  "], "", i + 2
            continue
        if state in ("/", "*"):
            out.append(c if c == "\n" else " " * len(c.encode()))
            state = "" if state == "/" and c == "\n" else state
        elif state and c == "\\":
            out.append(two)
            i += 2
            continue
        else:
            out.append(c)
            state = "" if state == c else c if not state and c in "\"'`" else state
        i += 1
    return "".join(out)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab/*\\\"'`\né😀"), max_size=60), min_size=1, max_size=40))
def test_comments_against_an_automaton(spark, bodies):
    rows = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", scan.without_comments(F.col("b")).alias("s")).collect()
    for r in rows:
        assert r["s"] == strip(r["b"]), r["b"]


@pytest.mark.parametrize("name, good, bad", [
    ("AWSSecretKey", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYabcdefghij", "a" * 40), ("StripeKey", "sk_live_" + "aB3" * 8, "sk_live_short"), ("SlackToken", "xoxb-123-456-" + "a1" * 10, "xoxb-12a-456-" + "a1" * 10),
    ("TwilioSK", "SK0123456789abcdef0123456789abcdef", "SK" + "0" * 32), ("JWT", "eyJhbGciOiJIUzI1NiJ9.eyJhIjoxfQ.x", "eyJhIjoxfQ.eyJhIjoxfQ.x"), ("AWSAccessKeyID", KEY, "AKIA" + "0" * 16),
])
def test_validators(spark, name, good, bad):
    rows = spark.createDataFrame([(good,), (bad,)], "x string").select(validators.valid(F.lit(name), F.col("x")).alias("v"), validators.approval(F.lit(name), F.col("x")).alias("a")).collect()
    assert [r["v"] for r in rows] == [True, False] and rows[0]["a"]


def test_github_checksum_and_user_validators(spark):
    body = "ghp_" + "a" * 30
    c, digits = zlib.crc32(body.encode()), ""
    for _ in range(6):
        c, d = divmod(c, 62)
        digits = fn.BASE62[d] + digits
    rows = spark.createDataFrame([(body + digits,), (body + "000000",)], "other string").select(validators.valid(F.lit("GitHubToken"), F.col("other")).alias("v")).collect()
    assert [r["v"] for r in rows] == [True, False]
    validators.register("Even", lambda v: F.length(v) % 2 == 0)
    try:
        rule = Rule("r", "r", "", "t", "low", r"k[0-9]+", prior=0.9, validator="Even")
        assert [r["value"] for r in scan.kept(scan.scored(scan.matches(docs(spark, ("a", "k1 k12")), [rule]))).collect()] == ["k1"]
    finally:
        validators.USER.clear()


def test_aws_pairs_and_reports(spark):
    secret = "wJalrXUtnFEMI/K7MDENG/bPxRfiCYabcdefghij"
    given = docs(spark, ("a", f"id = '{KEY}'\naws_secret_access_key = '{secret}'"), ("b", f"'{KEY}'"))
    rows = findings.strict_matches(given, catalog.built_in())
    found = findings.merged(rows)
    (pair,) = findings.aws_pairs(found).collect()
    assert (pair["source"], pair["akid"], pair["secret"]) == ("a", KEY, secret)
    (report,) = [json.loads(r["value"]) for r in writers.sarif(found, findings.places(rows), catalog.built_in()).collect()]
    run = report["runs"][0]
    assert report["version"] == "2.1.0" and len(run["tool"]["driver"]["rules"]) == 42 and {r["ruleId"] for r in run["results"]} <= {r["id"] for r in run["tool"]["driver"]["rules"]}
    places = sorted((r["ruleId"], p["artifactLocation"]["uri"], p["region"]["startLine"]) for r in run["results"] for p in [r["locations"][0]["physicalLocation"]])
    assert ("aws.access_key_id", "a", 1) in places and ("aws.access_key_id", "b", 1) in places and ("aws.secret_access_key", "a", 2) in places
    assert writers.sarif(found, findings.places(rows), catalog.built_in(), per_document=1).count() == len(places)
    assert json.loads(writers.sarif(found.limit(0), findings.places(rows).limit(0), []).first()["value"])["runs"][0]["results"] == []
    every = findings.all_matches(given, catalog.built_in())
    told = {r["source"]: json.loads(r["value"]) for r in writers.envelope(every, found, findings.places(rows)).collect()}
    assert set(told) == {"a", "b"} and told["b"]["findings"] == [] and told["a"]["schema_version"] == 2 and told["a"]["tool"]["name"]
    assert {f["rule_id"] for f in told["a"]["findings"]} == {r["id"] for r in rows.collect()} and "AWS" in " ".join(told["b"]["matches"])
    assert KEY not in str(told) and KEY in str(writers.envelope(every, found, findings.places(rows), values=True).collect())
    assert "URL: b\nSensitive Data" in "".join(r["value"] for r in writers.text_blocks(rows).collect())
    assert sorted(r["value"] for r in writers.robots_lines(spark.createDataFrame([("https://h/", "allow", "/a"), ("https://h", "sitemap", "s")], "host string, kind string, path string")).collect()) == ["Allow    https://h/a", "Sitemap  s"]
    assert json.loads(writers.explained(spark, catalog.built_in()).filter("rule_id = 'aws.access_key_id'").first()["value"])["has_validator"]


def test_a_run_from_responses_to_views(spark):
    from glintscan.plans import runs

    page = f"<html><script>k = '{KEY}'</script><script> </script><p>x</p></html>"
    map_ = '{"version":3,"sources":["s.js"],"sourcesContent":["id = \'%s\'"]}' % KEY
    js, html = {"CONTENT-type": "text/javascript; charset=x"}, {"content-TYPE": "text/html"}
    rows = [("https://h/a.js", 200, js, f"a = '{KEY}'\n//# sourceMappingURL=a.map"), ("https://h/a.map", 200, {"x": "y"}, map_), ("https://h/p", 200, html, page), ("https://h/b.js", 404, js, KEY), ("https://h/c.js", 200, html, KEY), ("https://h/d.js", 200, {}, "eval('x = 1')")]
    responses = spark.createDataFrame(rows, "url string, status int, headers map<string,string>, body string")
    assert sorted(r["source"] for r in runs.documents(responses).collect()) == ["https://h/a.js", "https://h/d.js"]
    every = runs.documents(responses, inline_html=True, source_maps=True, eval_strings=True)
    assert sorted(r["source"] for r in every.collect()) == ["https://h/a.js", "https://h/a.js.map#s.js", "https://h/c.js", "https://h/d.js", "https://h/d.js#eval", "https://h/p", "https://h/p#inline[0]"]
    use = runs.rules(only=["aws.*"], jwt=True)
    assert {r.id for r in use if r.kind != "legacy"} == {"aws.access_key_id", "aws.secret_access_key"} and any(r.name == "JWT Token" for r in use)
    runs.views(every, use, ignore=["source:https://h/c.js"])
    (f,) = spark.sql("SELECT rule_id, places FROM scan_findings").collect()
    assert tuple(f) == ("aws.access_key_id", 4) or f["places"] >= 3
    assert spark.sql("SELECT count(*) AS n FROM scan_rules").first()["n"] == len(use)


def test_crawl_levels_and_scope(spark):
    from glintscan.sources import readers

    pages = spark.createDataFrame([("https://a.net/", '<script src="/x.js"></script><script src="//b.org/y.js"></script>'), ("https://a.net/x.js", 'href="z.js?v=1" src="/x.js"'), ("https://b.org/y.js", 'src="/w.js"')], "url string, html string")
    seeds = spark.createDataFrame([("https://a.net/",)], "url string")
    found = lambda *a, **o: {tuple(r) for r in readers.crawl(pages, seeds, *a, **o).collect()}
    assert found(2) == {("https://a.net/", 0), ("https://a.net/x.js", 1), ("https://b.org/y.js", 1), ("https://a.net/z.js?v=1", 2), ("https://b.org/w.js", 2)}
    assert found(2, "a.net", extensions=(".js",)) == {("https://a.net/", 0), ("https://a.net/x.js", 1)}


def test_waits(spark):
    now = F.to_timestamp(F.lit("2024-01-01 00:00:00"))
    rows = [("30", 30), ("Mon, 01 Jan 2024 00:01:30 GMT", 90), ("Mon, 01 Jan 2023 00:00:00 GMT", 0), ("soon", 0), ("-5", 0), (None, 0)]
    got = spark.createDataFrame([(v,) for v, _ in rows], "v string").select(fn.retry_after(F.col("v"), now).alias("s")).collect()
    assert [r["s"] for r in got] == [s for _, s in rows]
    waits = spark.range(-1, 9).select(fn.backoff(F.col("id"), F.lit(0.0)).alias("a"), fn.backoff(F.col("id"), F.lit(1.0)).alias("b")).collect()
    assert [r["a"] for r in waits[:3]] == [0.75, 0.75, 1.5] and waits[-1]["b"] == 80.0


def test_rules_held_are_those_that_match(spark):
    """The one look for literals and runs leaves out no rule, whatever the case, and none is named twice."""
    rules = catalog.built_in()
    bodies = [example(r.pattern, seed) for r in rules for seed in (1, 2)]
    bodies += [f"x {b} y".swapcase() for b in bodies[::3]] + [b.replace("s", "ſ").replace("k", "\u212a") for b in bodies[::2]]
    bodies += ["", "+49123456789", "a@b.cd", "A" * 40, "vercel_" + "aB3" * 8, None]
    docs = spark.createDataFrame(list(enumerate(bodies)), "i long, _b string").repartition(4)
    folded = docs.withColumn("_l", F.replace(F.lower("_b"), F.lit("ſ"), F.lit("s")))
    plain = F.array_compact(F.array(*(F.when(F.col("_b").rlike(to_java(r.pattern)), F.lit(n)) for n, r in enumerate(rules))))
    rows = folded.select("i", F.expr(scan._which(rules)).alias("got"), plain.alias("want")).filter("_b is not null").collect()
    assert len(rows) == len(bodies) - 1 and all(r["got"] == r["want"] for r in rows) and sum(len(r["got"]) for r in rows) > 400


def test_least_runs():
    for pattern, want in ((r"\b[MN][A-Za-z\d]{23,25}\.[\w-]{6}", 24), (r"SK[0-9a-fA-F]{32}", 34), (r"(?:ab|[^c]{9})[a-z_]{9}", 0), (r"(?:abc|x[0-9]{9})", 3), (r"(?:[a-z]{4}){3}", 4)):
        assert least_run(pattern) == want


def walked_scripts(html):
    """Inline scripts by a plain walk over a page, letter by letter: (number, text)."""
    white, out, i, number, low = " \n\r\t\f", [], 0, 0, html.lower()

    def tag(i):
        """Place after the tag whose attributes begin at i (none: unfinished), and its attributes."""
        found = {}
        while True:
            while i < len(html) and html[i] in white + "/":
                i += 1
            if i >= len(html):
                return None, found
            if html[i] == ">":
                return i + 1, found
            start = i
            while i < len(html) and html[i] not in white + "/>" and (html[i] != "=" or i == start):
                i += 1
            key, value, j = low[start:i], "", i
            while j < len(html) and html[j] in white:
                j += 1
            if j < len(html) and html[j] == "=":
                j += 1
                while j < len(html) and html[j] in white:
                    j += 1
                if j >= len(html):
                    return None, found
                if html[j] in "'\"":
                    end = html.find(html[j], j + 1)
                    if end < 0:
                        return None, found
                    value, i = html[j + 1 : end], end + 1
                else:
                    i = j
                    while i < len(html) and html[i] not in white + ">":
                        i += 1
                    value = html[j:i]
            found[key] = value

    def ends(i, name):
        return low.startswith(f"</{name}", i) and i + len(name) + 2 < len(html) and html[i + len(name) + 2] in white + "/>"

    while (i := html.find("<", i)) >= 0:
        nxt = low[i + 1 : i + 2]
        if low.startswith("<!--", i):
            if html[i + 4 : i + 5] == ">" or html[i + 4 : i + 6] == "->":
                i = html.index(">", i) + 1
                continue
            at = [x for x in (html.find("-->", i + 4), html.find("--!>", i + 4)) if x >= 0]
            if not at:
                break
            i = html.index(">", min(at)) + 1
        elif nxt in ("!", "?") or nxt == "/" and not (low[i + 2 : i + 3].isascii() and low[i + 2 : i + 3].isalpha()) and low[i + 2 : i + 3]:
            i = html.find(">", i) + 1
            if not i:
                break
        elif nxt == "/" and low[i + 2 : i + 3] or nxt.isascii() and nxt.isalpha():
            start = i + 1 + (nxt == "/")
            j = start
            while j < len(html) and html[j] not in white + "/>":
                j += 1
            name = low[start:j]
            i, attributes = tag(j)
            if i is None:
                break
            if nxt == "/":
                continue
            if name == "script":
                k, deep, hidden = i, False, False
                while k < len(html):
                    if not hidden and low.startswith("<!--", k):
                        hidden, k = True, k + 2
                    elif hidden and low.startswith("-->", k):
                        hidden, deep, k = False, False, k + 3
                    elif hidden and not deep and low.startswith("<script", k) and html[k + 7 : k + 8] and html[k + 7] in white + "/>":
                        deep, k = True, k + 7
                    elif deep and ends(k, name):
                        deep, k = False, k + 8
                    elif ends(k, name):
                        break
                    else:
                        k += 1
                after = tag(k + 8)[0] if k < len(html) else None
                if not attributes.get("src") and html[i - 2] != "/":
                    if after and html[i:k].strip():
                        out.append((number, html[i:k].replace("\r\n", "\n").replace("\r", "\n")))
                    number += 1
                if not after:
                    break
                i = after
            elif name in ("iframe", "noembed", "noframes", "style", "textarea", "title", "xmp", "plaintext"):
                while i < len(html) and (name == "plaintext" or not ends(i, name)):
                    i += 1
        else:
            i += 1
    return out


HTML = (
    """<!-- <script>var old=1</script> --><script data-x="a>b">var n=2</script><textarea><script>t()</script></textarea><title></title><script>z</script>""",
    "<script src=a.js></script><script/>gone()</script><script src='' >a<b</script ><SCRIPT\n>c</ScRiPt x='>'>d", "<script>open('</scriptx>')", "<script>x</script", "<p a='<script>1</script>'>",
    "<script><!-- <script>a</script> b --> c</script>d<script>e<!--f</script>", "<!--><script>1</script><!---><script>2</script><!-- a --!><script>3</script>", "<a b=\"<script>1</script>", "a < b <3 <script>q\r\nr</script>",
    "<plaintext><script>1</script>", "<style><script>1</script></style><script> \n</script><script>k</script>", "<?x <script>1</script>", "</ <script>1</script><script>2</script>", "<script x/>1</script>", "", "<",
)


def test_inline_scripts_against_a_walk(spark):
    rng = random.Random(5)
    parts = ["<script>", "</script>", "<script src=a>", "<script a='>' b=\"'\">", "<!--", "-->", "--!>", "<title>", "</title>", "<textarea x>", "</textarea >", "<p a=b>", "</p>", "'", '"', ">", "<", "x", " ", "=", "<script/>", "<!x>", "</SCRIPT\n>", "\r\n"]
    pages = [*HTML, *("".join(rng.choice(parts) for _ in range(rng.randrange(1, 16))) for _ in range(3000)), "<script>" + "a<b;<!--x-->'" * 40000 + "</script>" + "<i a=b c='d'>" * 20000]
    rows = spark.createDataFrame([(f"{i}:", p) for i, p in enumerate(pages)] + [("n:", None)], "url string, html string").repartition(4)
    got = {(r["source"], r["body"]) for r in extract.inline_scripts(rows).collect()}
    want = {(f"{i}:#inline[{n}]", body) for i, p in enumerate(pages) for n, body in walked_scripts(p)}
    assert {p for p in (got ^ want)} == set()
    assert ("0:#inline[0]", "var n=2") in got and ("0:#inline[1]", "z") in got


def test_attributes(spark):
    html = """<meta http-equiv='Content-Security-Policy' content="default-src 'self'; script-src a.com?x&amp;y"><!-- <meta http-equiv=content-security-policy content=b> --><link rel=MODULEPRELOAD href=&#x2f;d&#46;js><script SRC="x>y" src=last async></script>"""
    pages = spark.createDataFrame([("u", html)], "url string, html string")
    assert [r["policy"] for r in extract.meta_policies(pages).collect()] == ["default-src 'self'; script-src a.com?x&y"]
    assert [(r["kind"], r["reference"], r["is_async"]) for r in extract.script_references(pages).collect()] == [("modulepreload", "/d.js", False), ("script", "last", True)]


def test_ledger_is_what_one_batch_gives(spark, tmp_path):
    rng = random.Random(8)
    pool = [f"token {'ab'[k % 2]}{k:03d}" for k in range(12)]
    rule = Rule("x.token", "X", "X", "token", "high", r"token ([ab][0-9]{3})", group=1, prior=0.9, kind="external")
    rows = [(f"s{i}", " ; ".join(rng.choices(pool, k=rng.randrange(4)))) for i in range(60)] + [("s1", pool[0]), ("e", ""), ("n", None)]
    every = docs(spark, *rows)
    want = sorted(map(str, findings.find(every, [rule]).collect()))
    for order, compact in (((0, 1, 2), ()), ((2, 1, 1, 0, 2), (1, 3)), ((1, 0, 2, 0), (0, 1, 2, 3))):
        ledger = Ledger(spark, str(tmp_path / f"ledger{order}"))
        with pytest.raises(ValueError):
            ledger.findings()
        ledger.compact()
        for step, batch in enumerate(order):
            ledger.write(findings.strict_matches(docs(spark, *rows[batch::3]), [rule]), batch)
            if step in compact:
                ledger.compact()
        assert sorted(map(str, ledger.findings().collect())) == want
        assert ledger.places().count() == sum(r["places"] for r in ledger.findings().collect())
    # as the sink of a stream, whose batches come again
    for k in range(3):
        docs(spark, *rows[k::3]).coalesce(1).write.parquet(str(tmp_path / "in" / f"f{k}"))
    ledger = Ledger(spark, str(tmp_path / "stream"))
    for _ in range(2):
        stream = spark.readStream.schema("source string, body string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        stream.writeStream.foreachBatch(ledger.sink([rule])).option("checkpointLocation", str(tmp_path / f"c{_}")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(str, ledger.findings().collect())) == want


def test_cache(spark):
    schema = "url string, status int, headers map<string,string>, body string, fetched_at timestamp"
    rounds = spark.createDataFrame([
        (1, "a", 200, {"ETAG": "1"}, "A", "2024-01-01"), (1, "b", 200, {"Set-Cookie": "x"}, "B", "2024-01-01"), (1, "c", 200, {}, "", "2024-01-01"), (1, "d", 404, {}, "D", "2024-01-01"),
        (1, "e", 200, {"Last-Modified": "then"}, "E", "2024-01-01"), (1, "e", 200, {"etag": "2"}, "E2", "2024-01-02"), (1, None, 200, {}, "N", "2024-01-01"), (1, "f", 200, None, "F", "2024-01-01"),
        (2, "a", 304, {}, None, "2024-01-05"), (2, "b", 304, {}, None, "2024-01-05"), (2, "e", 200, {}, "E3", "2024-01-05"), (2, "z", 200, {}, "Z", "2024-01-05"),
    ], "n int, url string, status int, headers map<string,string>, body string, day string").withColumn("fetched_at", F.to_timestamp("day"))
    one, two = (rounds.filter(F.col("n") == n).select(*(f.split()[0] for f in schema.replace("map<string,string>", "map").split(", "))) for n in (1, 2))
    first = cache.refreshed(spark.createDataFrame([], cache.SCHEMA), one)
    assert {(r["url"], r["body"]) for r in first.collect()} == {("a", "A"), ("e", "E2"), (None, "N"), ("f", "F")}
    asked = {tuple(r) for r in cache.conditions(spark.createDataFrame([("a",), ("e",), ("q",)], "url string"), first).collect()}
    assert asked == {("a", "1", None), ("e", "2", None), ("q", None, None)}
    assert {tuple(r) for r in cache.served(two, first).collect()} == {("a", "A", True), ("e", "E3", False), ("z", "Z", False)}
    later = cache.refreshed(first, two, F.to_timestamp(F.lit("2024-01-06")), "2 days")
    assert {(r["url"], r["body"]) for r in later.collect()} == {("a", "A"), ("e", "E3"), ("z", "Z")}
    assert cache.refreshed(first, two).count() == 5


def test_cache_of_pages_that_share_an_address(spark, tmp_path):
    from glintscan.plans import queries

    spark.createDataFrame([(3, "u", "a"), (8, "u", "b"), (13, None, "c")], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = Counter(map(tuple, queries.cache_rounds(spark, str(tmp_path)).collect()))
    assert got == Counter((n, url, hashlib.sha256(f"0{html}".encode()).hexdigest(), n > 0) for n in range(3) for url, html in (("u", "a"), ("u", "b"), (None, "c")))


def test_parameters_of_pages_that_share_an_address(spark, tmp_path):
    from glintscan.plans import queries

    spark.createDataFrame([(1, "http://a/?p=1"), (2, "http://a/?p=1"), (3, "http://a/?p=2"), (4, None), (5, None)], "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    assert {tuple(r) for r in queries.parameter_names(spark, str(tmp_path)).collect()} == {("http", 2), ("p", 2)}


def test_ignore_tables_are_the_lists_of_conditions(spark):
    rng = random.Random(9)
    rules = [Rule(f"p{k % 3}.r{k}", "n", "p", "t", "low", "x") for k in range(9)]
    word = lambda n: "".join(rng.choice("ab/.") for _ in range(n))
    glob = lambda: "".join(rng.choice(["a", "b", "/", ".", "*", "?", "[ab]", "[", "\\a", "a" * 9]) for _ in range(rng.randrange(1, 6)))
    rows = [(rng.choice(rules).id, word(rng.randrange(0, 9)) + "a" * rng.choice([0, 0, 30]), word(rng.randrange(0, 6)), f"h{rng.randrange(30)}") for _ in range(400)] + [("p0.r0", None, None, None)]
    found = spark.createDataFrame(rows, "id string, source string, value string, value_hash string")
    lines = ["", "# x", "hash:h3", " hash:h4 ", "hash:none", "rule:p1.*5", "rule:[", "source:" + "a" * 33] + [f"source:{glob()}" for _ in range(15)] + [f"rule_value:{r}:{glob()}" for r in ("p*", "*", "p0.r3", "[", "p?.r[12]") for _ in range(6)]
    for use in (lines, lines[:1], lines[5:6]):
        table = findings.ignore_table(spark.createDataFrame([(x,) for x in use], "value string"))
        got = Counter(map(tuple, findings.unignored(found, table, rules).collect()))
        assert got == Counter(map(tuple, found.filter(~F.coalesce(findings.ignored(use), F.lit(False))).collect()))
    with pytest.raises(Exception, match="no ignore entry"):
        findings.ignore_table(spark.createDataFrame([("nonsense",)], "value string")).collect()
    began = time.time()
    many = findings.ignore_table(spark.range(100_000).select(F.concat(F.lit("source:https://h"), F.col("id").cast("string"), F.lit("/*.js")).alias("value")))
    findings.unignored(found, many, rules)._jdf.queryExecution().executedPlan()
    assert time.time() - began < 5 and findings.unignored(found, many, rules).count() == len(rows)


def test_unknown_is_the_plain_anti_join(spark, monkeypatch):
    known = spark.range(20_000).select(F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16).alias("value_hash")).union(spark.createDataFrame([(None,), ("x",), ("x",)], "value_hash string"))
    rows = spark.range(15_000, 60_000).select("id", F.when(F.col("id") % 1000 != 0, F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 16)).alias("value_hash"))
    want = {r["id"] for r in rows.join(known, "value_hash", "left_anti").collect()}
    for most in (findings.BITMAP_BYTES, 1):  # with the bitmap; without
        got = [r["id"] for r in findings.unknown(rows, known, most).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert findings.unknown(rows, known.limit(0)).count() == 45_000
    # with few known values only few new rows go to the exact join
    maybe = findings.unknown(rows.filter("id >= 20000 and value_hash is not null"), known)._jdf.queryExecution().optimizedPlan().toString()
    assert "_maybe" in maybe or "getbit" in maybe.lower()


def test_what_a_match_needs_is_computed_once(spark):
    keys = [r for r in catalog.built_in() if r.id in ("aws.access_key_id", "legacy:Aws Api Key")]
    rows = scan.assess(docs(spark, ("s", f"'{KEY}'"), ("t", f"'{KEY}' // example '{KEY}'"), ("u", f"'{KEY}' {KEY[:-2]}'{KEY}'")), keys)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    # once in the plan; lambda functions repeat what is named twice in them
    assert plan.count("LOG2") == 1 and plan.count("lower(") <= 4 and len(plan) < 25_000
    told = Counter((r["source"], r["kind"], r["start"], r["drop_reason"]) for r in rows.collect())
    assert told == Counter((s, kind, start, "covered" if kind == "legacy" else None) for s, at in (("s", [1]), ("t", [1]), ("u", [1, 42])) for start in at for kind in ("registry", "legacy"))


def test_context_is_cut_by_bytes(spark):
    body = "é" * 150 + " token ab123 " + "😀" * 30 + " token cd456 x" + "é" * 60
    rule = Rule("x.token", "X", "X", "token", "high", r"token ([a-z0-9]+)", group=1, prior=0.9, kind="external")
    raw = body.encode()
    for r in scan.matches(docs(spark, ("s", body)), [rule], comments=True).select("value", "start", F.hex("before").alias("b"), F.hex("after").alias("a"), F.hex("context").alias("c")).collect():
        end = r["start"] + len(r["value"])
        assert (bytes.fromhex(r["b"]), bytes.fromhex(r["a"])) == (raw[max(0, r["start"] - 200) : r["start"]], raw[end : end + 96])
        assert bytes.fromhex(r["c"]) == raw[max(0, r["start"] - 96) : end + 96]


def test_counters_of_the_same_job(spark):
    rule = Rule("x.token", "X", "X", "token", "high", r"token ([ab0-9]+)", group=1, prior=0.9, min_len=4, kind="external")
    rows = scan.assess(docs(spark, ("s", "token a123 token b1 token a123"), ("t", "token b777 // example"), ("u", None)), [rule], comments=True)
    found, counts = findings.find_counted(rows)
    assert found.count() == 2
    assert counts() == findings.counters(rows).first().asDict() and counts()["findings"] == 3


def test_bodies_that_hide_something(spark):
    bodies = [r"a\x41\u0042", "x" * 1001 + r"\x41" * 51, "x" * 900 + r"\x41" * 20, "eval(" + "String.fromCharCode(1)," * 11, "eval(" + "String.fromCharCode(1)," * 10, ""]
    rows = spark.createDataFrame(list(enumerate(bodies)), "i int, b string").select("i", extract.obfuscated(F.col("b")).alias("o"), extract.unescaped(F.col("b")).alias("u")).orderBy("i").collect()
    assert [r["o"] for r in rows] == [False, True, False, True, False, False] and rows[0]["u"] == "a410042"


def test_kinds_of_lines(spark):
    kind = lambda *lines: readers.line_kinds(spark.createDataFrame([(x,) for x in lines], "value string")).first()["kind"]
    assert kind("https://a/b.js", " http://c ", "plain", "") == "urls" and kind("https://a", "plain") == "lines"
    assert kind("function f() {", "x") == "code" and kind(*["let a = 1;"] * 6) == "code" and kind(*["let a = 1;"] * 5) == "lines"


def test_counters_of_responses_and_liveness(spark):
    answers = spark.createDataFrame([("a", 200, "xyz"), ("b", 403, ""), ("c", 429, "éé"), ("d", 200, None)], "url string, status int, body string")
    assert tuple(findings.fetch_counters(answers, 3).first()) == (4, 2, 1, 6)
    assert tuple(findings.fetch_counters(answers.limit(0)).first()) == (0, 0, 0, 0)
    told = [("stripe.secret_key", True, ""), ("stripe.secret_key", False, "timeout"), ("slack.app_token", False, None), ("no.such", True, "")]
    results = spark.createDataFrame(told, "rule_id string, alive boolean, error string")
    assert tuple(findings.verify_counters(results).first()) == (3, 1, 1, 1)


def test_script_references(spark):
    html = """<script async src='/a.js' integrity="sha" ></script><script>1</script><SCRIPT SRC=b.js defer></SCRIPT><link rel="preload" as="script" href="c.js"><link rel=modulepreload href='d.js'><link rel="preload" as="font" href="e.woff"><script data-src="x">2</script>"""
    rows = extract.script_references(spark.createDataFrame([("u", html)], "url string, html string")).collect()
    assert [(r["kind"], r["reference"], r["integrity"], r["is_async"], r["is_defer"]) for r in rows] == [("script", "/a.js", "sha", True, False), ("script", "b.js", None, False, True), ("preload", "c.js", None, False, False), ("modulepreload", "d.js", None, False, False)]


def test_parameter_groups_split_at_gap(spark):
    body = "params.get('a')" + " " * 184 + "params.get('b')" + " " * 185 + "params.get('c')"
    rows = extract.parameter_groups(docs(spark, ("u", body))).orderBy("group_no").collect()
    assert [r["parameters"] for r in rows] == [["a", "b"], ["c"]]


def test_option_addresses(spark):
    call = "axios.put('/a?x=1', {\n params: {z: 1, b-c: 2}})"
    rows = extract.option_addresses(docs(spark, ("http://h.example/s.js", call + call), ("plain", call), ("plain2", "axios.get('http://o.org/p', {params: {q: 1}})"), ("n", None))).collect()
    assert sorted(map(tuple, rows)) == [("http://h.example/s.js", "http://h.example/a?x=1&b-c=&z="), ("plain2", "http://o.org/p?q=")]


def test_self_test(spark):
    rules = [r for r in catalog.built_in() if r.id == "aws.access_key_id"]
    ex = spark.createDataFrame([("aws.access_key_id", "tp", KEY), ("aws.access_key_id", "fp", "AKIA" + "IOSFODNN7EXAMPLE")], "rule_id string, kind string, value string")
    assert findings.self_test(ex, rules).first()["ok"]


def test_private_targets_are_refused(spark):
    urls = ["http://a.example", "http://localhost/x", "https://10.1.2.3", "ftp://a.b", "http://172.20.0.1:80/", "https://172.40.0.1"]
    rows = spark.createDataFrame([(u,) for u in urls], "u string").select("u", fn.public_target(F.col("u")).alias("ok")).collect()
    assert [r["ok"] for r in rows] == [True, False, False, False, False, True]


def test_breaker_stream(spark, tmp_path):
    from glintscan.streaming import streams

    rows = [("h", f"2024-01-01 00:00:{i:02d}", 500, None) for i in range(6)] + [("g", "2024-01-01 00:00:00", 404, None)]
    spark.createDataFrame(rows, "host string, ts string, status int, retry_after_s int").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("host string, ts timestamp, status int, retry_after_s int").parquet(str(tmp_path / "in"))
    q = streams.breaker(stream).writeStream.format("memory").queryName("breaker").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    told = spark.table("breaker").orderBy("host", "ts").collect()
    assert [r["benched"] for r in told] == [False, False, False, False, False, True, True]


def test_scan_stream_dedupes(spark, tmp_path):
    from glintscan.streaming import streams

    rule = Rule("r", "r", "", "t", "low", r"k[0-9]{3}", prior=0.9)
    docs(spark, ("a", "k123 k123"), ("b", "k123 k456")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("source string, body string").parquet(str(tmp_path / "in"))
    q = streams.scan(stream, [rule]).writeStream.format("memory").queryName("scanned").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["value"] for r in spark.table("scanned").collect()) == ["k123", "k456"]


def test_hit_behind_32_mib(spark):
    from glintscan.sources import readers

    rule = [r for r in catalog.built_in() if r.id == "aws.access_key_id"]
    long = spark.range(1).select(F.lit("a").alias("source"), F.concat(F.repeat(F.lit(" "), 33 << 20), F.lit(f"'{KEY}'")).alias("body"))
    assert [r["start"] for r in scan.matches(long, rule).select("start").collect()] == [(33 << 20) + 1]
    cut = readers.limited(docs(spark, ("a", "12345"), ("b", "123")), 4).orderBy("source").collect()
    assert [(r["body"], r["truncated"]) for r in cut] == [("1234", True), ("123", False)]


def test_built_in_rules_reach_findings_and_sinks(spark, tmp_path):
    from glintscan.plans import queries

    texts = [f"x\nid = '{KEY}'", 'token = "0123456789abcdef0123456789abcdef01234567"', "nothing"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    places = {(f"doc://{i}", t[: m.start()].count("\n") + 1, m.start() - t.rfind("\n", 0, m.start())) for i, t in enumerate(texts) for m in re.finditer("AKIA[A-Z2-7]{16}", t)}
    found = {r["rule_id"]: r for r in queries.all_findings(spark, str(tmp_path)).collect()}
    assert {"aws.access_key_id", "doc.token"} <= set(found)
    assert found["aws.access_key_id"]["places"] == len(places)
    (report,) = [json.loads(r["value"]) for r in queries.sarif_documents(spark, str(tmp_path)).collect()]
    at = [(r["ruleId"], r["locations"][0]["physicalLocation"]) for r in report["runs"][0]["results"]]
    assert {(p["artifactLocation"]["uri"], p["region"]["startLine"], p["region"]["startColumn"]) for i, p in at if i == "aws.access_key_id"} == places
    assert [r["rule_id"] for r in queries.pack_findings(spark, str(tmp_path)).collect()] == ["doc.token"]


def test_stream_by_event_time(spark, tmp_path):
    from glintscan.streaming import streams

    rule = Rule("r", "r", "", "t", "low", r"k[0-9]{3}", prior=0.9)
    shape = "source string, body string, ts timestamp"

    def put(n, *rows):
        spark.createDataFrame(list(rows), "source string, body string, ts string").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{n}"))

    put(1, ("a", "k123", "2024-01-01 00:00:00"), ("b", "k123", "2024-01-01 00:10:00"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in/*"))
    q = streams.scan(stream, [rule], event_time="ts", delay="1 hour").writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    put(2, ("c", "k123 k777", "2024-01-02 00:00:00"))
    q.processAllAvailable()
    put(3, ("d", "k888", "2024-01-01 01:00:00"), ("e", "k999", "2024-01-02 00:01:00"), ("f", "k123", "2024-01-02 00:02:00"))
    q.processAllAvailable()
    q.stop()
    told = sorted((r["source"], r["value"]) for r in spark.table("timed").collect())
    assert ("e", "k999") in told and ("d", "k888") not in told and sum(v == "k123" for _, v in told) == 2


def test_policy_of_many_sources(spark):
    policy = "script-src " + " ".join(f"https://h{i}.net" for i in range(1500)) + "; img-src;; font-src https://f.net"
    rows = extract.csp_origins(spark.createDataFrame([("a", policy)], "source string, policy string")).orderBy("position").collect()
    assert [r["origin"] for r in rows] == [f"https://h{i}.net" for i in range(1500)] + ["https://f.net"]

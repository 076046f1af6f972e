"""Matches of rules in documents, with places, scores and reasons.

Rules stay data. Literal patterns tell which rules a document holds; only those are matched inside the row, so a
document is read once and never multiplied by the rules. What comes out is one row for each match, kept or
dropped; findings, statistics and reports are projections of it. Whatever looks at all matches of a document
(is a value covered by a stricter rule?) is decided inside the row too, without a join or a shuffle.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from dataclasses import asdict
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions.arrays import each, once, running
from glintscan.functions.text import base_domain, classes, entropy, host, redact, value_hash
from glintscan.functions.validators import approval, valid
from glintscan.rules import noise
from glintscan.rules.model import Rule
from glintscan.rules.translate import anchors, fragments, leading, least_run, to_java

# Version of reports, least confidence, default cap of fetched bodies, bytes of context.
SCHEMA_VERSION = 2
MIN_CONFIDENCE, MAX_BYTES, WINDOW = 0.50, 32 << 20, 96
FOREIGN_WINDOW, MEDIA_WINDOW = 50, 200
# What marks encoded media near a match, words of placeholder addresses, and of internal ones.
MEDIA = (
    "data:image", "data:video", "data:audio", "base64,", "data:application/octet-stream", "png", "jpg", "jpeg", "gif", "webp", "svg", "mp4", "webm", "ogg", "wav", "mp3",
    "font", "woff", "woff2", "ttf", "otf", "modernizr", "polyfill", "encoded", "binary",
)
PLACEHOLDERS = (
    "servername", "hostname", "domain.com", "example.com", "example.org", "yourserver", "yourdomain", "localhost", "127.0.0.1", "0.0.0.0",
    "server.com", "host.com", "domain.org", "site.com", "mydomain.com", ":port/", "accounturl", "username", "password", "${", "%{", "{{", "<%",
)
INTERNAL = ("internal", "private", "127.0.0.1", "localhost")
LINK = "Link/URL"
_RULE = "struct<n:int,id:string,name:string,provider:string,secret_type:string,severity:string,java:string,lead:string,grp:int,prior:double,min_entropy:double,min_len:int,max_len:int,high_fp:boolean,requires_context:boolean,words:array<string>,validator:string,kind:string,filtered:boolean>"
_STATE = "struct<at:int,line:int,column:int,near:string>"
_HIT = "struct<start:int,value:string,line:int,column:int,map_line:boolean,before:string,after:string,context:string,low:string,entropy:double,classes:int>"
Get = Callable[[str], Column]


def _rows(rules: Iterable[Rule]) -> list[dict]:
    """The rules with the fields of ``_RULE``."""
    rows = []
    for n, r in enumerate(rules):
        d = asdict(r)
        words = [w.lower() for w in (r.context or (noise.CONTEXT if r.requires_context or (r.kind == "legacy" and r.high_fp) else ()))]
        d |= {"n": n, "java": to_java(r.pattern), "lead": to_java(lead) if (lead := leading(r.pattern, r.group)) else "", "grp": r.group, "words": words, "filtered": "unfiltered" not in r.tags}
        rows.append(d)
    return rows


def rule_array(rules: Iterable[Rule]) -> Column:
    """The rules as one constant array of structs."""
    return F.from_json(F.lit(json.dumps(_rows(rules))), f"array<{_RULE}>")


def capped(body: Column, limit: int = MAX_BYTES) -> Column:
    """The first ``limit`` bytes."""
    return F.when(F.octet_length(body) > limit, F.substring(F.encode(body, "UTF-8"), 1, limit).cast("string")).otherwise(body)


def without_comments(body: Column) -> Column:
    """Comments of JavaScript turned into spaces; strings and line breaks stay, so offsets do too.

    Strings and comments are found by one alternation, leftmost first; an unclosed quote takes the rest. A
    comment's bytes become one space each, as offsets are in bytes.
    """
    pattern = r"""(?s)("(?:[^"\\]|\\.)*+(?:"|\\?\z)|'(?:[^'\\]|\\.)*+(?:'|\\?\z)|`(?:[^`\\]|\\.)*+(?:`|\\?\z)|//[^\n]*|/\*.*?(?:\*/|\z))"""
    # a text is split by a letter without compiling the pattern again
    parted = F.split(F.regexp_replace(body, pattern, "\0"), "\0", -1)
    gaps, hits = F.when(F.contains(body, F.lit("\0")), F.split(body, pattern, -1)).otherwise(parted), F.regexp_extract_all(body, F.lit(pattern), F.lit(1))
    wide = lambda h: F.regexp_replace(F.regexp_replace(F.regexp_replace(h, r"[\x{10000}-\x{10FFFF}]", "    "), r"[\u0800-\uFFFF]", "   "), r"[\u0080-\u07FF]", "  ")
    blank = F.transform(hits, lambda h: F.when(h.startswith("//") | h.startswith("/*"), F.regexp_replace(F.when(F.octet_length(h) == F.length(h), h).otherwise(wide(h)), r"[^\n]", " ")).otherwise(h))
    stripped = F.concat(F.array_join(F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), blank, lambda g, h: F.concat(g, h)), ""), F.element_at(gaps, -1))
    return F.when(body.contains("//") | body.contains("/*"), stripped).otherwise(body)


def script(body: Column, comments: bool = False) -> Column:
    """The body as it is scanned: without comments, unless they are asked for."""
    return body if comments else without_comments(body)


def _last(text: Column, n: int) -> Column:
    """The last ``n`` bytes."""
    return F.substring(F.substring(text, -n, n).cast("binary"), -n, n).cast("string")


def _first(text: Column, n: int) -> Column:
    """The first ``n`` bytes."""
    return F.substring(F.substring(text, 1, n).cast("binary"), 1, n).cast("string")


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Up to so many rules, each pattern stands in the plan and is compiled once, not again for every document.
FEW = 16


def _extracted(body: Column, rule: Column, rules: list[Rule], pattern: str, group: int | None = None) -> Column:
    """What a group (None: the rule's own) of a rule's ``java`` or ``lead`` captures."""
    if len(rules) > FEW:
        return F.regexp_extract_all(body, rule[pattern], rule["grp"] if group is None else F.lit(group))
    found = F.lit(None).cast("array<string>")
    for d in _rows(rules):
        found = F.when(rule["n"] == d["n"], F.regexp_extract_all(body, F.lit(d[pattern]), F.lit(d["grp"] if group is None else group))).otherwise(found)
    return found


def _gaps(body: Column, rule: Column, hits: Column) -> Column:
    """Texts between the matches. Where a text is the only match and stands there once, it is not matched again."""
    one = F.get(hits, F.lit(0))
    before, behind = (F.call_function("substring_index", body, one, F.lit(n)) for n in (1, -1))
    alone = (F.size(hits) == 1) & (F.octet_length(before) + F.octet_length(one) + F.octet_length(behind) == F.octet_length(body))
    return F.when(alone, F.array(before, behind)).otherwise(F.split(body, rule["java"], F.lit(-1)))


def _hits(body: Column, marked: Column, rule: Column, rules: list[Rule]) -> Column:
    """Non-overlapping matches of one of the rules; ``marked`` are the numbers of lines that name a source map.

    Texts between the matches are walked once from either side, carrying offsets and a bounded context. The
    place of a group is measured by what its pattern matches before it; where a pattern does not allow that,
    the first occurrence of its text in the match is taken.
    """
    part, lead = F.when(rule["grp"] > 0, _extracted(body, rule, rules, "java")), F.when(rule["lead"] != "", _extracted(body, rule, rules, "lead", 1))
    cut = once(_extracted(body, rule, rules, "java", 0), lambda hits: F.struct(hits.alias("hit"), part.alias("part"), lead.alias("lead"), _gaps(body, rule, hits).alias("gap")))

    def item(c: Column, hit: Column, i: Column) -> Column:
        def of(part: Column) -> Column:
            ahead = F.when(part == "", F.lit("")).otherwise(F.coalesce(F.get(c["lead"], i), F.left(hit, F.instr(hit, part) - 1)))
            return F.struct(F.get(c["gap"], i).alias("gap"), hit.alias("hit"), F.when(part == "", hit).otherwise(part).alias("value"), ahead.alias("ahead"))

        return once(F.coalesce(F.get(c["part"], i), F.lit("")), of)

    def advance(s: Column, x: Column) -> Column:
        def past(text: Column) -> Column:
            column = F.when(F.contains(text, F.lit("\n")), F.octet_length(F.substring_index(text, "\n", -1))).otherwise(s["column"] + F.octet_length(text))
            return F.struct((s["at"] + F.octet_length(text)).alias("at"), (s["line"] + _breaks(text)).alias("line"), column.alias("column"), _last(F.concat(s["near"], text), MEDIA_WINDOW).alias("near"))

        return once(F.concat(x["gap"], x["hit"]), past)

    def placed(s: Column, following: Column, x: Column) -> Column:
        def at(pre: Column) -> Column:
            column = F.when(F.contains(pre, F.lit("\n")), F.octet_length(F.substring_index(pre, "\n", -1))).otherwise(s["column"] + F.octet_length(pre)) + 1
            after = _first(F.concat(F.substr(x["hit"], F.length(x["ahead"]) + F.length(x["value"]) + 1), following), WINDOW)
            return F.struct((s["at"] + F.octet_length(pre)).alias("start"), x["value"].alias("value"), (s["line"] + _breaks(pre)).alias("line"), column.alias("column"), _last(F.concat(s["near"], pre), MEDIA_WINDOW).alias("before"), after.alias("after"))

        return once(F.concat(x["gap"], x["ahead"]), at)

    def told(y: Column) -> Column:
        v = y["value"]
        on_map = F.when(F.size(marked) > 0, F.exists(marked, lambda m: (m >= y["line"]) & (m <= y["line"] + _breaks(v)))).otherwise(F.lit(False))
        return once(F.concat(_last(y["before"], WINDOW), v, y["after"]), lambda context: F.struct(
            y["start"].alias("start"), v.alias("value"), y["line"].alias("line"), y["column"].alias("column"), on_map.alias("map_line"), y["before"].alias("before"), y["after"].alias("after"),
            context.alias("context"), F.lower(context).alias("low"), entropy(v).alias("entropy"), classes(v).alias("classes"),
        ))

    begin = F.struct(F.lit(0).alias("at"), F.lit(1).alias("line"), F.lit(0).alias("column"), F.lit("").alias("near"))

    def walked(c: Column, items: Column) -> Column:
        end = _first(F.element_at(c["gap"], -1), WINDOW)
        back = running(F.reverse(items), end, "string", lambda s, x: _first(F.concat(F.left(x["gap"], F.lit(WINDOW)), F.left(x["hit"], F.lit(WINDOW)), s), WINDOW), lambda s, x: s)
        ahead = running(items, begin, _STATE, advance, lambda s, x: s)
        # of a single match neither walk is needed
        both = F.struct(F.when(F.size(items) == 1, F.array(begin)).otherwise(ahead).alias("at"), F.when(F.size(items) == 1, F.array(end)).otherwise(F.reverse(back)).alias("following"))
        return once(both, lambda w: F.transform(items, lambda x, i: once(placed(F.get(w["at"], i), F.get(w["following"], i), x), told)))

    return once(cut, lambda c: once(F.transform(c["hit"], lambda h, i: item(c, h, i)), lambda items: walked(c, items)))


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


#: Letters and digits in a row that many rules without a literal need: looked for once for all of them.
RUN = 20


def _which(rules: list[Rule]) -> str:
    """Numbers of the rules that a body matches (_b; _l in lower case), as SQL: one text is quicker to build than columns.

    Rules' literals share short fragments. Only where a body holds a fragment its literals are looked for, only where it
    holds a literal the rule is tried. Rules without a literal wait for a long run of letters and digits, or a mark.
    """
    by_literal: dict[str, list[int]] = {}
    gates: dict[str, list[str]] = {}

    def tried(n: int, literals: Iterable[str] = ()) -> str:
        there = " or ".join(f"contains(_l, {_quoted(x)})" for x in literals)
        match = f"rlike(_b, {_quoted(to_java(rules[n].pattern))})"
        return f"if({f'({there}) and ' if there else ''}{match}, {n}, null)"

    for n, r in enumerate(rules):
        literals = anchors(r.pattern)
        for x in literals:
            by_literal.setdefault(x, []).append(n)
        if not literals:
            marks = " or ".join(f"contains(_l, {_quoted(x)})" for x in anchors(r.pattern, 1))
            gate = f"rlike(_b, '[A-Za-z0-9]{{{RUN}}}')" if least_run(r.pattern) >= RUN else marks or "true"
            gates.setdefault(gate, []).append(tried(n))
    for fragment, literals in fragments(by_literal).items():
        members = sorted({n for x in literals for n in by_literal[x]})
        gates[f"contains(_l, {_quoted(fragment)})"] = [tried(n, [x for x in literals if n in by_literal[x]]) for n in members]
    groups = (f"if({gate}, array({', '.join(members)}), cast(array() as array<int>))" for gate, members in gates.items())
    # of no function here the arguments are lambdas, so that all of it is compiled
    return f"sort_array(array_except(flatten(array({', '.join(groups)})), array(cast(null as int))))"


def _found(docs: DataFrame, rules: Iterable[Rule], source: str, body: str, comments: bool, max_bytes: int | None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(source, found): each document's matches as an array of (rule, hit)."""
    rules = list(rules)
    text = F.col(body).cast("string")
    text = text if max_bytes is None else capped(text, max_bytes)
    given = docs.select(F.col(source).cast("string").alias("source"), *carry, text.alias("_b")).filter("_b <> ''").select("source", *carry, script(F.col("_b"), comments).alias("_b"))
    given = given.select("source", *carry, "_b", F.replace(F.lower("_b"), F.lit("ſ"), F.lit("s")).alias("_l"))
    which = F.expr(_which(rules)) if rules else F.array().cast("array<int>")
    marked = F.when(F.contains("_l", F.lit("url=")), F.array_compact(F.transform(F.split("_b", "\n"), lambda t, i: F.when(t.rlike(to_java(noise.SOURCE_MAP_LINE)), i + 1)))).otherwise(F.expr("cast(array() as array<int>)"))
    table = rule_array(rules)

    def of(n: Column) -> Column:
        return once(F.element_at(table, n + 1), lambda r: F.transform(_hits(F.col("_b"), F.col("_marked"), r, rules), lambda h: F.struct(r.alias("r"), h.alias("h"))))

    # named twice, so that it stays a column of its own, which is compiled; no filter on it, which would be moved down and compute it again
    told = given.select("source", *carry, "_b", which.alias("_which"), marked.alias("_marked"))
    return told.select("source", *carry, F.when(F.size("_which") > 0, F.flatten(F.transform("_which", of))).alias("found"))


def matches(docs: DataFrame, rules: Iterable[Rule], source: str = "source", body: str = "body", comments: bool = False, max_bytes: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row for each match: source, rule columns, value, byte offset, line, byte column and ±96 bytes.

    Comments are blanked unless ``comments``; bodies are read whole unless ``max_bytes`` is given. Columns named in
    ``carry`` come along.
    """
    return each(_found(docs, rules, source, body, comments, max_bytes, carry), F.col("found"), "m", "source", *carry).select("source", *carry, "m.r.*", "m.h.*")


def _words(words: Iterable[str]) -> str:
    """Pattern of any of the literal words."""
    return "|".join(rf"\Q{w}\E" for w in words)


def _holds(text: Column, words: Iterable[str]) -> Column:
    """Whether the text holds any of the literal words."""
    return reduce(or_, (F.contains(text, F.lit(w)) for w in words))


def judged(x: Get, source: Column, min_confidence: float = MIN_CONFIDENCE, fp_filter: bool = True) -> dict[str, Column]:
    """``drop_reason`` (null: kept), ``confidence`` and ``reasons`` of a match. Gates run in a fixed order."""
    v, low = x("value"), x("low")
    legacy = x("kind") == "legacy"
    fixture, vendor = _holds(low, noise.FIXTURES), source.rlike(to_java(noise.VENDOR_SOURCE))
    near = (F.size(x("words")) == 0) | F.exists(x("words"), lambda w: F.contains(low, w))
    placeholder = v.isin(*noise.SAMPLES) | _holds(v, noise.FRAGMENTS)
    n = F.octet_length(v)
    floor = F.when(legacy, 3.2).otherwise(3.0)
    skip = legacy & (F.lit(not fp_filter) | ~x("filtered"))
    drop = (
        F.when(skip, F.lit(None)).when(~legacy & x("map_line"), "source_map_line").when(v == "", "empty").when(placeholder, "vendor_noise").when(x("map_line"), "source_map_line")
        .when((x("min_len") > 0) & (n < x("min_len")), "length").when((x("max_len") > 0) & (n > x("max_len")), "length")
        .when((x("min_entropy") > 0) & (x("entropy") < x("min_entropy")), "entropy")
        .when(x("high_fp") & (x("classes") < 2), "classes").when(x("high_fp") & (x("entropy") < floor), "entropy")
        .when((x("requires_context") | (legacy & x("high_fp"))) & ~near, "context").when(~valid(x("validator"), v), "validator")
    )
    add = lambda when, y: F.when(when, F.lit(y)).otherwise(0.0)
    score = (
        x("prior") + add(vendor, -0.15) + add(x("requires_context") & ~legacy, 0.05) + add(x("validator") != "", 0.10)
        + add(fixture, -0.30) + add(x("entropy") >= 4.5, 0.05) + add(~legacy & (x("classes") >= 3), 0.05)
    )
    said = lambda when, *text: F.when(when, F.concat(*text) if len(text) > 1 else text[0])
    reasons = F.array_compact(F.array(
        said(legacy & x("high_fp"), F.lit("context keyword present (generic-rule gate)")),
        said(vendor, F.when(legacy, "vendor/chunk bundle").otherwise("source looks like a vendor/chunk bundle")),
        said(x("requires_context") & ~legacy, F.lit("context keyword present")), approval(x("validator"), v),
        said(fixture, F.when(legacy, "context looks like a fixture/example").otherwise("surrounded by fixture/example wording")),
        said(x("entropy") >= 4.5, F.lit("high entropy "), F.format_number(x("entropy"), 2)), said(~legacy & (x("classes") >= 3), F.lit("diverse character classes")),
    ))
    confidence = F.when(skip, x("prior")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))
    below = F.when(~skip & (confidence < min_confidence), "low_confidence")
    return {"drop_reason": F.coalesce(drop, below), "confidence": confidence, "reasons": F.when(skip, F.array().cast("array<string>")).otherwise(reasons)}


def scored(hits: DataFrame, min_confidence: float = MIN_CONFIDENCE, fp_filter: bool = True) -> DataFrame:
    """Adds confidence, reasons and, for what is not kept, ``drop_reason`` to matches, each judged alone."""
    return hits.withColumns(judged(F.col, F.col("source"), min_confidence, fp_filter))


def unwanted_email(value: Column) -> Column:
    low = F.lower(value)
    return low.rlike(r"\A(?:" + _words(noise.EMAIL_PREFIXES) + ")") | low.rlike("(?:" + _words("@" + d for d in noise.EMAIL_DOMAINS) + r")\z")


def _like_base64(v: Column) -> Column:
    mostly = F.length(F.regexp_replace(v, "[^A-Za-z0-9+/=]+", "")) / F.octet_length(v) > 0.95
    return (F.octet_length(v) >= 16) & (v.rlike(r"\A[A-Za-z0-9+/=]+\z") | mostly)


def in_foreign_address(x: Get, source: Column) -> Column:
    """Whether an address nearby that holds the value is of another base domain than the source."""
    near = F.concat(_last(x("before"), FOREIGN_WINDOW), x("value"), _first(x("after"), FOREIGN_WINDOW))
    own = base_domain(host(source))
    urls = F.regexp_extract_all(near, F.lit(r"""https?://[^\t\n\f\r "'<>)]+"""), F.lit(0))
    return host(source).isNotNull() & F.exists(urls, lambda u: F.contains(u, x("value")) & F.coalesce(base_domain(host(u)) != own, F.lit(False)))


def encoded_media(x: Get) -> Column:
    """Whether the value is a piece of encoded media: base64 near wording of media, or long, or inside more base64."""
    v = x("value")
    n = F.octet_length(v)

    def media(y: Column) -> Column:
        at = y["at"]
        piece = lambda before, after: F.substr(y["near"].cast("binary"), F.greatest(at - before, F.lit(0)) + 1, at + n + after - F.greatest(at - before, F.lit(0))).cast("string")
        inside = once(piece(FOREIGN_WINDOW, FOREIGN_WINDOW), lambda wide: (F.octet_length(wide) > 2 * n) & _like_base64(wide))
        return once(F.lower(piece(MEDIA_WINDOW, MEDIA_WINDOW)), lambda low: _holds(low, MEDIA)) | ((n > 100) & (x("entropy") > 4.5)) | inside

    place = lambda near: F.struct(near.alias("near"), F.octet_length(F.left(near, F.instr(near, v) - 1)).alias("at"))
    return _like_base64(v) & once(F.concat(x("before"), v, _first(x("after"), FOREIGN_WINDOW)), lambda near: once(place(near), media))


def clean_link(v: Column) -> Column:
    bare = F.regexp_replace(v, r"[,;\\|)]+\z", "")
    return F.regexp_replace(F.regexp_replace(bare, r"""\A["']+|["']+\z""", ""), r"[ \t\n\r]+\z", "")


def valid_link(v: Column) -> Column:
    """An http(s) address with a host, a numeric port if any, and no wording of a placeholder or template."""
    return v.rlike(r"(?i)\Ahttps?://(?:[^/?#@]*@)?(?:\[[^\]/?#]*\]|[^/?#:\x00-\x20<>\"\\^`{|}]+)(?::[0-9]*)?(?:[/?#][^\x00-\x20]*)?\z") & ~v.rlike(r"%(?![0-9A-Fa-f]{2})") & ~F.lower(v).rlike(_words(PLACEHOLDERS))


def unwanted_link(x: Get, source: Column) -> Column:
    """Whether a link (cleaned already) is malformed, a placeholder, behind a comment mark, or of another base domain."""
    v = x("value")
    near = F.concat(_last(x("before"), FOREIGN_WINDOW), v, _first(x("after"), FOREIGN_WINDOW))
    before = F.left(near, F.instr(near, v) - 1)
    comment = F.contains(F.substring_index(before, "\n", -1), F.lit("//")) | before.rlike(r"(?s)/\*(?:(?!\*/).)*\z")
    other = base_domain(host(v)) != base_domain(host(source))
    return (v == "") | ~valid_link(v) | comment | F.coalesce(other, F.lit(False))


def cross_domain(value: Column, source: Column) -> Column:
    """Whether a value is an address, or an e-mail, of another base domain than the source."""
    own = base_domain(host(source))
    parts = F.split(value, "@")
    mail = F.when(F.size(parts) == 2, F.nullif(base_domain(F.element_at(parts, -1)), F.lit("")))
    return F.coalesce(F.when(value.rlike(r"""https?://[^\t\n\f\r "'<>]"""), base_domain(host(value)) != own).otherwise(mail != own), F.lit(False))


def out_of_scope(source: Column, domain: str | None = None, extensions: Iterable[str] = ()) -> Column:
    """Whether a source lacks ``domain`` or ends in none of ``extensions``."""
    ends = [F.endswith(source, F.lit(e.strip())) for e in extensions]
    lacks = ~F.contains(source, F.lit(domain)) if domain else F.lit(False)
    one = F.lit(not ends)
    for e in ends:
        one = one | e
    return lacks | ~one


def assess(
    docs: DataFrame, rules: Iterable[Rule], source: str = "source", body: str = "body", comments: bool = False, max_bytes: int | None = None, min_confidence: float = MIN_CONFIDENCE,
    fp_filter: bool = True, ignore: Callable[[Get], Column] | None = None, domain: str | None = None, extensions: Iterable[str] = (), pattern: str | None = None, internal: bool = False,
) -> DataFrame:
    """All matches, scored, in one pass; legacy ones also go through the filters that only they have.

    A legacy match is dropped outside ``domain`` and ``extensions``, in an address of another base domain, as
    encoded media, as an unwanted link or e-mail, if a registry rule has kept its value in the same document, by
    its score, as cross-domain, if ``pattern`` does not match it, and with ``internal`` if it names nothing internal.
    ``ignore`` is a condition on a match's columns. An unusable ``pattern`` lets nothing pass.
    """
    rules, src = list(rules), F.col("source")
    names = lambda shape: [f.split(":", 1)[0] for f in shape[7:-1].split(",")]
    in_rule, in_hit = names(_RULE), names(_HIT)
    matching = None if pattern is None else to_java(pattern) if usable(pattern) else r"\A\z."

    def seen(m: Column) -> tuple[Get, Get]:
        """A match's columns as they were found, and with its link cleaned."""
        x = lambda name: m["r"][name] if name in in_rule else m["h"][name]
        value = F.when(x("name") == LINK, clean_link(x("value"))).otherwise(x("value"))
        return x, lambda name: {"value": value, "source": src}[name] if name in ("value", "source") else value_hash(value) if name == "value_hash" else x(name)

    def own(m: Column) -> tuple[dict[str, Column], Column]:
        """What a match is by itself: how it is judged, and whether it is ignored."""
        x, now = seen(m)
        return judged(x, src, min_confidence, fp_filter), F.when(F.coalesce(ignore(now), F.lit(False)), "ignored") if ignore else F.lit(None).cast("string")

    def good(m: Column) -> Column:
        told, late = own(m)
        return F.coalesce(told["drop_reason"], late).isNull()

    rows = _found(docs, rules, source, body, comments, max_bytes)
    none = F.expr("cast(array() as array<string>)")
    if {r.kind == "legacy" for r in rules} == {True, False}:
        rows = rows.select("source", "found", F.filter("found", lambda m: m["r"]["kind"] != "legacy").alias("_mine"))
        one, value_of = F.get("_mine", F.lit(0)), lambda m: seen(m)[1]("value")
        # a single one is judged outside a lambda function, where expressions are compiled
        single = F.when(good(one), F.array(value_of(one))).otherwise(none)
        several = F.array_distinct(F.transform(F.filter("_mine", good), value_of))
        strict = F.when((F.size("_mine") == 0) | (F.size("_mine") == F.size("found")), none).when(F.size("_mine") == 1, single).otherwise(several)
    else:
        strict = none
    m = each(rows, F.col("found"), "m", "source", strict.alias("_strict"))
    x, now = seen(F.col("m"))
    told, late = own(F.col("m"))
    value, legacy = now("value"), x("kind") == "legacy"
    hidden = F.when(out_of_scope(src, domain, extensions), "scope").when(in_foreign_address(x, src), "foreign_address").when(encoded_media(x), "encoded_media")
    early = hidden.when((x("name") == LINK) & unwanted_link(now, src), "link").when((x("name") == "Email") & unwanted_email(value), "unwanted_email")
    last = F.when(cross_domain(value, src), "cross_domain")
    last = last.when(~value.rlike(matching), "pattern") if matching else last
    last = last.when(~value.rlike(_words(INTERNAL)), "not_internal") if internal else last
    covered = F.when(legacy & F.array_contains("_strict", value), "covered")
    reason = F.coalesce(F.when(legacy, early), covered, told["drop_reason"], late, F.when(legacy, last))
    hit = [value.alias(f) if f == "value" else F.col(f"m.h.{f}").alias(f) for f in in_hit]
    return m.select("source", "m.r.*", *hit, reason.alias("drop_reason"), told["confidence"].alias("confidence"), told["reasons"].alias("reasons"))


def usable(pattern: str) -> bool:
    """Whether a pattern can be compiled."""
    try:
        re.compile(pattern)
    except re.error:
        return False
    return True


def kept(rows: DataFrame) -> DataFrame:
    return rows.filter("drop_reason is null")


def identified(rows: DataFrame) -> DataFrame:
    return rows.withColumn("value_hash", value_hash(F.col("value"))).withColumn("redacted", redact(F.col("value")))

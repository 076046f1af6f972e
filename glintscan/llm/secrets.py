"""Secret scans, with DataFrame functions only.

Three fixed shapes (assignments, access keys, long hexadecimal runs) are located by regular expression. Other
tokens that mix letters and digits are judged by a randomness battery: a name or value ends at ``=`` unless that
is padding, and what mixes the two base64 alphabets is judged as a whole and by its longest runs of one of them;
no part is shorter than ``SHORTEST``. The encoding of each part is inferred, and a
chi-squared test of uniformity over its alphabet, a runs test and a lag-1 serial correlation test are combined
by Fisher's method; as the tests are dependent and their tails approximate, the p-value of the combined statistic
is read off a table measured on random tokens (``TAIL``). A low combined p-value means that a token is demonstrably
not random. What is controlled is the share of ordinary names among what is reported, within classes of token length
and over the whole corpus: random tokens have p-values spread evenly, names have few high ones, so the count of
p-values above ``UPPER`` tells how many random tokens a class holds (Storey's estimate; the smaller of two, each with
two standard errors added, so that few tokens are not lost by chance). Tokens above a p-value are reported as kind ``random`` while, by that estimate, no more
than a share ``Q`` of them is not random; the lowest such p-value is the class's limit. What the Benjamini-Hochberg
procedure rejects at ``Q`` is never reported, which tells in classes of very few tokens. A class without tokens has
no limit and reports nothing.

Offsets are code points, ends exclusive. A null text counts as empty and has no spans. Rows are scanned one by
one; repeated rows have equal spans, and only the named columns are looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glintscan.functions.arrays import each, running
from glintscan.llm.common import fresh

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
#: Kinds in the order in which spans with the same start are listed, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
SHORTEST = 20
TOKEN = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
#: Parts of a token between inner ``=``, and runs of one alphabet in a part.
PARTS, RUNS = r"[^=]+(?:=+$)?", (r"[A-Za-z0-9+/]+=*", r"[A-Za-z0-9_-]+=*")
#: Alphabets by the pattern that tells them, narrowest first.
ALPHABETS = (
    (r"^[0-9a-f]+$", "0123456789abcdef"),
    (r"^[0-9A-F]+$", "0123456789ABCDEF"),
    (r"^[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    (r"^[a-z0-9]+$", "abcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"),
    (r"^[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    (r"^[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    (r"^[A-Za-z0-9+/_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_"),
)
#: Share of tokens that are not random among those reported of a length class, and of false rejections.
Q = 0.05
#: Steps (see ``rounded``) below which p-values are taken as those of random tokens: above about 0.5 and 0.8.
UPPER = (6, 2)
#: Standard errors added to the count of random tokens, so that a class of few tokens does not lose them by chance.
ERRORS = 2
#: (statistic, -log p): the largest quantiles of Fisher's sum among 2,000,000 random tokens each of 16, 36, 62 and 66 letters
#: and of 18 to 150 characters (the first three of 100,000); for shorter tokens of 8 characters or more, those of all lengths. Behind the last pair the
#: p-value is extrapolated, by a power lower than that between the last pairs.
_LOGS = (0.105, 0.223, 0.431, 0.69, 1.60, 2.30, 2.99, 3.91, 4.60, 5.29, 6.21, 6.90, 7.60, 8.51, 9.21, 10.41, 11.51)
TAIL = tuple(zip((0.93, 1.31, 1.85, 2.48, 4.41, 5.84, 7.25, 9.16, 10.66, 12.20, 14.86, 17.75, 21.05, 27.29, 33.56, 46.78, 57.51), _LOGS, strict=True))
TAIL_SHORT = tuple(zip((0.91, 1.28, 1.79, 2.48, 4.41, 5.84, 7.25, 9.16, 11.81, 13.29, 20.80, 26.21, 30.36, 59.83, 61.36, 82.78, 102.77), _LOGS, strict=True))
MASK = "[SECRET]"


def located(text: Column, pattern: str, group: int = 0) -> Column:
    """Array of (start, end, value) of all matches; ``value`` is the group's text.

    Between the matches lie the parts that ``split`` gives, so a running sum of lengths gives the offsets.
    """
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    parts = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), value.alias("value"))

    def emit(at: Column, x: Column) -> Column:
        start = at + F.length(x["gap"])
        return F.struct(start.alias("start"), (start + F.length(x["hit"])).alias("end"), x["value"].alias("value"))

    kind = "struct<start:int,end:int,value:string>"
    found = running(parts, F.lit(0), kind, lambda at, x: at + F.length(x["gap"]) + F.length(x["hit"]), emit)
    return F.when(text.rlike(pattern), found).otherwise(F.expr(f"cast(array() as array<{kind}>)"))


def _span(kind: str) -> object:
    return lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), x["end"].alias("end"))


def base_spans(text: Column) -> Column:
    """Spans (start, rank of the kind, end) of the three fixed shapes, in order.

    A longest run of hexadecimal digits, or one after ``AKIA``, has the same matches whether its length is asked
    for in the pattern or afterwards; for assignments it has not, so those are filtered.
    """
    assign = F.filter(located(text, ASSIGN, 2), lambda x: F.length(x["value"]) >= 6)
    found = (("assign", assign), ("access", located(text, ACCESS[:-1] + "{16,}")), ("hex", located(text, HEX[:-1] + "{24,}")))
    return F.array_sort(F.concat(*(F.transform(x, _span(kind)) for kind, x in found)))


def tail(z: Column) -> Column:
    """Upper tail of the normal distribution, to about 1e-4."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 0.07056 * z * z * z + 1.5976 * z)))


def calibrated(s: Column, table: tuple[tuple[float, float], ...]) -> Column:
    """p-value of a combined statistic by a table; between its pairs -log p is linear."""
    last_at, last = table[-1]
    log = last * F.pow(s / last_at, F.lit(0.3))
    for (a, u), (b, v) in reversed(list(zip(((0.0, 0.0), *table), table, strict=False))):
        log = F.when(s < b, u + (s - a) * ((v - u) / (b - a))).otherwise(log)
    return F.exp(-log)


def battery(token: Column) -> Column:
    """Combined p-value of the three tests under the hypothesis that ``token`` is random over its alphabet; null without an alphabet."""
    alphabet = F.lit(None).cast("string")
    for pattern, letters in reversed(ALPHABETS):
        alphabet = F.when(token.rlike(pattern), F.lit(letters)).otherwise(alphabet)
    body = F.rtrim(token, F.lit("="))
    codes = F.transform(F.filter(F.split(body, ""), lambda c: c != ""), lambda c: (F.instr(alphabet, c) - 1).cast("double"))

    def tests(x: Column) -> Column:
        c, k = x["codes"], x["k"]
        n = F.size(c).cast("double")
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        squares = total(F.transform(F.array_distinct(c), lambda d: F.pow(F.size(F.filter(c, lambda v: v == d)).cast("double"), F.lit(2.0))))
        chi = tail((k / n * squares - n - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n)))
        follow = F.zip_with(F.slice(c, F.lit(1), F.size(c) - 1), F.slice(c, F.lit(2), F.size(c) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        high = total(F.transform(c, lambda v: (v >= k / 2).cast("double")))
        runs = 1 + total(F.transform(follow, lambda p: ((p["a"] >= k / 2) != (p["b"] >= k / 2)).cast("double")))
        m = 2 * high * (n - high) / n
        spread = m * (m - 1) / (n - 1)
        run = F.when(spread > 0, 2 * tail(F.abs(runs - m - 1) / F.sqrt(spread))).otherwise(F.pow(F.lit(2.0), 1 - n))
        mean = total(c) / n
        variance = total(F.transform(c, lambda v: (v - mean) * (v - mean)))
        serial = F.when(variance > 0, 2 * tail(F.abs(total(F.transform(follow, lambda p: (p["a"] - mean) * (p["b"] - mean))) / variance + 1 / n) * F.sqrt(n))).otherwise(F.pow(k, 1 - n))
        s = -sum((F.log(F.greatest(F.least(p, F.lit(1.0)), F.lit(1e-300))) for p in (chi, run, serial)), F.lit(0.0))
        # in an array, so that it is computed once
        return F.element_at(F.transform(F.array(s), lambda v: F.when(n >= 18, calibrated(v, TAIL)).otherwise(calibrated(v, TAIL_SHORT))), 1)

    # a one-element array names what is used often, so that it is computed once
    one = F.array(F.struct(codes.alias("codes"), F.length(alphabet).cast("double").alias("k")))
    return F.when(alphabet.isNotNull() & (F.length(body) >= 8), F.element_at(F.transform(one, tests), 1))


def length_class(length: Column) -> Column:
    return F.floor(F.log2(length.cast("double"))).cast("int")


def rounded(p: Column) -> Column:
    """``p`` rounded up to one of 20 steps a power of ten: as the number of steps below 1, 400 at most; null stays null."""
    return F.when(p.isNotNull(), F.least(F.lit(400), F.floor(-20 * F.log10(F.greatest(p, F.lit(1e-20)))).cast("int")))


def parts(tokens: Column) -> Column:
    """Of tokens (start, end, value), the parts to be judged, likewise, each once."""
    plain = lambda v: ~v.rlike("=[^=]") & ~(v.rlike("[+/]") & v.rlike("[_-]")) & ~v.startswith("=")

    def moved(x: Column, pattern: str) -> Column:
        return F.transform(located(x["value"], pattern), lambda y: F.struct((x["start"] + y["start"]).alias("start"), (x["start"] + y["end"]).alias("end"), y["value"].alias("value")))

    long = lambda found: F.filter(found, lambda y: F.length(y["value"]) >= SHORTEST)

    def runs(x: Column) -> Column:
        return F.when(plain(x["value"]), F.array(x)).otherwise(F.array_distinct(F.concat(F.array(x), *(long(moved(x, r)) for r in RUNS))))

    return F.flatten(F.transform(tokens, lambda x: F.when(plain(x["value"]), F.array(x)).otherwise(F.flatten(F.transform(long(moved(x, PARTS)), runs)))))


def candidates(text: Column, base: Column) -> Column:
    """Tokens to be judged: (start, end, class, step), outside the base spans."""
    tokens = F.filter(parts(located(text, TOKEN)), lambda x: x["value"].rlike("[0-9]") & x["value"].rlike("[A-Za-z]") & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    judged = F.transform(tokens, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), length_class(x["end"] - x["start"]).alias("cls"), rounded(battery(x["value"])).alias("step")))
    return F.filter(judged, lambda x: x["step"].isNotNull())


def limits_of(counts: DataFrame) -> DataFrame:
    """Of (cls, step, count), each class's ``limit``: tokens of lower steps are reported. Classes that report nothing have no row.

    ``cut`` is the p-value that all tokens of a step or a lower one exceed. Only counts by step are looked at, at most 401 a class.
    """
    low, high = Window.partitionBy("cls").orderBy("step"), Window.partitionBy("cls").orderBy(F.col("step").desc())
    every = Window.partitionBy("cls")
    cut = lambda step: F.pow(F.lit(10.0), -step / 20)

    def random_tokens(step: int) -> Column:
        above = F.sum(F.when(F.col("step") < step, F.col("count")).otherwise(0)).over(every)
        return (above + ERRORS * F.sqrt(above + 1)) / (1 - 10 ** (-step / 20))

    rows = counts.select(
        "cls", "step", F.sum("count").over(low).alias("reported"), F.sum("count").over(high).alias("below"), F.sum("count").over(every).alias("m"),
        F.least(*map(random_tokens, UPPER)).alias("random"),
    )
    ordinary = F.col("reported") - F.col("random") * (1 - cut(F.col("step") + 1))
    rejected = F.max(F.when(cut(F.col("step")) * F.col("m") <= Q * F.col("below"), F.lit(True)).otherwise(False)).over(low)
    good = rows.withColumn("rejected", rejected).filter(~F.col("rejected") & (ordinary <= Q * F.col("reported")))
    return good.groupBy("cls").agg((F.max("step") + 1).alias("limit"))


def thresholds(docs: DataFrame, text: str = "text") -> dict[int, int]:
    """By length class, the step under which tokens are reported, over the whole corpus.

    p-values are rounded up to steps and only counted: the result has a row a class, and there are no more
    classes than bits in a length.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    counts = each(docs.filter(t.rlike(TOKEN)), candidates(t, base_spans(t)), "c").groupBy("c.cls", "c.step").count()
    return {r["cls"]: r["limit"] for r in limits_of(counts).collect()}


def spans(text: Column, limits: dict[int, int]) -> Column:
    """All spans of a text, in order: the fixed shapes and the tokens that pass for random."""
    t = F.coalesce(text, F.lit(""))
    base = base_spans(t)
    def passes(x: Column) -> Column:
        least = F.lit(0)
        for cls, step in sorted(limits.items()):
            least = F.when(x["cls"] == cls, F.lit(step)).otherwise(least)
        return x["step"] < least

    found = F.when(t.rlike(TOKEN), F.transform(F.filter(candidates(t, base), passes), _span("random"))).otherwise(F.expr("cast(array() as array<struct<start:int,rank:int,end:int>>)"))
    return F.array_sort(F.concat(base, found))


def written(found: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document the counts of the fixed shapes, the hash of their spans, and all spans."""
    found = docs.select(F.col(doc_id).alias("doc_id"), spans(F.col(text), thresholds(docs, text)).alias("_s"))
    base = F.filter("_s", lambda s: s["rank"] < 3)
    count = lambda kind: F.size(F.filter("_s", lambda s: s["rank"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS), F.sha2(written(base), 256).alias("base_sha256"), written(F.col("_s")).alias("spans"))


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with every span, or run of overlapping spans, replaced by ``MASK``; texts without one stay as they are."""
    t = F.col(text)
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substr(t, acc["at"] + 1, s["start"] - acc["at"]), F.lit(MASK))).otherwise(acc["out"])
        return F.struct(out.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    own = fresh(docs, "spans")
    found = docs.withColumn(own, spans(t, thresholds(docs, text)))
    masked = F.aggregate(own, begin, step, lambda acc: F.concat(acc["out"], F.substr(t, acc["at"] + 1)))
    return found.withColumn(text, F.when(F.size(own) > 0, masked).otherwise(t)).select(*docs.columns)

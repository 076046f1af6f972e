"""Endpoints, parameters, links, origins and embedded documents, extracted from bodies as rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.functions.html import attribute, tags
from glintscan.functions.arrays import each, numbered, running
from glintscan.functions.text import base_domain, host
from glintscan.operators.scan import LINK, assess, script, usable
from glintscan.rules.catalog import EXTRA, legacy_rule
from glintscan.rules.translate import to_java

# Patterns of base addresses, endpoints, full addresses, getters and parameters, and what endpoints may not be.
BASES = (r"""baseURL\s*[:=]\s*["']([^"']*)["']""", r"""apiBase\s*[:=]\s*["']([^"']*)["']""", r"""API_URL\s*[:=]\s*["']([^"']*)["']""", r"""SERVER_URL\s*[:=]\s*["']([^"']*)["']""", r"""endpointBase\s*[:=]\s*["']([^"']*)["']""")
ENDPOINTS = (
    r"""\.ajax\s*\(\s*["']([^"']*)["']""", r"""fetch\s*\(\s*["']([^"']*)["']""", r"""\.open\s*\(\s*["'][^"']*["']\s*,\s*["']([^"']*)["']""", r"""axios\.[a-z]+\s*\(\s*["']([^"']*)["']""",
    r"""request\.[a-z]+\s*\(\s*["']([^"']*)["']""", r"""["'](/api/[a-zA-Z0-9._~:/?#[\]@!$&'()*+,;=%\-]*)["']""", r"""["'](/[a-zA-Z0-9._~:/?#[\]@!$&'()*+,;=%\-]*)["']""", r"""["'](/graphql[^"']*)["']""",
)
ADDRESS = r"https?://[a-zA-Z0-9.-]+/[a-zA-Z0-9._~:/?#[\]@!$&'()*+,;=%\-]+"
VERBS = ("GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "true", "false", "null", "undefined")
FOREIGN = (
    "fonts.googleapis.com", "fonts.gstatic.com", "www.googletagmanager.com", "www.google-analytics.com", "static.hotjar.com", "www.hotjar.com", "cdnjs.cloudflare.com",
    "unpkg.com", "cdn.jsdelivr.net", "ajax.googleapis.com", "code.jquery.com", "maxcdn.bootstrapcdn.com", "stackpath.bootstrapcdn.com", "www.opensource.org",
    "flowplayer.org", "docs.jquery.com", "www.adobe.com", "www.w3.org", "jquery.com", "github.com", "raw.githubusercontent.com",
)
GETTERS = (
    r"""(?:urlParams|searchParams|params|urlSearchParams|queryParams|locationParams)\.get\(["']([a-zA-Z0-9_\-\[\]]+)["']\)""",
    r"""(?:urlParams|searchParams|params|urlSearchParams|queryParams)\.getAll\(["']([a-zA-Z0-9_\-\[\]]+)["']\)""",
    r"""(?:new\s+URL\([^)]+\)|currentUrl|url|apiUrl|baseUrl)\.searchParams\.get\(["']([a-zA-Z0-9_\-\[\]]+)["']\)""",
    r"""pair\[0\]\s*===\s*["']([a-zA-Z0-9_\-]+)["']""", r"""getParam\(["']([a-zA-Z0-9_\-]+)["']\)""",
    r"""(?:urlParams|searchParams|params|urlSearchParams|queryParams)\.has\(["']([a-zA-Z0-9_\-\[\]]+)["']\)""",
    r"""["']([a-zA-Z0-9_\-]+)["']\s*[:=]\s*(?:urlParams|searchParams|params)\.get\(""",
)
GROUPED = r"""(?:urlParams|searchParams|params|urlSearchParams|queryParams)\.get\(["']([a-zA-Z0-9_\-\[\]]+)["']\)"""
PARAMETERS = (
    r"[?&]([a-zA-Z0-9_\-]+)\s*=", r"""(?:get|post|put|delete|patch|fetch|axios|request)\s*\([^)]*["']([a-zA-Z0-9_\-]+)["']\s*[:=]""",
    r"""["']?([a-zA-Z0-9_\-]{2,50})["']?\s*[:=]\s*["']?[^"',}\s)]""",
)
QUERY_STRING, QUERY_KEY = r"""["']([^"']*\?[a-zA-Z0-9_\-]+=)""", r"([a-zA-Z0-9_\-]+)="
KEYWORDS = ("function", "return", "var", "let", "const", "if", "else", "for", "while")
SOURCE_MAP = r"(?m)^[\t ]*//[#@]\s*sourceMappingURL=([^\s]+)\s*$"
MAP = "struct<version:int,file:string,sourceRoot:string,sources:array<string>,sourcesContent:array<string>>"
ORIGIN_SKIPS = ("data:", "blob:", "mediastream:", "filesystem:", "ws:", "wss:", "self", "none", "nonce-", "sha256-", "sha384-", "sha512-", "strict-dynamic", "report-sample", "unsafe-")
DIRECT_ADDRESS = r"""["'](https?://[^"']+\?[^"']+)["']"""
FETCH_ADDRESS = r"""fetch\(["'`]([^"'`]+)\?[^"'`]*["'`]"""
OPEN_ADDRESS = r"""\.open\(["'](?:GET|POST|PUT|DELETE|PATCH)["']\s*,\s*["']([^"']+\?[^"']+)["']"""
TEMPLATE_CALL, TEMPLATE_NAME = r"fetch\(`([^`]+)\$\{[^}]+\}[^`]*`\)", r"\$\{([a-zA-Z_][a-zA-Z0-9_]*)\}"
ASSIGNED = r"""([a-zA-Z0-9_]*)\s*=\s*(?:urlParams|searchParams|params)\.get\(["']([^"']+)["']\)"""
OBJECT_CALL, OBJECT_GROUP = r"new\s+URLSearchParams\([^)]*\{([^}]+)\}[^)]*\)", r"new\s+URLSearchParams\([^)]*\{([^}]+)\}"
SITES = (
    r"""["'](https?://[^"']+/[^"']*)["']""", r"""baseURL\s*[:=]\s*["']([^"']+)["']""", r"""apiBase\s*[:=]\s*["']([^"']+)["']""", r"""API_URL\s*[:=]\s*["']([^"']+)["']""",
    r"""endpointBase\s*[:=]\s*["']([^"']+)["']""",
)
EVALUATED = r"""eval\s*\(\s*["']([^"']+)["']"""
OPTION_CALL, OPTION_KEY = r"""axios\.(?:get|post|put|delete|patch)\(["']([^"']+)["'][^)]*params\s*:\s*\{([^}]+)\}""", r"([a-zA-Z0-9_\-]+)\s*:"


def every(body: Column, patterns: tuple[str, ...], group: int = 1) -> Column:
    """What any of the patterns captures, each value once."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(body, F.lit(to_java(p)), F.lit(group)) for p in patterns))))


def clean_endpoint(e: Column) -> Column:
    strip = lambda c: F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(c, r"""\A["']+|["']+\z""", "")), r"[;,)]+\z", ""), r"""["']+\z""", "")
    return F.when(F.contains(e, F.lit("${")), "").otherwise(strip(strip(e)))


def valid_endpoint(e: Column) -> Column:
    inside = r"""\$\{|\+|\$\d|['"][;)]|[,(&]|Y="""
    address = ~e.startswith("http") | (e.rlike(r"\A[^/]*/[^/]*/[^/]*/[^/]") & ~e.rlike(r"\?family=|\?id="))
    return (F.octet_length(e) >= 2) & ~e.rlike(inside) & ~e.startswith("//") & ~e.rlike(r"""([=.:&?'";)/]|/a|/g)\z""") & ~e.isin(*VERBS) & (e.startswith("/") | e.startswith("http")) & ~F.exists(F.array(*map(F.lit, FOREIGN)), lambda d: F.contains(e, d)) & address


def endpoints(docs: DataFrame, target: str | None = None, source: str = "source", body: str = "body", comments: bool = False, pattern: str | None = None) -> DataFrame:
    """(source, endpoint): full addresses, and paths joined to the bases a body names, else to ``target``, else bare.

    Comments are left out unless ``comments``. ``pattern`` keeps the endpoints that it matches; an unusable one keeps all.
    """
    b = F.col("_b")
    quote = lambda x: F.regexp_replace(x, r"""\A["']+|["']+\z""", "")
    bases = F.filter(F.transform(every(b, BASES), lambda x: F.regexp_replace(quote(x), "/+$", "")), lambda x: x != "")
    found = lambda xs: F.filter(F.transform(xs, lambda x: clean_endpoint(x)), lambda x: valid_endpoint(x))
    rows = _scripts(docs, source, body, comments).select("source", bases.alias("bases"), found(every(b, ENDPOINTS)).alias("paths"), found(every(b, (ADDRESS,), 0)).alias("full"))
    based = F.flatten(F.transform("bases", lambda x: F.transform(F.filter("paths", lambda p: p.startswith("/")), lambda p: F.concat(x, p))))
    alone = F.transform("paths", lambda p: F.when(p.startswith("/"), F.concat(F.lit(f"https://{target}"), p)).otherwise(p)) if target else F.when(F.size("bases") == 0, F.col("paths")).otherwise(F.filter("paths", lambda p: ~p.startswith("/")))
    told = each(rows, F.array_distinct(F.concat("full", based, alone)), "endpoint", "source")
    return told.filter(F.col("endpoint").rlike(to_java(pattern))) if pattern and usable(pattern) else told


def _scripts(docs: DataFrame, source: str, body: str, comments: bool) -> DataFrame:
    """(source, _b): the bodies as they are searched."""
    return docs.select(F.col(source).cast("string").alias("source"), script(F.col(body).cast("string"), comments).alias("_b"))


def _named(p: Column) -> Column:
    return F.octet_length(p).between(1, 99)


def parameters(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, parameter): names in query strings, call arguments and assignments, each once."""
    b = F.col("_b")
    keys = F.flatten(F.transform(F.regexp_extract_all(b, F.lit(to_java(QUERY_STRING)), F.lit(1)), lambda q: F.regexp_extract_all(q, F.lit(QUERY_KEY), F.lit(1))))
    common = F.filter(every(b, PARAMETERS[2:]), lambda p: (F.octet_length(p) > 1) & ~p.isin(*KEYWORDS))
    names = F.filter(F.array_distinct(F.concat(every(b, PARAMETERS[:2]), keys, common)), _named)
    return each(_scripts(docs, source, body, comments), names, "parameter", "source")


def _getters(body: Column) -> Column:
    return F.filter(every(body, GETTERS), _named)


def getter_parameters(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, parameter): names that code reads from its address."""
    return each(_scripts(docs, source, body, comments), _getters(F.col("_b")), "parameter", "source")


def _option_keys(text: Column) -> Column:
    return F.filter(F.regexp_extract_all(text, F.lit(to_java(OPTION_KEY)), F.lit(1)), _named)


def _groups(body: Column, gap: int) -> Column:
    """Names that code reads together: getters less than ``gap`` bytes after the one before, then keys of parameter objects.

    A name counts where it first occurs; an object's keys only if a getter reads them and no group has them yet.
    """
    pattern = F.lit(to_java(GROUPED))
    hits, names, gaps = F.regexp_extract_all(body, pattern, F.lit(0)), F.regexp_extract_all(body, pattern, F.lit(1)), F.split(body, to_java(GROUPED), -1)
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), hits.alias("hit"), names.alias("name"))
    at = running(zipped, F.lit(0), "struct<name:string,pos:int>", lambda s, x: s + F.octet_length(x["gap"]) + F.octet_length(x["hit"]), lambda s, x: F.struct(x["name"].alias("name"), (s + F.octet_length(x["gap"])).alias("pos")))
    first = F.filter(at, lambda x, i: F.array_position(names, x["name"]) == i + 1)
    state = F.struct(F.lit(None).cast("int").alias("last"), F.lit(0).alias("group"))
    number = lambda s, x: s["group"] + F.coalesce((x["pos"] - s["last"] >= gap).cast("int"), F.lit(0))
    told = running(first, state, "struct<name:string,group:int>", lambda s, x: F.struct(x["pos"].alias("last"), number(s, x).alias("group")), lambda s, x: F.struct(x["name"].alias("name"), number(s, x).alias("group")))
    one = F.array(F.struct(told.alias("told"), _getters(body).alias("known"), F.transform(F.regexp_extract_all(body, F.lit(to_java(OBJECT_GROUP)), F.lit(1)), _option_keys).alias("objects")))

    def grouped(d: Column) -> Column:
        numbers = F.array_distinct(F.transform(d["told"], lambda x: x["group"]))
        read = F.transform(numbers, lambda g: F.array_sort(F.transform(F.filter(d["told"], lambda x: x["group"] == g), lambda x: x["name"])))
        fresh = lambda used, keys: F.array_except(F.filter(F.array_distinct(keys), lambda k: F.array_contains(d["known"], k)), used)
        objects = running(d["objects"], F.transform(d["told"], lambda x: x["name"]), "array<string>", lambda used, keys: F.concat(used, fresh(used, keys)), lambda used, keys: F.array_sort(fresh(used, keys)))
        return F.concat(read, F.filter(objects, lambda g: F.size(g) > 0))

    return F.element_at(F.transform(one, grouped), 1)


def parameter_groups(docs: DataFrame, gap: int = 200, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, group_no, parameters): names that code reads together, in groups numbered from 0."""
    return numbered(_scripts(docs, source, body, comments), _groups(F.col("_b"), gap), "group_no", "parameters", "source")


def _origin(source: Column) -> Column:
    return F.nullif(F.regexp_extract(source, r"\Ahttps?://[^/?#]+", 0), F.lit(""))


def _same_domain(source: Column, url: Column) -> Column:
    """Whether an address is of the source's base domain, or the source of none."""
    own = base_domain(host(source))
    return own.isNull() | F.coalesce(base_domain(host(url)) == own, F.lit(False))


def _absolute(source: Column, url: Column) -> Column:
    """The address, behind the source's origin if it is a path; null if that has none."""
    return F.when(url.startswith("http"), url).otherwise(F.concat(_origin(source), url))


def _query(base: Column, keys: Column) -> Column:
    """``base`` with sorted keys as a query without values; null without keys."""
    mark = F.when(F.contains(base, F.lit("?")), "&").otherwise("?")
    return F.when(F.size(keys) > 0, F.concat(base, mark, F.array_join(F.array_sort(keys), "=&"), F.lit("=")))


def _without_values(source: Column, urls: Column) -> Column:
    """Addresses with a query, its keys sorted and their values dropped; those of other base domains go."""
    main = lambda u: F.substring_index(u, "#", 1)
    query = lambda u: F.regexp_extract(main(u), r"(?s)\A[^?]*\?(.*)\z", 1)
    keys = lambda u: F.array_distinct(F.filter(F.transform(F.filter(F.split(query(u), "&"), lambda k: ~F.contains(k, F.lit(";"))), lambda k: F.try_url_decode(F.substring_index(k, "=", 1))), _named))
    base = lambda u: F.when(u.startswith("http"), F.substring_index(main(u), "?", 1)).otherwise(F.concat(F.lit("://"), F.substring_index(main(u), "?", 1)))
    return F.array_compact(F.transform(urls, lambda u: F.when(_same_domain(source, u) & ~u.rlike(r"[\x00-\x1f\x7f]"), _query(base(u), keys(u)))))


def _captured(body: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(body, F.lit(to_java(pattern)), F.lit(group))


def _queried(source: Column, body: Column) -> Column:
    """Addresses with a query: quoted ones, those of ``open`` calls, and of ``fetch`` calls with a second query mark."""
    fetched = F.filter(_captured(body, FETCH_ADDRESS), lambda u: u.startswith("http"))
    return _without_values(source, F.concat(_captured(body, DIRECT_ADDRESS), _captured(body, OPEN_ADDRESS), fetched))


def _templates(source: Column, body: Column) -> Column:
    """Addresses of ``fetch`` calls with a template: its query's keys, and the parameters that its variables were read from."""
    calls = F.arrays_zip(_captured(body, TEMPLATE_CALL, 0).alias("call"), _captured(body, TEMPLATE_CALL).alias("url"))
    read = F.arrays_zip(_captured(body, ASSIGNED).alias("name"), _captured(body, ASSIGNED, 2).alias("parameter"))

    def address(c: Column, known: Column) -> Column:
        base, query = F.substring_index(c["url"], "?", 1), F.get(F.split(c["url"], r"\?"), F.lit(1))
        names = F.transform(_captured(c["call"], TEMPLATE_NAME), lambda v: F.get(F.filter(known, lambda a: F.endswith(a["name"], v)), F.lit(0))["parameter"])
        keys = F.concat(F.array_compact(names), _captured(query, QUERY_KEY))
        return F.when(F.contains(c["url"], F.lit("?")) & base.startswith("http") & _same_domain(source, base), _query(base, keys))

    return F.flatten(F.transform(F.array(read), lambda known: F.array_compact(F.transform(calls, lambda c: address(c, known)))))


def _options(source: Column, body: Column) -> Column:
    """Addresses of calls with an object of parameters."""
    calls = F.arrays_zip(_captured(body, OPTION_CALL).alias("url"), _captured(body, OPTION_CALL, 2).alias("options"))
    return F.array_compact(F.transform(calls, lambda c: F.when(_same_domain(source, _absolute(source, c["url"])), _query(_absolute(source, c["url"]), _option_keys(c["options"])))))


def _objects(source: Column, body: Column) -> Column:
    """Addresses of the nearest call before an object of search parameters."""
    found = F.arrays_zip(_captured(body, OBJECT_CALL, 0).alias("call"), _captured(body, OBJECT_CALL).alias("options"))

    def address(c: Column) -> Column:
        before = F.left(body, F.instr(body, c["call"]) - 1)
        behind = lambda mark: F.when(F.contains(before, F.lit(mark)), F.length(before) - F.length(F.substring_index(before, mark, -1)) - len(mark)).otherwise(-1)
        start = F.greatest(behind("fetch("), behind("axios."))
        url = _absolute(source, F.nullif(F.regexp_extract(F.substr(before, start + 1), r"""["']([^"']+)["']""", 1), F.lit("")))
        return F.when((start > 0) & _same_domain(source, url), _query(url, _option_keys(c["options"])))

    return F.array_compact(F.transform(found, address))


def query_addresses(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, address): addresses with a query in strings and calls, its keys sorted and their values dropped."""
    return _addresses(docs, source, body, comments, _queried)


def template_addresses(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, address): addresses of calls with a template, with the parameters that the template is filled from."""
    return _addresses(docs, source, body, comments, _templates)


def option_addresses(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, address): addresses of calls with an object of parameters, its keys in order as a query without values.

    Paths belong to the source's origin and give no row without one; addresses of other base domains go.
    """
    return _addresses(docs, source, body, comments, _options)


def object_addresses(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, address): addresses of the nearest call before an object of search parameters, with its keys."""
    return _addresses(docs, source, body, comments, _objects)


def _addresses(docs: DataFrame, source: str, body: str, comments: bool, *kinds: Callable[[Column, Column], Column]) -> DataFrame:
    found = F.concat(*(kind(F.col("source"), F.col("_b")) for kind in kinds))
    return each(_scripts(docs, source, body, comments), F.array_distinct(found), "address", "source")


def _site(source: Column, body: Column) -> Column:
    """The first base address that a body names, without its query, else the source's origin."""
    named = (F.nullif(F.regexp_extract(body, to_java(p), 1), F.lit("")) for p in SITES)
    return F.coalesce(F.substring_index(F.coalesce(*named), "?", 1), _origin(source))


def parameter_addresses(docs: DataFrame, gap: int = 200, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, address): all addresses with the parameters that code gives or reads, without their values.

    Names that are read together, and each alone, are joined to the base address; those of other base domains go.
    """

    def read(src: Column, b: Column) -> Column:
        site = _site(src, b)
        groups = F.concat(_groups(b, gap), F.transform(_getters(b), lambda p: F.array(p)))
        return F.coalesce(F.transform(groups, lambda g: F.concat(site, F.lit("/?"), F.array_join(g, "=&"), F.lit("="))), F.array().cast("array<string>"))

    told = _addresses(docs, source, body, comments, _queried, _templates, _options, _objects, read).filter(F.col("address").isNotNull())
    away = base_domain(host(F.col("address"))) != base_domain(host(F.col("source")))
    return told.filter(~F.coalesce(away, F.lit(False)))


def links(docs: DataFrame, source: str = "source", body: str = "body", comments: bool = False) -> DataFrame:
    """(source, link): well-formed addresses, cleaned, outside comments and of the source's base domain."""
    (pattern,) = EXTRA["links"].values()
    found = assess(docs, [legacy_rule(LINK, pattern)], source, body, comments)
    return found.filter("drop_reason is null").select("source", F.col("value").alias("link")).distinct()


def csp_origins(docs: DataFrame, source: str = "source", policy: str = "policy") -> DataFrame:
    """(source, position, origin): origins that a content security policy names, in order, each once."""
    parts = F.flatten(F.transform(F.split(policy, ";"), lambda d: F.filter(F.filter(F.split(F.trim(d), r"[ \t\n\r\f]+"), lambda x: x != ""), lambda x, i: i > 0)))
    kept = F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"""\A["']+|["']+\z""", "")), lambda x: (x != "") & ~x.startswith("*") & ~F.exists(F.array(*map(F.lit, ORIGIN_SKIPS)), lambda s: F.startswith(F.lower(x), s)))
    return numbered(docs, F.array_distinct(kept), "position", "origin", F.col(source).alias("source"))


def inline_scripts(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, body): scripts inside pages, as ``url#inline[N]``.

    Blank and unfinished ones are counted but give no row; those with an address or that close themselves are not counted.
    """
    own = lambda t: (F.coalesce(attribute(t, "src"), F.lit("")) == "") & ~t["closes_itself"]
    rows = numbered(pages, F.filter(tags(F.col(html), "script"), own), "i", "t", F.col(url).alias("u"))
    found = rows.filter(F.col("t.ended") & (F.regexp_replace("t.text", r"\A\s+", "") != ""))
    return found.select(F.concat("u", F.lit("#inline["), "i", F.lit("]")).alias("source"), F.col("t.text").alias("body"))


def script_references(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, kind, reference, type, integrity, nonce, is_async, is_defer): external scripts, and preload, prefetch and modulepreload links."""
    rows = each(pages, tags(F.col(html), "script", "link"), "t", F.col(url).alias("source"))
    t = F.col("t")
    is_script, rel = t["name"] == "script", F.lower(attribute(t, "rel"))
    kind = F.when(is_script, "script").when((rel == "modulepreload") | (rel.isin("preload", "prefetch") & (F.lower(attribute(t, "as")) == "script")), rel)
    reference = F.when(is_script, attribute(t, "src")).otherwise(attribute(t, "href"))
    more = [attribute(t, n).alias(n) for n in ("type", "integrity", "nonce")]
    flags = [attribute(t, n).isNotNull().alias(f"is_{n}") for n in ("async", "defer")]
    return rows.select("source", kind.alias("kind"), reference.alias("reference"), *more, *flags).filter("kind is not null and reference <> ''")


def meta_policies(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(source, policy): content security policies of pages, as ``url#meta-csp``."""
    named = lambda t: F.lower(F.coalesce(attribute(t, "http-equiv"), F.lit(""))) == "content-security-policy"
    rows = each(pages, F.filter(tags(F.col(html), "meta"), named), "t", F.col(url).alias("u"))
    return rows.select(F.concat("u", F.lit("#meta-csp")).alias("source"), attribute(F.col("t"), "content").alias("policy")).filter("policy <> ''")


def source_map_members(docs: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """(source, body): files embedded in the data-URI source map that a body's first marker names."""
    ref = F.regexp_extract(body, SOURCE_MAP.replace("$", r"(?:\z|$)"), 1)
    data = F.regexp_extract(ref, r"(?s)\Adata:[^,]*,(.*)", 1)
    text = F.when(ref.rlike(r"\Adata:[^,]*;base64,"), F.try_to_binary(F.translate(data, "-_", "+/"), F.lit("base64")).cast("string")).otherwise(F.try_url_decode(data))
    return _members(docs.filter(ref.startswith("data:")).select(F.col(source).alias("s"), F.from_json(text, MAP).alias("m")))


def map_members(maps: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """(source, body): files embedded in source maps that were fetched for a source."""
    return _members(maps.select(F.col(source).alias("s"), F.from_json(body, MAP).alias("m")))


def _members(rows: DataFrame) -> DataFrame:
    zipped = F.arrays_zip(F.col("m.sources").alias("name"), F.col("m.sourcesContent").alias("body"))
    members = numbered(rows, zipped, "i", "z", "s", F.coalesce("m.sourceRoot", F.lit("")).alias("root")).filter("z.body <> ''")
    name = F.when(F.coalesce("z.name", F.lit("")) == "", F.concat(F.lit("sources["), "i", F.lit("]"))).when((F.col("root") == "") | F.col("z.name").rlike(r"\A(/|[a-z]+://)"), F.col("z.name")).otherwise(F.concat(F.regexp_replace("root", "/+$", ""), F.lit("/"), "z.name"))
    return members.select(F.concat("s", F.lit(".map#"), name).alias("source"), F.col("z.body").alias("body"))


def resolved(base: Column, reference: Column) -> Column:
    """A reference resolved against an absolute address, dot segments removed (RFC 3986); null without a scheme in either."""
    scheme, origin = F.regexp_extract(base, r"(?i)\A([a-z][a-z0-9+.-]*):", 1), F.regexp_extract(base, r"(?i)\A[a-z][a-z0-9+.-]*://[^/?#]*", 0)
    path = F.substr(F.regexp_extract(base, r"\A[^?#]*", 0), F.length(origin) + 1)
    folder = F.regexp_replace(path, r"[^/]*\z", "")
    joined = (
        F.when(reference.rlike(r"(?i)\A[a-z][a-z0-9+.-]*:"), reference).when(scheme == "", F.lit(None)).when(reference.startswith("//"), F.concat(scheme, F.lit(":"), reference))
        .when(reference.startswith("/"), F.concat(origin, reference)).when(reference == "", F.regexp_extract(base, r"\A[^#]*", 0)).when(reference.startswith("?"), F.concat(origin, path, reference))
        .when(reference.startswith("#"), F.concat(F.regexp_extract(base, r"\A[^#]*", 0), reference)).otherwise(F.concat(origin, F.when(folder == "", "/").otherwise(folder), reference))
    )
    head, tail = F.regexp_extract(joined, r"(?i)\A[a-z][a-z0-9+.-]*://[^/?#]*", 0), F.regexp_extract(joined, r"[?#].*\z", 0)
    whole = F.substr(F.regexp_extract(joined, r"\A[^?#]*", 0), F.length(head) + 1)
    parts = F.split(whole, "/")
    step = lambda acc, x: F.when(x == ".", acc).when(x == "..", F.when(F.size(acc) > 1, F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(acc)).otherwise(F.concat(acc, F.array(x)))
    kept = F.aggregate(parts, F.expr("cast(array() as array<string>)"), step)
    closed = F.when(whole.rlike(r"/\.\.?\z"), F.concat(kept, F.array(F.lit("")))).otherwise(kept)
    return F.when(whole.rlike(r"(\A|/)\.\.?(/|\z)"), F.concat(head, F.array_join(closed, "/"), tail)).otherwise(joined)


def source_map_references(docs: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """(source, url): where the source map of a body stands, unless it is embedded; resolved against the source's address."""
    ref = F.regexp_extract(body, SOURCE_MAP.replace("$", r"(?:\z|$)"), 1)
    return docs.select(F.col(source).alias("source"), ref.alias("ref")).filter((F.col("ref") != "") & ~F.col("ref").startswith("data:")).select("source", resolved(F.col("source"), F.col("ref")).alias("url")).filter("url is not null")


def robots_rules(files: DataFrame, agent: str = "*", host_column: str = "host", body: str = "body") -> DataFrame:
    """(host, kind, path): what robots files allow and forbid ``agent``, and their sitemaps.

    Lines up to a blank one form a group; its rules count from the first user-agent line on that names the agent or
    ``*``. Lines without a colon are passed over; sitemaps always count.
    """
    rows = files.select(F.col(host_column).alias("host"), F.split(body, "\r?\n").alias("lines"))

    def told(raw: Column) -> Column:
        t = F.regexp_replace(F.regexp_replace(raw, "#.*", ""), r"\A\s+|\s+\z", "")
        return F.struct(F.when(F.contains(t, F.lit(":")), F.lower(F.regexp_replace(F.substring_index(t, ":", 1), r"\s+\z", ""))).alias("key"), F.regexp_extract(t, r"(?s)\A[^:]*:\s*(.*)\z", 1).alias("value"), (t == "").alias("blank"))

    mine = lambda x: (x["key"] == "user-agent") & F.lower(x["value"]).isin("*", agent.lower())
    after = lambda on, x: F.when(x["blank"], F.lit(False)).otherwise(on | F.coalesce(mine(x), F.lit(False)))
    walked = running(F.transform("lines", told), F.lit(False), "struct<key:string,value:string,active:boolean>", after, lambda on, x: F.struct(x["key"].alias("key"), x["value"].alias("value"), on.alias("active")))
    rows = each(rows, walked, "x", "host").select("host", "x.*")
    return rows.filter(((F.col("key") == "sitemap") | (F.col("active") & F.col("key").isin("allow", "disallow") & (F.col("value") != "")))).select("host", F.col("key").alias("kind"), F.col("value").alias("path"))


def eval_strings(docs: DataFrame, source: str = "source", body: str = "body") -> DataFrame:
    """(source, code): string arguments of eval."""
    return each(docs, F.regexp_extract_all(body, F.lit(to_java(EVALUATED)), F.lit(1)), "code", F.col(source).alias("source"))


def obfuscated(body: Column) -> Column:
    n = lambda t: (F.length(body) - F.length(F.replace(body, F.lit(t), F.lit("")))) / len(t)
    return ((F.octet_length(body) > 1000) & (n("\\x") > 50)) | (F.contains(body, F.lit("eval(")) & (n("String.fromCharCode") > 10))


def unescaped(body: Column) -> Column:
    """The body without the two-letter marks of hexadecimal and Unicode escapes."""
    return F.replace(F.replace(body, F.lit("\\x"), F.lit("")), F.lit("\\u"), F.lit(""))

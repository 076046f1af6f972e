"""Inputs as documents: (source, body) rows from files, responses, HAR logs, crawls and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions.text import public_target
from glintscan.operators.scan import MAX_BYTES, SCHEMA_VERSION, capped, out_of_scope
from glintscan.sources.shared import written

# Media types that count as script, and those that do not although their address may.
SCRIPT_TYPES = ("application/javascript", "application/x-javascript", "text/javascript", "text/ecmascript", "application/ecmascript", "text/jscript")
OTHER_TYPES = ("text/html", "application/xhtml+xml", "application/json", "text/css", "application/xml", "image/svg+xml", "application/pdf")
HAR = "log struct<entries:array<struct<request:struct<url:string>,response:struct<status:int,content:struct<mimeType:string,text:string,encoding:string>>>>>"


def spread(docs: DataFrame) -> DataFrame:
    """Rows dealt over all cores where a table comes in fewer pieces than there are cores, as scans are bound by CPU; else as it is."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))


def targets(spark: SparkSession, path: str, allow_internal: bool = False) -> DataFrame:
    """Addresses, one a line, that may be fetched."""
    return spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''").filter(public_target(F.col("url"), allow_internal))


def header(headers: Column, name: str) -> Column:
    """A header's value, whatever the case of its name."""
    return F.get(F.map_values(F.map_filter(headers, lambda k, v: F.lower(k) == name)), F.lit(0))


def is_page(body: Column) -> Column:
    """Whether a body begins as an HTML page."""
    return F.lower(F.trim(F.substring(body, 1, 512))).rlike(r"\A\s*<(!doctype|html|head|body)")


def targets_or_files(spark: SparkSession, given: list[str], allow_internal: bool = False) -> tuple[DataFrame, DataFrame]:
    """Of what a user names, the addresses that may be fetched, and the bodies of the rest as local files."""
    urls = [x for x in given if x.lower().startswith(("http://", "https://"))]
    paths = [x for x in given if x not in urls]
    found = spark.createDataFrame([(u,) for u in urls], "url string")
    bodies = files(spark, paths) if paths else spark.createDataFrame([], "source string, body string")
    return found.filter(public_target(F.col("url"), allow_internal)), bodies


def admitted(responses: DataFrame, inline_html: bool = False) -> DataFrame:
    """Documents among responses (url, status, headers, body): successful scripts, and pages where asked for."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(header(F.col("headers"), "content-type"), F.lit("")), ";", 1)))
    named = F.lower("url").rlike(r"\.js(\z|[?&#])")
    script = kind.isin(*SCRIPT_TYPES) | (named & ~kind.isin(*OTHER_TYPES) & ~kind.startswith("text/"))
    page = F.lit(inline_html) & (F.contains(kind, F.lit("html")) | is_page(F.col("body").cast("string")))
    return responses.filter(F.col("status").between(200, 299) & (script | page)).select(F.col("url").alias("source"), F.col("body").cast("string").alias("body"))


def limited(docs: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Documents of responses, HAR logs or source maps with at most ``max_bytes`` of body; ``truncated`` tells which were cut.

    Only on request: no other reader and no scan cuts a body.
    """
    return docs.withColumn("truncated", F.octet_length("body") > max_bytes).withColumn("body", capped(F.col("body"), max_bytes))


def har(spark: SparkSession, path: str) -> DataFrame:
    """Script bodies of a HAR log."""
    return har_entries(spark.read.schema(HAR).json(path, multiLine=True))


def har_entries(logs: DataFrame) -> DataFrame:
    e = logs.select(F.explode("log.entries").alias("e")).select(F.col("e.request.url").alias("url"), "e.response.status", "e.response.content.*")
    script = F.lower(F.coalesce("mimeType", F.lit(""))).rlike("javascript|ecmascript") | F.lower("url").rlike(r"\.js(\z|\?)")
    raw = F.regexp_replace(F.translate("text", "-_", "+/"), r"[\s=]", "")
    decoded = F.try_to_binary(F.concat(raw, F.repeat(F.lit("="), F.pmod(-F.length(raw), F.lit(4)))), F.lit("base64")).cast("string")
    body = F.when(F.lower(F.coalesce("encoding", F.lit(""))) == "base64", F.coalesce(decoded, F.col("text"))).otherwise(F.col("text"))
    return e.filter(F.col("status").between(200, 399) & script).select(F.col("url").alias("source"), body.alias("body")).filter("body <> ''")


def earlier_hashes(spark: SparkSession, path: str) -> DataFrame:
    """Value hashes of an earlier envelope; another schema version is an error."""
    found = spark.read.schema("schema_version int, findings array<struct<value_hash:string>>").json(path, multiLine=True)
    wrong = F.raise_error(F.concat(F.lit("schema_version "), F.coalesce(F.col("schema_version").cast("string"), F.lit("missing")))).cast("string")
    return found.select(F.explode("findings").alias("f"), "schema_version").select(F.when(F.col("schema_version") == SCHEMA_VERSION, F.col("f.value_hash")).otherwise(wrong).alias("value_hash")).distinct()


def cached(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Addresses with what the cache holds for them; the key is the address's SHA-256."""
    return urls.withColumn("key", F.sha2("url", 256)).join(cache.drop("url"), "key", "left").withColumn("hit", F.col("body").isNotNull())


def line_kinds(lines: DataFrame, column: str = "value") -> DataFrame:
    """How a list of lines is to be read: as addresses, as code, or as plain lines."""
    x = F.trim(column)
    code = x.rlike(r"function\s|=>|\bvar\s|\blet\s|\bconst\s|[{};]\s*\z")
    told = lines.filter(x != "").agg(F.count("*").alias("n"), F.count_if(x.rlike(r"\Ahttps?://")).alias("urls"), F.count_if(code).alias("code"), F.coalesce(F.max(F.contains(x, F.lit("function "))), F.lit(False)).alias("has_function"))
    return told.select("n", "urls", "code", F.when(2 * F.col("urls") > F.col("n"), "urls").when((F.col("code") > 5) | F.col("has_function"), "code").otherwise("lines").alias("kind"))


# Fixed value: what counts as a reference to a script.
REFERENCE = r"""(?:src|href)\s*=\s*["']([^"']+\.js[^"']*)["']"""


def crawl(pages: DataFrame, seeds: DataFrame, depth: int, domain: str | None = None, extensions: tuple[str, ...] = ()) -> DataFrame:
    """(url, depth): scripts reachable from ``seeds`` over the references of ``pages`` (url, html), breadth first.

    Only addresses that hold ``domain`` and end in one of ``extensions`` are followed. Each level is written down.
    """
    found = F.regexp_extract_all("html", F.lit(REFERENCE), F.lit(1))
    root = F.regexp_extract("from", r"\A(https?://[^/]+)", 1)
    link = F.when(F.col("ref").rlike(r"\Ahttps?://"), F.col("ref")).when(F.col("ref").startswith("//"), F.concat(F.lit("https:"), "ref")).when(F.col("ref").startswith("/"), F.concat(root, "ref")).otherwise(F.concat(root, F.lit("/"), "ref"))
    edges = pages.select(F.col("url").alias("from"), F.explode(F.array_distinct(found)).alias("ref")).select("from", link.alias("url"))
    edges = written(edges.filter(~out_of_scope(F.col("url"), domain, extensions)).distinct(), "edges")
    seen = level = written(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    for d in range(1, depth + 1):
        level = written(edges.join(level.select(F.col("url").alias("from")), "from").select("url").distinct().join(seen, "url", "left_anti").withColumn("depth", F.lit(d)), "level")
        seen = seen.union(level)
    return seen

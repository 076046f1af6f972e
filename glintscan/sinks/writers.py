"""Reports of findings as rows of text, ready for Spark's writers."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.functions.text import report_level, severity_rank
from glintscan.functions.validators import VALIDATORS
from glintscan.operators.findings import KEY, VERIFIABLE, with_locations
from glintscan.operators.scan import SCHEMA_VERSION
from glintscan.rules.model import Rule

NAME, VERSION = "glintscan", "1"
SARIF_SCHEMA, SARIF_VERSION = "https://json.schemastore.org/sarif-2.1.0.json", "2.1.0"
#: Results of one SARIF document; a larger report is several documents.
PER_DOCUMENT = 5_000


def public(findings: DataFrame, values: bool = False) -> DataFrame:
    """Findings without their values unless asked for."""
    return findings if values else findings.drop("value")


def ndjson(findings: DataFrame, values: bool = False) -> DataFrame:
    """One JSON object for each finding, in report order."""
    rows = public(findings, values)
    return rows.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "name", "value_hash").select(F.to_json(F.struct(*rows.columns)).alias("value"))


def _tool() -> Column:
    return F.struct(F.lit(NAME).alias("name"), F.lit(VERSION).alias("version")).alias("tool")


def envelope(matches: DataFrame, findings: DataFrame, places: DataFrame, values: bool = False) -> DataFrame:
    """One JSON document for each source: its matches by name, the findings first seen there, and the tool.

    ``matches`` are kept matches of all rules, as ``findings.all_matches`` gives them; a source's document is as
    large as what was found in it. Findings carry only their places within the source.
    """
    shown = "value" if values else "redacted"
    named = matches.groupBy("source", "name").agg(F.sort_array(F.collect_list(shown)).alias("values")).groupBy("source").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "values")))).alias("matches"))
    own = places.join(findings.select(*KEY, "source"), [*KEY, "source"], "left_semi")
    rows = public(with_locations(findings, own), values)
    key = F.struct((-severity_rank(F.col("severity"))).alias("a"), (-F.col("confidence")).alias("b"), "name", "value_hash")
    each = rows.groupBy("source").agg(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), F.struct(*rows.columns).alias("f")))), lambda x: x["f"]).alias("findings"))
    both = named.join(each, "source", "full")
    found = F.coalesce("findings", F.array().cast(each.schema["findings"].dataType)).alias("findings")
    document = F.struct(F.lit(SCHEMA_VERSION).alias("schema_version"), "source", F.coalesce("matches", F.expr("cast(map() as map<string,array<string>>)")).alias("matches"), found, _tool())
    return both.select("source", F.to_json(document).alias("value"))


def sarif_results(findings: DataFrame, places: DataFrame) -> DataFrame:
    """One result for each place of each finding."""
    at = findings.drop("source", "line", "column").join(places.select(*KEY, "source", "line", "column"), [*KEY])
    text = F.format_string("%s detected (confidence=%.2f, verified=%s)", "name", "confidence", F.col("verified").cast("string"))
    return at.select(
        "rule_id", report_level(F.col("severity")).alias("level"), text.alias("message"), F.col("source").alias("uri"), F.nullif(F.col("line"), F.lit(0)).alias("start_line"),
        F.nullif(F.col("column"), F.lit(0)).alias("start_column"), "value_hash", F.concat_ws(":", "rule_id", "secret_type").alias("rule_secret_type"),
        F.struct("confidence", "verified", "value_hash", "redacted", "entropy", "reasons").alias("properties"),
    )


def sarif(findings: DataFrame, places: DataFrame, rules: Iterable[Rule], per_document: int = PER_DOCUMENT) -> DataFrame:
    """SARIF documents, one a row, of about ``per_document`` results each; one without results if there are none."""
    r = sarif_results(findings, places)
    place = F.struct(F.struct(F.struct(F.col("uri").alias("uri")).alias("artifactLocation"), F.when(F.col("start_line").isNotNull(), F.struct(F.col("start_line").alias("startLine"), F.col("start_column").alias("startColumn"))).alias("region")).alias("physicalLocation"))
    prints = F.struct(F.col("value_hash").alias(f"{NAME}/valueHash"), F.col("rule_secret_type").alias(f"{NAME}/ruleSecretType"))
    result = F.struct(F.col("rule_id").alias("ruleId"), "level", F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"), prints.alias("partialFingerprints"), "properties")
    spark = findings.sparkSession
    size = max(1, -(-places.count() // per_document))
    numbers = spark.range(size).select(F.col("id").alias("document"))
    each = r.select(F.pmod(F.xxhash64("uri", "start_line", "start_column", "value_hash", "rule_secret_type"), F.lit(size)).alias("document"), result.alias("r"))
    grouped = numbers.join(each.groupBy("document").agg(F.array_sort(F.collect_list(F.to_json("r"))).alias("results")), "document", "left")
    told = [{"id": x.id, "name": x.name, "shortDescription": {"text": x.name}, "defaultConfiguration": {"level": level(x.severity)}, "properties": {"provider": x.provider, "secret_type": x.secret_type, "severity": x.severity}} for x in rules if x.kind != "legacy"]
    head = json.dumps({"$schema": SARIF_SCHEMA, "version": SARIF_VERSION})[:-1] + ', "runs": [{"tool": {"driver": ' + json.dumps({"name": NAME, "version": VERSION, "rules": told}) + '}, "results": ['
    return grouped.select(F.concat(F.lit(head), F.coalesce(F.array_join("results", ","), F.lit("")), F.lit("]}]}")).alias("value"))


def level(severity: str) -> str:
    """Report level of a severity, as ``report_level`` gives it for columns."""
    return {"critical": "error", "high": "error", "medium": "warning", "low": "note"}.get(severity, "none")


def table_rows(rows: DataFrame) -> DataFrame:
    """Source, type and value of matches, for CSV and tab-separated files."""
    return rows.select(F.col("source").alias("Source"), F.col("name").alias("Type"), F.col("value").alias("Value")).distinct()


def tab_lines(rows: DataFrame) -> DataFrame:
    """Source, name and value of each match, tab-separated."""
    return rows.select(F.concat_ws("\t", "source", "name", "value").alias("value"))


def console(rows: DataFrame, values: bool = False) -> DataFrame:
    """A line for each (name, value) of kept matches, under the least source that holds it."""
    shown = F.col("value" if values else "redacted")
    first = rows.groupBy("name", "value").agg(F.min("source").alias("source"), F.first(shown).alias("shown"))
    return first.select("source", F.format_string("Sensitive Data [%s]: %s", "name", "shown").alias("line"))


def text_blocks(rows: DataFrame, head: str = "URL:") -> DataFrame:
    """For each source a block of text: ``head`` and the source, then a line for each match."""
    line = F.struct("name", "start", F.format_string("Sensitive Data [%s]: %s", "name", "value").alias("line"))
    each = rows.groupBy("source").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("lines"))
    return each.select(F.concat(F.lit(f"{head} "), "source", F.lit("\n"), "lines").alias("value"))


def endpoint_blocks(endpoints: DataFrame) -> DataFrame:
    """For each source a block of text with its endpoints."""
    each = endpoints.groupBy("source").agg(F.array_sort(F.collect_set("endpoint")).alias("e"))
    return each.select(F.concat(F.lit("SOURCE: "), "source", F.lit("\n"), F.array_join(F.transform("e", lambda x: F.concat(F.lit("ENDPOINT: "), x)), "\n"), F.lit("\n")).alias("value"))


def policy_lines(origins: DataFrame) -> DataFrame:
    return origins.select(F.concat(F.lit("[CSP] "), "source", F.lit("\t"), "origin").alias("value"))


def robots_lines(rules: DataFrame) -> DataFrame:
    """Lines of robots rules (host, kind, path): paths behind their host, sitemaps as they are."""
    base = F.regexp_replace("host", "/+$", "")
    return rules.select(F.when(F.col("kind") == "sitemap", F.concat(F.lit("Sitemap  "), "path")).when(F.col("kind") == "allow", F.concat(F.lit("Allow    "), base, "path")).otherwise(F.concat(F.lit("Disallow "), base, "path")).alias("value"))


def rule_listing(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, severity, provider, name, flags) of strict rules; flags tell of context, validator, noise and liveness checks."""
    rows = []
    for r in rules:
        if r.kind != "legacy":
            marks = [m for m, on in (("ctx", r.requires_context), ("validate", bool(r.validator)), ("high-fp", r.high_fp), ("verify", r.id in VERIFIABLE)) if on]
            rows.append((r.id, r.severity, r.provider, r.name, ",".join(marks)))
    return spark.createDataFrame(sorted(rows), "rule_id string, severity string, provider string, name string, flags string")


def explained(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """(rule_id, value): each strict rule as a JSON object."""
    fields = "id string, name string, provider string, secret_type string, severity string, pattern string, confidence_prior double, requires_context boolean, context_keywords array<string>, min_entropy double, min_len int, max_len int, high_fp_prone boolean, has_validator boolean, has_verifier boolean"
    rows = [(r.id, r.name, r.provider, r.secret_type, r.severity, r.pattern, r.prior, r.requires_context, list(r.context) or None, r.min_entropy or None, r.min_len or None, r.max_len or None, r.high_fp, r.validator in VALIDATORS, r.id in VERIFIABLE) for r in rules if r.kind != "legacy"]
    found = spark.createDataFrame(rows, fields)
    return found.select(F.col("id").alias("rule_id"), F.to_json(F.struct(*found.columns)).alias("value"))

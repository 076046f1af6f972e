"""Whole runs: from responses to documents, matches, findings and views."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.operators import extract, findings, scan
from glintscan.rules import catalog
from glintscan.rules.model import Rule
from glintscan.sources import readers


def documents(responses: DataFrame, inline_html: bool = False, source_maps: bool = False, eval_strings: bool = False, max_bytes: int | None = scan.MAX_BYTES) -> DataFrame:
    """(source, body) of all that a run scans in responses (url, status, headers, body).

    Successful scripts, cut at ``max_bytes`` (None: whole); with ``inline_html`` pages and the scripts inside them;
    with ``source_maps`` the files that maps embed, and those of maps that are among the responses; with
    ``eval_strings`` what is passed to eval.
    """
    own = readers.admitted(responses, inline_html)
    found = own if max_bytes is None else readers.limited(own, max_bytes).select("source", "body")
    more = [found]
    if inline_html:
        more.append(extract.inline_scripts(found.filter(readers.is_page(F.col("body"))), "source", "body"))
    if source_maps:
        maps = extract.source_map_references(found).join(responses.filter(F.col("status").between(200, 299)).select("url", F.col("body").cast("string").alias("body")), "url").select("source", "body")
        more += [extract.source_map_members(found), extract.map_members(maps)]
    if eval_strings:
        more.append(extract.eval_strings(found).select(F.concat("source", F.lit("#eval")).alias("source"), F.col("code").alias("body")))
    out = more[0]
    for each in more[1:]:
        out = out.unionByName(each)
    return out


def rules(pack: str | None = None, only: Iterable[str] = (), disabled: Iterable[str] = (), **flags: bool) -> list[Rule]:
    """The rules of a run: built-in ones by flag and by glob; those of a ``pack`` come after the selection."""
    own = catalog.only_and_disabled(catalog.built_in(), only, disabled)
    kept = {r.id for r in own}
    chosen = [r for r in catalog.selected(catalog.built_in(), **flags) if r.kind == "legacy" or r.id in kept]
    return [*chosen, *(catalog.parse_pack(pack, kept) if pack else ())]


def views(docs: DataFrame, use: Iterable[Rule], prefix: str = "scan_", **options: object) -> None:
    """Temporary views for SQL: ``<prefix>matches``, ``<prefix>findings``, ``<prefix>places`` and ``<prefix>rules``."""
    use = list(use)
    every = findings.all_matches(docs, use, **options)
    strict = every.filter("kind <> 'legacy'")
    every.createOrReplaceTempView(f"{prefix}matches")
    findings.merged(strict).createOrReplaceTempView(f"{prefix}findings")
    findings.places(strict).createOrReplaceTempView(f"{prefix}places")
    catalog.as_table(docs.sparkSession, use).createOrReplaceTempView(f"{prefix}rules")

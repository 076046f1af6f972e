"""All rules: built in, external packs, and selections by flag and by glob."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession

from glintscan.rules import legacy
from glintscan.rules.model import Rule
from glintscan.rules.registry import REGISTRY
from glintscan.rules.translate import to_java

# Severities from high to low, other spellings, and names of legacy detectors with stricter gates.
SEVERITIES = ("critical", "high", "medium", "low", "info")
SPELLINGS = {"crit": "critical", "med": "medium", "informational": "info"}
STRICT_PREFIX, STRICT_PARTS = "generic ", ("quickbooks", "cisco access", "sanity", "atlassian access", "heroku")
# Detectors that a flag adds.
EXTRA = {
    "jwt": {"JWT Token": r"ey[A-Za-z0-9-_=]+\.[A-Za-z0-9-_=]+\.?[A-Za-z0-9-_.+/=]*"},
    "graphql": {
        "GraphQL URL": r"""(?i)["']([^"']*\/graphql[^"']*)["']""",
        "GraphQL API Call": r"""(?i)(?:fetch|axios|request|post|get)\s*\([^)]*["']([^"']*\/graphql[^"']*)["']""",
        "GraphQL Endpoint": r"""(?i)(?:graphql|gql)[\s]*[:=][\s]*["']([^"']+)["']""",
        "GraphQL Query": r"(?i)\b(?:query|mutation|subscription)\s+\w+\s*\{[^}]+\}",
        "GraphQL Config": r"""(?i)["'](?:graphql_?endpoint|graphql_?url|graphql_?api|gql_?endpoint)["']\s*[:=]\s*["']([^"']+)["']""",
    },
    "links": {"Link/URL": r"""(https?://[^\s"'<>,;\\()]+)"""},
}
UNFILTERED = ("Link/URL", "Parameter", "Email")


def unfiltered(name: str) -> bool:
    """Legacy names that the false-positive filter leaves alone."""
    return name in UNFILTERED or name.startswith(("GraphQL ", "Firebase Url"))


def legacy_rule(name: str, pattern: str, tags: tuple[str, ...] = ()) -> Rule:
    lower = name.lower()
    strict = lower.startswith(STRICT_PREFIX) or any(p in lower for p in STRICT_PARTS)
    return Rule(f"legacy:{name}", name, "", "", "", pattern, group=int(re.compile(pattern).groups > 0), prior=0.55, high_fp=strict, kind="legacy", tags=tags + (("unfiltered",) if unfiltered(name) else ()))


def built_in() -> list[Rule]:
    security = set(legacy.SECURITY)
    return [*REGISTRY, *(legacy_rule(n, p, ("security",) if n in security else ()) for n, p in legacy.PATTERNS.items())]


def selected(rules: Iterable[Rule], *, security: bool = False, jwt: bool = False, firebase: bool = False, graphql: bool = False, links: bool = False, internal: bool = False) -> list[Rule]:
    """Registry rules always; all legacy detectors, or those of the given flags (``internal`` alone takes none)."""
    rules = list(rules)
    if not (security or jwt or firebase or graphql or links or internal):
        return rules
    found = {r.id: r for r in rules if r.kind != "legacy" or (security and "security" in r.tags) or (firebase and r.name in ("Firebase", "Firebase Url"))}
    for on, group in ((jwt, "jwt"), (graphql, "graphql"), (links, "links")):
        found |= {f"legacy:{n}": legacy_rule(n, p) for n, p in EXTRA[group].items()} if on else {}
    return list(found.values())


def glob_regex(glob: str) -> str | None:
    """A whole-match pattern for a path glob: ``*`` and ``?`` stop at ``/``, but ``*`` alone takes all; None if malformed."""
    if glob == "*":
        return r"(?s)\A.*\z"
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "\\":
            i += 1
            if i == len(glob):
                return None
            out.append(re.escape(glob[i]))
        elif c == "[":
            end = glob.find("]", i + 2 + glob.startswith("^", i + 1))
            if end < 0:
                return None
            body = glob[i + 1 : end]
            out.append("[" + ("^" if body[0] == "^" else "") + body.lstrip("^").replace("[", "\\[").replace("&", "\\&") + "]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return rf"(?s)\A{''.join(out)}\z"


def only_and_disabled(rules: Iterable[Rule], only: Iterable[str] = (), disabled: Iterable[str] = ()) -> list[Rule]:
    """Rules whose ids match any glob of ``only`` (all, if there is none), without those matching one of ``disabled``."""
    hit = lambda r, globs: any((p := glob_regex(g)) and re.search(p.replace(r"\z", r"\Z"), r.id) for g in globs)
    only, disabled = list(only), list(disabled)
    return [r for r in rules if (not only or hit(r, only)) and not hit(r, disabled)]


def parse_pack(text: str, known: Iterable[str] = ()) -> list[Rule]:
    """Rules of a JSON pack; a fault in any rule rejects the whole pack."""
    rows = json.loads(text)
    if not isinstance(rows, list):
        raise ValueError("a rule pack is an array")
    seen, found = set(known), []
    for n, r in enumerate(rows):
        rid, pattern = r.get("id", ""), r.get("pattern", "")
        where = f"rule {n} ({rid or 'no id'})"
        if not rid or rid in seen:
            raise ValueError(f"{where}: id is missing or not unique")
        if not pattern or len(pattern.encode()) > 4096:
            raise ValueError(f"{where}: pattern is missing or too long")
        try:
            groups = re.compile(pattern).groups
        except re.error as e:
            raise ValueError(f"{where}: {e}") from None
        severity = SPELLINGS.get(s := str(r.get("severity", "")).strip().lower(), s)
        if severity not in SEVERITIES:
            raise ValueError(f"{where}: unknown severity {severity!r}")
        prior = float(r.get("confidence_prior", 0))
        if not 0 <= prior <= 1:
            raise ValueError(f"{where}: prior outside [0, 1]")
        group = int(r.get("group", 0))
        if not 0 <= group <= groups:
            raise ValueError(f"{where}: no group {group}")
        seen.add(rid)
        found.append(Rule(rid, r.get("name") or rid, r.get("provider", ""), r.get("secret_type", ""), severity, pattern, group, prior or 0.55, float(r.get("min_entropy", 0)), int(r.get("min_len", 0)), int(r.get("max_len", 0)), bool(r.get("high_fp_prone")), bool(r.get("requires_context")), tuple(r.get("context_keywords") or ()), kind="external"))
    return found


def as_table(spark: SparkSession, rules: Iterable[Rule]) -> DataFrame:
    """Rules as rows, ordered by id, with the flags that a listing shows."""
    rows = [{**asdict(r), "context": list(r.context), "tags": list(r.tags), "java": to_java(r.pattern)} for r in sorted(rules, key=lambda r: r.id)]
    fields = "id string, name string, provider string, secret_type string, severity string, pattern string, java string, group int, prior double, min_entropy double, min_len int, max_len int, high_fp boolean, requires_context boolean, context array<string>, validator string, kind string, tags array<string>"
    return spark.createDataFrame(rows, fields)

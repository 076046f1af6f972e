"""Findings: matches merged by value, suppressed, ordered, verified, and counted."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from glintscan.functions.text import severity_rank
from glintscan.operators.scan import MAX_BYTES, MIN_CONFIDENCE, SCHEMA_VERSION, assess, identified, matches, scored
from glintscan.rules.catalog import glob_regex
from glintscan.rules.model import Rule

#: Rules that a liveness result may refer to. Fixed values.
VERIFIABLE = (
    "stripe.secret_key", "stripe.restricted_key", "github.pat_classic", "github.fine_grained_pat", "openai.legacy_key", "openai.project_key", "openai.svcacct_key",
    "anthropic.api_key", "slack.user_or_bot_token", "slack.app_token", "sendgrid.api_key", "mailgun.api_key", "huggingface.token",
)


def ignored(entries: Iterable[str], get: Callable[[str], Column] = F.col) -> Column:
    """Condition of an ignore list: ``hash:``, ``rule:``, ``source:`` and ``rule_value:<rule>:<glob>`` lines."""
    found = F.lit(False)
    for number, line in enumerate(entries, 1):
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        kind, _, rest = line.partition(":")
        match = lambda column, glob: column.rlike(p) if (p := glob_regex(glob)) else F.lit(False)
        if kind == "hash" and rest:
            found = found | (get("value_hash") == rest)
        elif kind in ("rule", "source") and rest:
            found = found | match(get("id" if kind == "rule" else "source"), rest)
        elif kind == "rule_value" and ":" in rest:
            rule, _, value = rest.partition(":")
            found = found | (match(get("id"), rule) & match(get("value"), value))
        else:
            raise ValueError(f"line {number}: {line!r} is no ignore entry")
    return found


def ignore_entries(spark: SparkSession, path: str) -> list[str]:
    """Lines of an ignore list. Lists are written by hand; their lines become conditions, so they are read whole."""
    return [r["value"] for r in spark.read.text(path).collect()]


#: Lengths of literal beginnings by which globs are looked up.
_BEGINNINGS = (32, 16, 8, 4, 2, 1, 0)


def ignore_table(lines: DataFrame, column: str = "value") -> DataFrame:
    """An ignore list of any length as a table, from its lines: (kind, rule, pattern, length, begins).

    ``pattern`` is a value hash, or the pattern of a glob over sources or values; ``rule`` that of a glob over rules.
    ``begins`` is how what the glob matches must begin, cut to ``length``. Malformed globs match nothing.
    """

    @F.arrow_udf("struct<pattern:string,length:int,begins:string>")
    def compiled(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for globs in batches:
            out = []
            for g in globs.to_pylist():
                literal = re.match(r"[^*?\\[]*", g or "")[0]
                length = next(n for n in _BEGINNINGS if n <= len(literal))
                out.append({"pattern": None if g is None else glob_regex(g), "length": length, "begins": literal[:length]})
            yield pa.array(out, pa.struct([("pattern", pa.string()), ("length", pa.int32()), ("begins", pa.string())]))

    line = F.trim(F.col(column))
    kind, rest = F.substring_index(line, ":", 1), F.substr(line, F.instr(line, F.lit(":")) + 1)
    wrong = F.raise_error(F.concat(F.lit("no ignore entry: "), line)).cast("string")
    good = (kind.isin("hash", "rule", "source") & (rest != "") | ((kind == "rule_value") & rest.contains(":"))) & line.contains(":")
    rows = lines.filter((line != "") & ~line.startswith("#")).select(F.when(good, kind).otherwise(wrong).alias("kind"), rest.alias("rest"))
    both = F.col("kind") == "rule_value"
    rule = F.when(both, F.substring_index("rest", ":", 1)).when(F.col("kind") == "rule", F.col("rest"))
    glob = F.when(both, F.substr("rest", F.instr("rest", F.lit(":")) + 1)).when(F.col("kind") == "source", F.col("rest"))
    told = rows.select("kind", "rest", compiled(rule).alias("r"), compiled(glob).alias("g"))
    pattern = F.when(F.col("kind") == "hash", F.col("rest")).otherwise(F.col("g.pattern"))
    return told.select("kind", F.col("r.pattern").alias("rule"), pattern.alias("pattern"), F.col("g.length").alias("length"), F.col("g.begins").alias("begins"))


def unignored(rows: DataFrame, entries: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """The rows (id, source, value, value_hash) that no entry of an ``ignore_table`` names.

    Hashes are an equi join. Globs over rules are tried on the rules, which are few. Other globs are looked up by their
    literal beginnings, and only what begins like one is held against its pattern.
    """
    ids = rows.sparkSession.createDataFrame([(r.id,) for r in rules], "id string")
    of = lambda kind: entries.filter(F.col("kind") == kind)
    begins = F.explode(F.array(*map(F.lit, _BEGINNINGS))).alias("length")

    def named(kind: str, text: str, *more: str) -> DataFrame:
        """What globs of a kind match among the distinct texts, of the same rule where that is given."""
        known = of(kind).filter("pattern is not null")
        if more:
            matching = known.select("rule").distinct().join(F.broadcast(ids), F.rlike(F.col("id"), F.col("rule")))
            known = known.join(matching, "rule")
        texts = rows.select(text, *more).distinct().select(text, *more, begins).withColumn("begins", F.left(text, F.col("length")))
        texts = texts.filter(F.length(text) >= F.col("length"))
        return texts.join(known, [*more, "length", "begins"]).filter(F.rlike(F.col(text), F.col("pattern"))).select(text, *more).distinct()

    left = rows.join(of("hash").select(F.col("pattern").alias("value_hash")).distinct(), "value_hash", "left_anti")
    ruled = of("rule").select("rule").distinct().join(F.broadcast(ids), F.rlike(F.col("id"), F.col("rule"))).select("id").distinct()
    left = left.join(F.broadcast(ruled), "id", "left_anti")
    left = left.join(named("source", "source"), "source", "left_anti")
    return left.join(named("rule_value", "value", "id"), ["value", "id"], "left_anti").select(*rows.columns)


KEY = ("value_hash", "secret_type")


def partial(kept: DataFrame) -> DataFrame:
    """One row for each (value, secret type) of some matches, from which ``folded`` makes findings together with others.

    The first match, by source, rule and offset, names a finding; the most confident one gives the reasons. Places are only
    counted, so that a value that very many documents hold is merged before the shuffle; ``places`` gives them.
    """
    at = F.struct("source", "n", "start")
    named = F.struct(F.col("id").alias("rule_id"), "name", "provider", "severity", "value", "redacted", "source", "line", "column", "entropy")
    sure = F.struct("confidence", (-F.col("n")).alias("n"), (-F.col("start")).alias("start"), F.col("source"))
    return kept.groupBy(*KEY).agg(
        F.min(at).alias("first_at"), F.min_by(named, at).alias("first"), F.max(sure).alias("best_at"), F.max_by("reasons", sure).alias("reasons"),
        F.lit(False).alias("verified"), F.count("*").alias("places"),
    )


def refolded(partials: DataFrame) -> DataFrame:
    """Partial rows of several sets of matches as those of their union; the order of the sets does not matter."""
    return partials.groupBy(*KEY).agg(
        F.min("first_at").alias("first_at"), F.min_by("first", "first_at").alias("first"), F.max("best_at").alias("best_at"), F.max_by("reasons", "best_at").alias("reasons"),
        F.max("verified").alias("verified"), F.sum("places").alias("places"),
    )


def _finding(partials: DataFrame) -> DataFrame:
    first = [F.col(f"first.{c}").alias(c) for c in ("rule_id", "name", "provider", "severity", "value", "redacted", "source", "line", "column")]
    return partials.select(
        *KEY, F.lit(SCHEMA_VERSION).alias("schema_version"), *first, F.col("best_at.confidence").alias("confidence"), F.col("first.entropy").alias("entropy"), "verified", "reasons", "places",
    )


def merged(kept: DataFrame) -> DataFrame:
    """One finding for each (value, secret type)."""
    return _finding(partial(kept))


def folded(partials: DataFrame) -> DataFrame:
    """The findings of several sets of matches, from their ``partial`` rows."""
    return _finding(refolded(partials))


def places(kept: DataFrame) -> DataFrame:
    """Where each value was found, a row a place."""
    return kept.select(*KEY, "source", "n", "start", "line", "column")


def with_locations(findings: DataFrame, places: DataFrame) -> DataFrame:
    """Findings with an array of their places, in order, for reports that nest them; it grows with a value's matches."""
    at = F.struct("source", "n", "start", "line", "column")
    each = places.groupBy(*KEY).agg(F.transform(F.array_sort(F.collect_list(at)), lambda p: F.struct(p["source"].alias("source"), p["line"].alias("line"), p["column"].alias("column"))).alias("locations"))
    return findings.drop("places").join(each, [*KEY])


def ordered(findings: DataFrame) -> DataFrame:
    return findings.orderBy(severity_rank(F.col("severity")).desc(), F.col("confidence").desc(), "name", "value_hash")


#: Bits of the bitmap for each known value, and bytes up to which it is sent to all tasks.
BITS, BITMAP_BYTES = 16, 64 << 20
_PAGE = 1 << 15


def unknown(rows: DataFrame, known: DataFrame, most: int = BITMAP_BYTES) -> DataFrame:
    """The rows whose ``value_hash`` is not among those of ``known``.

    Known hashes are folded into a bitmap by aggregation and sent out once. Rows whose bit is not set are new for
    certain and never exchanged; only the others go to the exact anti join. Where the bitmap would be larger than
    ``most`` bytes, all rows do.
    """
    mine = known.select("value_hash").filter("value_hash is not null").distinct()
    bits = BITS * max(1, mine.count())
    if bits > 8 * most:
        return rows.join(mine, "value_hash", "left_anti").select(*rows.columns)
    place = lambda: F.pmod(F.xxhash64("value_hash"), F.lit(bits)) + 1
    pages = mine.select(F.bitmap_bucket_number(place()).alias("_page"), F.bitmap_bit_position(place()).alias("_bit"))
    pages = pages.groupBy("_page").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    bit = F.bitmap_bit_position(place())
    byte = F.conv(F.hex(F.substring(F.col("_bits"), (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    told = rows.withColumn("_page", F.bitmap_bucket_number(place())).join(F.broadcast(pages), "_page", "left")
    told = told.withColumn("_maybe", F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).drop("_page", "_bits")
    new = told.filter(~F.col("_maybe")).select(*rows.columns)
    return new.union(told.filter("_maybe").join(mine, "value_hash", "left_anti").select(*rows.columns))


def strict_matches(docs: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] | DataFrame = (), known: DataFrame | None = None, min_confidence: float = MIN_CONFIDENCE, **options: object) -> DataFrame:
    """Kept matches of the non-legacy rules in ``docs`` (source, body); ``known`` has the value_hash of earlier ones.

    ``ignore`` are the lines of a short list, or the ``ignore_table`` of one of any length.
    """
    rules = [r for r in rules if r.kind != "legacy"]
    rows = identified(scored(matches(docs, rules, **options), min_confidence)).filter("drop_reason is null")
    rows = unignored(rows, ignore, rules) if isinstance(ignore, DataFrame) else rows.filter(~ignored(ignore))
    return rows if known is None else unknown(rows, known)


def find(docs: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), known: DataFrame | None = None, **options: object) -> DataFrame:
    """Findings of the non-legacy rules in ``docs``, merged by value."""
    return merged(strict_matches(docs, rules, ignore, known, **options))


def all_matches(docs: DataFrame, rules: Iterable[Rule], ignore: Iterable[str] = (), known: DataFrame | None = None, **options: object) -> DataFrame:
    """Kept matches of all rules, legacy ones after their filters; lists of ignored and of known values hold for both."""
    entries = list(ignore)
    rows = identified(assess(docs, rules, ignore=(lambda get: ignored(entries, get)) if entries else None, **options).filter("drop_reason is null"))
    return rows if known is None else unknown(rows, known)


def statistics(rows: DataFrame) -> DataFrame:
    """Matches by fate: the counters of a run as rows."""
    return rows.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("outcome")).agg(F.count("*").alias("matches"))


def _counted() -> list[Column]:
    """Matches by kind and fate."""
    n = lambda condition, name: F.count_if(condition).alias(name)
    legacy, out = F.col("kind") == "legacy", F.col("drop_reason")
    past = ("scope", "foreign_address", "encoded_media", "link", "unwanted_email", "covered")
    fixture = F.array_contains("reasons", "surrounded by fixture/example wording") | F.array_contains("reasons", "context looks like a fixture/example")
    scored_at_all = out.isNull() | out.isin("low_confidence", "ignored", "cross_domain", "pattern", "not_internal")
    return [
        n(~legacy & out.isNull(), "registry_hits"), n(legacy & F.col("filtered") & (out.isNull() | ~out.isin(*past)), "legacy_raw"), n(out == "vendor_noise", "dropped_vendor_noise"),
        n(fixture & scored_at_all, "fixtures"), n(out == "source_map_line", "dropped_source_map"), n(out.isin("entropy", "classes"), "dropped_entropy"), n(out == "context", "dropped_context"),
        n(out == "low_confidence", "dropped_confidence"), n(out == "covered", "dropped_duplicate"), n(out.isNull(), "findings"),
    ]


def counters(rows: DataFrame) -> DataFrame:
    """The counters of a run, one row: matches by kind and fate (``rows`` are all matches, kept and dropped)."""
    once = F.when(F.col("drop_reason").isNull() & (F.col("kind") != "legacy"), F.struct("value", "secret_type"))
    return rows.agg(*_counted(), F.count_distinct(once).alias("findings_merged"))


def find_counted(rows: DataFrame) -> tuple[DataFrame, Callable[[], dict[str, int]]]:
    """Findings of assessed matches, and the run's counters from the same job: ask for them once the findings have been used."""
    matched, found = Observation(), Observation()
    seen = rows.observe(matched, *_counted())
    merged_ = merged(identified(seen.filter("drop_reason is null and kind <> 'legacy'"))).observe(found, F.count("*").alias("findings_merged"))
    return merged_, lambda: {**matched.get, **found.get}


def fetch_counters(responses: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Counters of responses (url, status, body): fetched, refused by the host, cut at ``max_bytes``, and bytes read."""
    n = F.coalesce(F.octet_length("body"), F.lit(0))
    return responses.agg(F.count("*").alias("fetched"), F.count_if(F.col("status").isin(403, 429)).alias("blocked"), F.count_if(n > max_bytes).alias("truncated"), F.coalesce(F.sum(F.least(n, F.lit(max_bytes)).cast("long")), F.lit(0)).alias("bytes_parsed"))


def verify_counters(results: DataFrame) -> DataFrame:
    """Liveness results: attempts, alive, errors, dead."""
    wrong = F.coalesce("error", F.lit("")) != ""
    return results.filter(F.col("rule_id").isin(*VERIFIABLE)).agg(F.count("*").alias("attempts"), F.count_if("alive").alias("alive"), F.count_if(~F.col("alive") & wrong).alias("errors"), F.count_if(~F.col("alive") & ~wrong).alias("dead"))


def verified(findings: DataFrame, results: DataFrame) -> DataFrame:
    """Folds liveness results (rule_id, value_hash, alive, status, account, note, error) in: what is alive is certain."""
    verify = results.filter(F.col("rule_id").isin(*VERIFIABLE)).select("rule_id", "value_hash", F.struct("alive", "status", "account", "note", "error").alias("verify"))
    alive = F.coalesce("verify.alive", F.lit(False))
    return findings.join(verify, ["rule_id", "value_hash"], "left").withColumn("verified", F.col("verified") | alive).withColumn("confidence", F.when(alive, 1.0).otherwise(F.col("confidence")))


def aws_pairs(findings: DataFrame) -> DataFrame:
    """Access key ids and secrets that are each the only one first seen in a source."""
    of = lambda rule, c: F.max(F.when(F.col("rule_id") == rule, F.col(c)))
    n = lambda rule: F.count_if(F.col("rule_id") == rule)
    key, secret = "aws.access_key_id", "aws.secret_access_key"
    both = findings.filter(F.col("rule_id").isin(key, secret)).groupBy("source").agg(n(key).alias("_k"), n(secret).alias("_s"), of(key, "value").alias("akid"), of(secret, "value").alias("secret"), of(key, "line").alias("line"), of(key, "column").alias("column"))
    return both.filter("_k = 1 and _s = 1").drop("_k", "_s")


def self_test(examples: DataFrame, rules: Iterable[Rule]) -> DataFrame:
    """Per rule, how many true examples are found and false ones rejected; ``examples`` has rule_id, kind (tp, fp), value."""
    rules = list(rules)
    given = examples.withColumn("source", F.concat_ws("#", "rule_id", "kind", F.sha2("value", 256))).withColumn("body", F.concat(F.lit('const apiKey = "'), "value", F.lit('";')))
    hit = scored(matches(given, rules), 0.0).filter("drop_reason is null").select("source", F.col("id").alias("rule_id")).distinct().withColumn("hit", F.lit(True))
    told = given.join(hit, ["source", "rule_id"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    n = lambda c, name: F.count_if(c).cast("int").alias(name)
    tp, fp = F.col("kind") == "tp", F.col("kind") == "fp"
    out = told.groupBy("rule_id").agg(n(tp & F.col("hit"), "tp_passed"), n(tp, "tp_total"), n(fp & ~F.col("hit"), "fp_caught"), n(fp, "fp_total"))
    return out.withColumn("ok", (F.col("tp_passed") == F.col("tp_total")) & (F.col("fp_caught") == F.col("fp_total")))

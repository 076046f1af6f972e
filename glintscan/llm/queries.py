"""The operators applied to the driver's tables: one query for each, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.llm import (
    conversations, decontamination, divergence, licenses, ngram_join, packing, quality_classifier, quality_rules, secrets, substring_dedup, toxicity, warc, word_bpe,
)
from glintscan.sources.readers import spread


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents, dealt over all cores where they come in fewer pieces."""
    return spread(table(spark, sf_dir, "documents"))


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Place of a public tokenizer's vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.assess(documents(spark, sf_dir))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(documents(spark, sf_dir), table(spark, sf_dir, "labels"))


def op4_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(documents(spark, sf_dir))


def op5_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(documents(spark, sf_dir))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.records(warc.archive(table(spark, sf_dir, "pages")))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.assess(documents(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.roundtrip(documents(spark, sf_dir), vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.dedup(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op10_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.link(documents(spark, sf_dir))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(documents(spark, sf_dir))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(documents(spark, sf_dir), vocabulary("byte_bpe_50k.json"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.prepared(table(spark, sf_dir, "conversations"))
    found = conversations.report(conversations.damaged(turns))
    return found.withColumn("conv_id", F.col("conv_id").cast("long"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": op1_quality_rules,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_toxicity": op3_toxicity,
    "op4_secret_scans": op4_secret_scans,
    "op5_license_scans": op5_license_scans,
    "op6_warc": op6_warc,
    "op7_decontamination": op7_decontamination,
    "op8_bpe": op8_bpe,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_ngram_jaccard_join": op10_ngram_jaccard_join,
    "op11_source_divergence": op11_source_divergence,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLE_SQL: dict[str, str] = {
    # forward, with the least (cost, initials) for each state, where the operator goes backward first
    "op13_conversation_repair": r"""
        WITH RECURSIVE k AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c // 2, 3988292384 * (c % 2)) END)) % 20 AS kind
            FROM conversations),
        d AS (SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
                     CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
              FROM (SELECT * FROM k UNION ALL SELECT * FROM k WHERE kind = 3) WHERE kind <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM (
                  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d)),
        r AS (SELECT conv_id, turn, role, text, i, left(role, 1) AS a, left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS before,
                     count(*) OVER (PARTITION BY conv_id) AS n,
                     CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN seen > 1 THEN 'duplicate'
                          WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 'truncated' ELSE '' END AS fault FROM o),
        -- insertions from a state: to which state, their number and turns
        ins(q, z, more, made) AS (VALUES (0, 0, 0, []::VARCHAR[]), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []), (0, 2, 1, ['user:']), (1, 2, 1, ['user:']),
            (3, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
        nxt(q, who, z) AS (VALUES (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
        walk(conv_id, i, n, q, best) AS (
            SELECT conv_id, 0, any_value(n), q.z, {'cost': 5 * q.more, 'audit': repeat('I', q.more), 'made': q.made}
            FROM r, ins q WHERE q.q = 0 GROUP BY conv_id, q.z, q.more, q.made
            UNION ALL
            SELECT conv_id, i, any_value(n), z, min({'cost': cost, 'audit': audit, 'made': made}) FROM (
                SELECT e.conv_id, e.i, e.n, s.z, e.cost + 5 * s.more AS cost, e.audit || repeat('I', s.more) AS audit, list_concat(e.made, s.made) AS made FROM (
                    SELECT w.conv_id, r.i, w.n, w.q AS z, w.best.cost + 2 AS cost, w.best.audit || 'D' AS audit, w.best.made AS made
                    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1
                    UNION ALL
                    SELECT w.conv_id, r.i, w.n, t.z, w.best.cost + (a <> left(who, 1))::INTEGER + 5 * (fault = 'truncated')::INTEGER,
                           w.best.audit || CASE WHEN a = left(who, 1) THEN 'K' ELSE 'R' END,
                           list_append(w.best.made, CASE WHEN a = left(who, 1) THEN r.role ELSE who END || ':' || r.text)
                    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1 JOIN nxt t ON t.q = w.q WHERE fault NOT IN ('blank', 'duplicate')
                    UNION ALL
                    SELECT w.conv_id, r.i, w.n, 1, w.best.cost + 5 * (fault = 'truncated')::INTEGER, w.best.audit || 'K', list_append(w.best.made, r.role || ':' || r.text)
                    FROM walk w JOIN r ON r.conv_id = w.conv_id AND r.i = w.i + 1 WHERE w.q = 0 AND a = 's' AND fault NOT IN ('blank', 'duplicate')
                ) e JOIN ins s ON s.q = e.z)
            GROUP BY conv_id, i, z),
        best AS (SELECT conv_id, min(best) AS b FROM walk WHERE i = n AND q IN (0, 3) GROUP BY conv_id),
        c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                     count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                     count(*) FILTER (i > 1 AND before || a NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id)
        SELECT x.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(b.cost, 0)::BIGINT AS cost,
               coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.made, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c USING (conv_id) LEFT JOIN best USING (conv_id)
    """,
    "op11_source_divergence": r"""
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        x AS (SELECT lang, source, k, term FROM (SELECT k, lang, source, unnest(w) AS term FROM (SELECT *, row_number() OVER () AS k FROM d))),
        kept AS (SELECT lang, term, count(*)::HUGEINT AS n FROM x GROUP BY ALL HAVING count(DISTINCT k) >= 10),
        v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM kept GROUP BY lang),
        own AS (SELECT x.lang, source, term, count(*)::HUGEINT AS n FROM x JOIN kept USING (lang, term) GROUP BY ALL),
        total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM own GROUP BY ALL),
        g AS (SELECT DISTINCT lang, source FROM d),
        p AS (SELECT g.lang, g.source, kept.term, coalesce(own.n, 0) AS n,
                     1 + (1000000000::HUGEINT * (coalesce(own.n, 0) + 2)) // (coalesce(total.n, 0) + 2 * v.v) AS p,
                     1 + (1000000000::HUGEINT * (kept.n + 2)) // (v.n + 2 * v.v) AS q
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN own ON own.lang = g.lang AND own.source = g.source AND own.term = kept.term
              LEFT JOIN total ON total.lang = g.lang AND total.source = g.source),
        f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
              FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
                 FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
                 LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        over_ AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // (p + q) AS value FROM p WHERE n > 0 AND p > q),
        r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
              FROM (SELECT * FROM pair UNION ALL SELECT * FROM over_))
        SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 10
    """,
    "op9_substring_dedup": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM d),
        k AS (SELECT doc_id, i, word, n, CASE WHEN i + 49 <= n THEN md5(array_to_string(list(word) OVER (
                  PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING), ' ')) END AS h FROM p),
        f AS (SELECT h, min(doc_id) AS least FROM k WHERE h IS NOT NULL GROUP BY h),
        g AS (SELECT doc_id, i, word, max(CASE WHEN least < doc_id THEN 1 ELSE 0 END) OVER (
                  PARTITION BY doc_id ORDER BY i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM k LEFT JOIN f USING (h)),
        r AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (gone = 0) AS kept FROM g GROUP BY doc_id)
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM d LEFT JOIN r USING (doc_id)
    """,
    "op10_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        p AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS word, len(w) AS n FROM d),
        s AS (SELECT DISTINCT doc_id, md5(gram) AS gram FROM (
                  SELECT doc_id, i, n, array_to_string(list(word) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING), ' ') AS gram FROM p)
              WHERE i + 4 <= n OR n < 5 AND i = 1),
        c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        m AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS same FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id GROUP BY ALL),
        e AS (SELECT x, y FROM m JOIN c cx ON cx.doc_id = x JOIN c cy ON cy.doc_id = y WHERE 100 * same >= 75 * (cx.n + cy.n - same)),
        r(doc_id, root) AS (
            SELECT doc_id, doc_id FROM d
            UNION SELECT v.y, r.root FROM r JOIN (SELECT x, y FROM e UNION ALL SELECT y, x FROM e) v ON r.doc_id = v.x)
        SELECT d.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, min(r.root) AS component_id
        FROM d JOIN r USING (doc_id) LEFT JOIN c USING (doc_id) GROUP BY d.doc_id, c.n
    """,
    "op6_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY t) AS first FROM p)
        SELECT page_id, n AS payload_bytes, sha256(t) AS payload_digest,
               CASE WHEN n >= 100 AND page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 100 AND page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op1_quality_rules": r"""
        WITH d AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
            FROM documents),
        windows AS (
            SELECT doc_id, i, w[i] || chr(10) || w[i + 1] || chr(10) || w[i + 2] AS gram
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
        twice AS (
            SELECT doc_id, i FROM windows
            QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1),
        repeats AS (
            SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
        lines AS (
            SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dup
            FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)
            WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
        m AS (
            SELECT d.doc_id, len(w) AS n_words,
                   length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
                   length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   coalesce(lines.dup, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words,
                   coalesce(lines.n, 0) AS n_lines,
                   length(regexp_replace(text, '[^A-Z]+', '', 'g')) AS n_upper,
                   length(regexp_replace(text, '[^0-9]+', '', 'g')) AS n_digits
            FROM d LEFT JOIN lines USING (doc_id) LEFT JOIN repeats USING (doc_id)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 10 * n_symbols > n_words OR (n_dup_lines >= 3 AND 10 * n_dup_lines > 3 * n_lines)
                    OR 2 * n_upper > word_chars OR 10 * n_digits > 3 * word_chars
                    OR word_chars < 2 * n_words OR word_chars > 20 * n_words) AS kept
        FROM b
    """,
}

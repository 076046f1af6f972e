"""A cache of responses as a table: one row for each key, refreshed by rounds of responses into new snapshots.

The key is that of the address, unless the responses have a column ``key``, as where one address stands for several pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glintscan.sources.readers import header

SCHEMA = "key string, url string, status int, content_type string, etag string, last_modified string, fetched_at timestamp, size long, body string"


def key(url: Column) -> Column:
    return F.sha2(url, 256)


def keyed(rows: DataFrame) -> DataFrame:
    """The rows with their own key if they have one, else with that of their address."""
    return rows if "key" in rows.columns else rows.withColumn("key", key(F.col("url")))


def conditions(urls: DataFrame, cache: DataFrame) -> DataFrame:
    """Addresses with the headers of a request that asks only for what has changed: (url, if_none_match, if_modified_since)."""
    tag = lambda c: F.nullif(F.col(c), F.lit(""))
    known = cache.select("key", tag("etag").alias("if_none_match"), tag("last_modified").alias("if_modified_since"))
    return keyed(urls).join(known, "key", "left").select("url", "if_none_match", "if_modified_since")


def storable(responses: DataFrame) -> DataFrame:
    """Rows for the cache from responses (url, status, headers, body, fetched_at): successful, not empty, without cookies."""
    of = lambda name: F.coalesce(header(F.col("headers"), name), F.lit(""))
    body = F.col("body").cast("string")
    kept = keyed(responses).filter(F.col("status").between(200, 299) & (of("set-cookie") == "") & (body != ""))
    return kept.select(
        "key", "url", F.col("status").cast("int").alias("status"), of("content-type").alias("content_type"), of("etag").alias("etag"),
        of("last-modified").alias("last_modified"), "fetched_at", F.octet_length(body).cast("long").alias("size"), body.alias("body"),
    )


def served(responses: DataFrame, cache: DataFrame) -> DataFrame:
    """(url, body, from_cache) of a round: bodies of successful responses, and of unchanged ones what the cache holds."""
    own = responses.filter(F.col("status").between(200, 299)).select("url", F.col("body").cast("string").alias("body"), F.lit(False).alias("from_cache"))
    unchanged = keyed(responses).filter("status = 304").select("url", "key")
    return own.union(unchanged.join(cache.select("key", "body"), "key").select("url", "body", F.lit(True)))


def refreshed(cache: DataFrame, responses: DataFrame, now: Column | None = None, max_age: str | None = None) -> DataFrame:
    """The next snapshot: of each key the row fetched last; with ``max_age`` older rows than that at ``now`` fall out.

    A response that says unchanged leaves the row as it is, but counts as fetched now, for its age.
    """
    unchanged = keyed(responses).filter("status = 304").groupBy("key").agg(F.max("fetched_at").alias("_again"))
    touched = cache.join(unchanged, "key", "left").withColumn("_seen", F.greatest("fetched_at", "_again")).drop("_again")
    new = storable(responses).withColumn("_seen", F.col("fetched_at"))
    names = [f.split()[0] for f in SCHEMA.split(", ")]
    # of several at one time the greater body, so that the result does not depend on the order of rows
    latest = F.max_by(F.struct(*names, "_seen"), F.struct("fetched_at", "body")).alias("r")
    rows = touched.select(*names, "_seen").union(new.select(*names, "_seen")).groupBy("key").agg(latest, F.max("_seen").alias("_seen")).select("r.*", F.col("_seen").alias("_last"))
    if max_age is not None:
        rows = rows.filter(F.col("_last") >= (now if now is not None else F.current_timestamp()) - F.expr(f"interval {max_age}"))
    return rows.select(*names)

"""Scans and host health over streams."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from glintscan.operators.scan import identified, matches, scored
from glintscan.rules.model import Rule
from glintscan.sources.shared import folder

#: Failures in a row that bench a host, and for how many seconds. Fixed values.
FAILURES, BENCHED = 5, 30
#: Milliseconds without outcomes after which a host is forgotten.
IDLE = 24 * 3_600_000


def scan(docs: DataFrame, rules: Iterable[Rule], event_time: str | None = None, delay: str = "1 hour", **options: object) -> DataFrame:
    """Kept matches of a stream of documents, each (value, secret type) once.

    With an event time, a column of ``docs`` that comes out too, what is remembered of earlier matches is bounded
    by the watermark on it, and documents later than that are passed over.
    """
    more = () if event_time is None else (event_time,)
    given = docs if event_time is None else docs.withWatermark(event_time, delay)
    rows = identified(scored(matches(given, rules, carry=more, **options))).filter("drop_reason is null")
    if event_time is None:
        return rows.dropDuplicates(["value_hash", "secret_type"])
    return rows.dropDuplicatesWithinWatermark(["value_hash", "secret_type"])


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives of all that is there now, written to the cluster's shared folder and read back."""
    spark = stream.sparkSession
    at = folder(spark, name)
    query = stream.writeStream.format("parquet").outputMode("append").option("path", f"{at}/rows").option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{at}/rows")


BREAKER = "host string, ts timestamp, failures int, benched_until timestamp, benched boolean"


def _breaker(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    failures, until = state.get if state.exists else (0, None)
    until = pd.Timestamp(until) if until else None
    out = []
    rows = pd.concat(batches).sort_values("ts", kind="stable")
    for r in rows.itertuples():
        if r.status == 429 or r.status >= 500:
            failures += 1
            if failures >= FAILURES:
                wait = max(BENCHED, 0 if pd.isna(r.retry_after_s) else int(r.retry_after_s))
                until, failures = r.ts + pd.Timedelta(seconds=wait), 0
        elif 200 <= r.status < 400:
            failures = 0
        out.append((key[0], r.ts, failures, until, until is not None and r.ts < until))
    state.update((failures, str(until) if until is not None else None))
    seen = max(int(r.ts.timestamp() * 1000) for r in rows.itertuples())
    state.setTimeoutTimestamp(max(seen, state.getCurrentWatermarkMs()) + IDLE)
    yield pd.DataFrame(out, columns=["host", "ts", "failures", "benched_until", "benched"]).astype({"benched_until": "datetime64[ns]"})


def breaker(outcomes: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Circuit breaker of each host over (host, ts, status, retry_after_s): state after every outcome.

    A host without outcomes for a day of event time is forgotten; outcomes later than ``delay`` are passed over.
    """
    return outcomes.withWatermark("ts", delay).groupBy("host").applyInPandasWithState(_breaker, BREAKER, "failures int, benched_until string", "append", GroupStateTimeout.EventTimeTimeout)


def sessions(outcomes: DataFrame, gap: str = "5 minutes", delay: str = "1 hour") -> DataFrame:
    """Requests of each host in sessions that ``gap`` without a request ends: start, end, requests and failures."""
    return outcomes.withWatermark("ts", delay).groupBy("host", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("requests"), F.count_if((F.col("status") == 429) | (F.col("status") >= 500)).alias("failures")).select("host", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "requests", "failures")

"""A findings table that grows batch by batch and is merged by (value, secret type).

Each batch writes what it found as a part of its own, merged within the batch: partial findings, and the places. A batch that
is written again replaces its part, so a replay changes nothing, and neither does the order of the batches. Reading folds
the parts: the first match names a finding, the most confident one gives the reasons, places add up. ``compact`` folds the
parts that are there into one base, which remembers the batches that it holds; their parts are passed over from then on.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glintscan.operators import findings
from glintscan.rules.model import Rule

class Ledger:
    """The table below ``path``, which all executors must reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def write(self, kept: DataFrame, batch: int) -> None:
        """Writes the kept matches of a batch, once however often it is given."""
        kept = kept.persist(StorageLevel.DISK_ONLY)  # both are made from one scan
        findings.partial(kept).write.mode("overwrite").parquet(f"{self.path}/parts/batch={batch}")
        findings.places(kept).write.mode("overwrite").parquet(f"{self.path}/places/batch={batch}")
        kept.unpersist()

    def sink(self, rules: Iterable[Rule], **options: object) -> Callable[[DataFrame, int], None]:
        """What a stream of documents (source, body) hands its batches to, by ``foreachBatch``."""
        rules = list(rules)
        return lambda docs, batch: self.write(findings.strict_matches(docs, rules, **options), batch)

    def _read(self, at: str, schema: str | None = None) -> DataFrame | None:
        reader = self.spark.read if schema is None else self.spark.read.schema(schema)
        try:
            return reader.parquet(f"{self.path}/{at}")
        except AnalysisException as e:
            if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                return None
            raise

    def _base(self) -> str | None:
        """The newest complete base. Only complete ones are listed."""
        bases = self._read("bases", "base string, made timestamp")
        last = None if bases is None else bases.agg(F.max_by("base", "made")).first()
        return None if last is None else last[0]

    def _parts(self) -> tuple[DataFrame | None, DataFrame | None, str | None]:
        """Partial findings that are not in a base, the base, and its name."""
        base, parts = self._base(), self._read("parts")
        if base is None:
            return parts, None, None
        if parts is not None:
            parts = parts.join(self._read(f"base/{base}/batches"), "batch", "left_anti")
        return parts, self._read(f"base/{base}/findings"), base

    def findings(self) -> DataFrame:
        """All findings so far, merged."""
        found = [x.drop("batch") for x in self._parts()[:2] if x is not None]
        if not found:
            raise ValueError(f"no batch has been written to {self.path}")
        return findings.folded(found[0] if len(found) == 1 else found[0].unionByName(found[1]))

    def places(self) -> DataFrame:
        """All places so far, a row each, with their batch."""
        return self._read("places")

    def compact(self) -> None:
        """Folds all parts that are there now into a new base."""
        parts, base, name = self._parts()
        if parts is None:
            return
        new = uuid.uuid4().hex
        # the batches are written first and then read, so that a batch that comes meanwhile is not half in
        held = parts.select("batch").distinct()
        if name is not None:
            held = held.union(self._read(f"base/{name}/batches"))
        held.write.parquet(f"{self.path}/base/{new}/batches")
        mine = parts.join(self._read(f"base/{new}/batches"), "batch").drop("batch")
        every = mine if base is None else mine.unionByName(base)
        findings.refolded(every).write.parquet(f"{self.path}/base/{new}/findings")
        self.spark.range(1).select(F.lit(new).alias("base"), F.current_timestamp().alias("made")).write.mode("append").parquet(f"{self.path}/bases")

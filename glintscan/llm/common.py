"""What the operators share: the shared scratch folder, cut points, and text access inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from weakref import WeakKeyDictionary

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one partition of a hash-bucketed exchange should stand for.
BUCKET_BYTES = 8 << 20
#: Folders of the tables that ``cut`` has given back.
_WRITTEN: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's ``spark.checkpoint.dir``.

    Driver and executors may share no other folder, so everything that is written and read again goes
    there. Only where the setting is missing (local tests) a temporary folder is chosen and remembered.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later jobs do not repeat its lineage."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[out] = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes what ``cut`` has written of tables that nothing will read again."""
    for df in tables:
        if path := _WRITTEN.pop(df, None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while (name := "_" + name) in taken:
        pass
    return name


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of the size of what ``df`` reads; sizes hash buckets, never results."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def bucket_count(df: DataFrame, least: int = 16, each: int = BUCKET_BYTES) -> int:
    """Hash buckets in proportion to the input, so that a bucket's memory stays the same at any size."""
    return max(least, min(1 << 26, -(-input_bytes(df) // each)))


def small_batches(spark: SparkSession) -> None:
    """Keeps Arrow batches of texts to a few MB, on both sides of the pipe to the Python workers.

    The default of 10,000 rows is hundreds of MB for long texts. A setting of the session's own stays. Queries are
    lazy, so the settings stay with the session; they change batches, never results.
    """
    for key, default, small in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1000"), ("spark.sql.execution.arrow.maxBytesPerBatch", None, str(8 << 20))):
        if spark.conf.get(key, default) == default or (default is None and int(spark.conf.get(key)) > 8 << 20):
            spark.conf.set(key, small)


def raw(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def every_salt(salts: int) -> Column:
    """Makes a row for each salt, for the side of a salted join that is repeated."""
    return F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))


def salt(key: Column, salts: int) -> Column:
    """The one salt of a row of the other side."""
    return F.pmod(F.xxhash64(key), F.lit(salts)).cast("long")

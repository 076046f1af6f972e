"""WARC archives of pages, and a chunked record table read from them.

Payloads of equal bytes are stored once: the record with the least id is the response, the others are revisit
records that refer to it. Each record is its own gzip member. Reading gives one row per chunk of a payload,
(record, chunk number), with the SHA-256 and the length of all bytes so far: no payload is ever held whole, and
the last chunk carries the digest of the whole. Files are streamed through the file system that the folder's
URI names, and each attempt of a task writes files of its own; only those of finished tasks are listed.

A null payload counts as empty. Payloads under ``LEAST`` bytes are always stored. Rows that share an id and a
payload are all responses; a row without an id is a response that nothing refers to. The first record of an id and
a payload in a task is named after both, so that others can refer to it; the rest get names of their own. Empty
tables give no files.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintscan.llm.common import cut, every_salt, salt, scratch, small_batches

#: Payload bytes from which equal payloads are stored once; bytes of a chunk; payload bytes of a file.
LEAST, CHUNK, FILE_BYTES = 100, 1 << 18, 1 << 28
SALTS = 32
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def decided(pages: DataFrame) -> DataFrame:
    """``pages`` (_id, _t, _url) with digest, bytes and, for revisits, the id of the response."""
    told = pages.withColumn("digest", F.sha2("_t", 256)).withColumn("bytes", F.octet_length("_t").cast("long"))
    large = told.filter((F.col("bytes") >= LEAST) & F.col("_id").isNotNull()).select("_id", "digest")
    first = large.groupBy("digest").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).filter("first < last").select("digest", "first", every_salt(SALTS).alias("s"))
    again = large.withColumn("s", salt(F.col("_id"), SALTS)).join(first, ["digest", "s"]).filter("_id > first").select("_id", "digest", "first").distinct()
    return told.join(again, ["_id", "digest"], "left")


def _open(path: str, mode: str) -> pa.NativeFile:
    fs, at = pyarrow.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    if mode == "r":
        return fs.open_input_stream(at, buffer_size=1 << 20, compression=None)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(at, buffer_size=1 << 20, compression=None)


def urn(page: object, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page}:{digest}')}>"


def write(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the records of ``decided`` pages below ``folder``; gives (path, records), written down once."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, held = None, "", 0, 0
        done: list[tuple[str, int]] = []
        named: set[str] = set()  # of this task's records: some hundred bytes each, against their payloads
        for b in batches:
            for page, digest, size, first, url, i in zip(*(b[c].to_pylist() for c in ("_id", "digest", "bytes", "first", "_url")), range(len(b)), strict=True):
                if out is None:
                    path, n, held = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(path, "w")
                own = urn(page, digest)
                if page is None or own in named:  # nothing refers to this record
                    own = f"<urn:uuid:{uuid.uuid4()}>"
                else:
                    named.add(own)
                fields = [("WARC-Type", "response" if first is None else "revisit"), ("WARC-Record-ID", own), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha256:{digest}")]
                if url:
                    fields.append(("WARC-Target-URI", "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in url)))
                if first is not None:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(first, digest)), ("Page-Refers-To", str(first))]
                if page is not None:
                    fields.append(("Page-ID", str(page)))
                fields += [("Page-Payload-Length", str(size)), ("Content-Type", "text/html"), ("Content-Length", str(size if first is None else 0))]
                gz = zlib.compressobj(3, zlib.DEFLATED, 31)
                out.write(gz.compress(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode("utf-8", "surrogatepass")))
                if first is None and size:
                    payload = memoryview(b["_t"][i].as_buffer())
                    for at in range(0, len(payload), CHUNK):
                        out.write(gz.compress(payload[at : at + CHUNK]))
                    held += size
                out.write(gz.compress(b"\r\n\r\n") + gz.flush())
                n += 1
                if held >= FILE_BYTES:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        yield pa.RecordBatch.from_pydict({"path": pa.array([p for p, _ in done], pa.string()), "records": pa.array([k for _, k in done], pa.int64())})

    return cut(pages.select("_id", "digest", "bytes", "first", "_url", "_t").mapInArrow(of, "path string, records long"), "warc-files")


class Members:
    """Bytes of the gzip members of a stream, a bounded piece at a time."""

    def __init__(self, stream: pa.NativeFile):
        self.stream, self.rest, self.ready, self.gz = stream, b"", b"", zlib.decompressobj(31)

    def _more(self) -> bool:
        while not self.ready:
            if self.gz.eof:
                self.rest, self.gz = self.gz.unused_data, zlib.decompressobj(31)
            data = self.gz.unconsumed_tail or self.rest or self.stream.read(1 << 16)
            self.rest = b""
            if not data:
                return False
            self.ready = self.gz.decompress(data, CHUNK)
            if self.gz.eof and not self.gz.unused_data:
                self.rest, self.gz = b"", zlib.decompressobj(31)
        return True

    def read(self, n: int) -> bytes:
        """Up to ``n`` bytes; fewer only at the end."""
        parts = []
        while n and self._more():
            part, self.ready = self.ready[:n], self.ready[n:]
            parts.append(part)
            n -= len(part)
        return b"".join(parts)

    def line(self) -> bytes:
        """A line without its end, or nothing at the end of the stream."""
        found = b""
        while not found.endswith(b"\n"):
            if not self._more():
                return found
            i = self.ready.find(b"\n") + 1 or len(self.ready)
            found, self.ready = found + self.ready[:i], self.ready[i:]
        return found


CHUNKS = "record_id string, chunk long, page_id long, record_type string, refers_to long, declared_bytes long, declared_digest string, data binary, bytes_so_far long, digest_so_far string, last boolean"


def chunks(files: DataFrame) -> DataFrame:
    """The chunked record table of the archives listed in ``files``: at least one row for each record."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in CHUNKS.split(", ")]
        kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
        schema = pa.schema([(n, kinds[f.split()[1]]) for n, f in zip(names, CHUNKS.split(", "), strict=True)])
        rows: list[tuple] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for path in (p for b in batches for p in b["path"].to_pylist()):
            with _open(path, "r") as stream:
                source = Members(stream)
                while line := source.line():
                    if not line.strip():
                        continue
                    if not line.startswith(b"WARC/"):
                        raise ValueError(f"{path}: not a WARC record")
                    head = {}
                    while (line := source.line().rstrip(b"\r\n")):
                        key, _, value = line.decode("utf-8", "surrogatepass").partition(": ")
                        head[key] = value
                    left, so_far, digest, chunk = int(head["Content-Length"]), 0, hashlib.sha256(), 0
                    number = lambda key: int(head[key]) if key in head else None  # noqa: E731, B023
                    while True:
                        data = source.read(min(CHUNK, left))
                        if left and not data:
                            raise ValueError(f"{path}: a record breaks off")
                        left, so_far = left - len(data), so_far + len(data)
                        digest.update(data)
                        rows.append((head["WARC-Record-ID"], chunk, number("Page-ID"), head["WARC-Type"], number("Page-Refers-To"), number("Page-Payload-Length"), head["WARC-Payload-Digest"].partition(":")[2], data, so_far, digest.hexdigest(), not left))
                        held, chunk = held + len(data) + 400, chunk + 1
                        if held >= 1 << 23:
                            yield batch()
                            rows, held = [], 0
                        if not left:
                            break
        if rows:
            yield batch()

    return files.select("path").mapInArrow(of, CHUNKS)


def archive(pages: DataFrame, page_id: str = "page_id", payload: str = "html", url: str | None = "url", folder: str | None = None) -> DataFrame:
    """Writes all pages and gives the chunk table read back from the archives."""
    spark = pages.sparkSession
    small_batches(spark)
    given = pages.select(F.col(page_id).cast("long").alias("_id"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("_t"), (F.col(url).cast("string") if url else F.lit(None).cast("string")).alias("_url"))
    files = write(decided(given), folder or scratch(spark, "warc"))
    # a file is a task's work; there are as many as tasks that wrote
    return chunks(files.repartition(max(1, min(10_000, files.count())), F.xxhash64("path")))


def records(chunk_table: DataFrame) -> DataFrame:
    """One row for each record, from its last chunk; fails where a stored payload is not what its header declares."""
    last = chunk_table.filter("last")
    stored = F.col("record_type") == "response"
    good = ~stored | ((F.col("bytes_so_far") == F.col("declared_bytes")) & (F.col("digest_so_far") == F.col("declared_digest")))
    checked = F.when(good, F.col("declared_digest")).otherwise(F.raise_error(F.concat(F.lit("payload differs from its header: "), "record_id")).cast("string"))
    return last.select("page_id", F.when(stored, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")

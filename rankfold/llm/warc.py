"""WARC archives with a two-level capture index (operator 6).

Writing. Each page is one WARC/1.1 record (HTTP header block and payload, the html
in UTF-8). Records with equal payloads of at least ``MIN_REVISIT`` bytes keep the
payload once, in the record of the smallest page id; the others are ``revisit``
records that refer to it. Digests are computed natively; only digests that occur
more than once are joined back, so pages are shuffled only when that table is too
large for Spark's own broadcast limit. Archives are written by Spark's text writer
(one value a record, ``\\r\\n\\r\\n`` after each), which commits tasks atomically on
any store; an archive holds at most ``ARCHIVE_RECORDS`` records.

Index. The archives are read back and parsed by Content-Length (payload digests are
computed from what was read). Captures are sorted by reversed-host URL key; runs of
``BLOCK_LINES`` lines become compressed blocks, and a sparse directory keeps each
block's first key. A lookup finds the block by binary search in the directory,
decompresses it, binary-searches the line, and reads the record's byte range.

Null html is an empty payload; a null or odd URL is written percent-encoded or as
``urn:page:<id>``. Rows that share the smallest id of a payload are all responses;
pages with a null id refer to the smallest id but are never referred to. Repeated
rows give repeated records; an empty table gives empty archives.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankfold.llm.common import materialise
from rankfold.session import scratch_path

MIN_REVISIT = 100
ARCHIVE_RECORDS = 2000
BLOCK_LINES = 1000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CAPTURE = "key string, page_id long, file string, offset long, length long, record_type string, " \
          "payload_bytes long, payload_digest string, refers_to long"
_PORT = {"http": ":80", "https": ":443"}


def url_key(url: str | None) -> str:
    """Sort key with the host reversed: ``com,example,www)/path?query``, lower-cased
    host, no default port, no fragment. A string that is no URL is its own key."""
    u = (url or "").strip()
    try:
        p = urlsplit(u)
        host = p.hostname
    except ValueError:
        host = None
    if not host:
        return u
    port = p.netloc.rpartition("@")[2].rpartition(":")[2] if ":" in p.netloc.rpartition("]")[2] else ""
    port = f":{port}" if port and f":{port}" != _PORT.get(p.scheme) else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (p.path or "/") + (f"?{p.query}" if p.query else "")


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Write one record per row of ``pages`` below ``path``."""
    p = pages.select(F.col(key).cast("long").alias("id"), F.col(url).alias("url"),
                     F.coalesce(F.col(html), F.lit("")).alias("body"))
    digest = F.sha2(F.col("body").cast("binary"), 256)
    keyed = p.withColumn("digest", digest).withColumn("bytes", F.octet_length("body"))
    first = materialise(keyed.where(f"bytes >= {MIN_REVISIT}").groupBy("digest").agg(
        F.min("id").alias("first"), F.count(F.lit(1)).alias("c")).where("c > 1").select("digest", "first"), "warc-first")
    r = keyed.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    name = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.lit(">"))
    uri = F.regexp_replace(F.coalesce("url", F.concat(F.lit("urn:page:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))),
                           r"[\x00-\x20\x7F]+", "%20")
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name),
        F.concat(F.lit("WARC-Target-URI: "), uri),
        F.lit(f"WARC-Date: {DATE}"),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: <urn:page:"), F.col("first").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.when(revisit, F.concat(F.lit("X-Payload-Length: "), F.col("bytes").cast("string"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), (F.when(revisit, 0).otherwise(F.col("bytes")) + len(HTTP)).cast("string")),
    ]
    record = F.concat(F.concat_ws("\r\n", *lines), F.lit(END), F.lit(HTTP), F.when(revisit, "").otherwise(F.col("body")))
    r.select(record.alias("value")).write.option("lineSep", END) \
        .option("maxRecordsPerFile", ARCHIVE_RECORDS).text(path)


_HEAD = re.compile(rb"([A-Za-z-]+): (.*)")
_ID = re.compile(r"<urn:page:(.*)>")


def records(data: bytes) -> Iterator[tuple[int, int, dict, bytes]]:
    """(offset, length, headers, payload) of every record of an archive."""
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = dict(m.groups() for m in map(_HEAD.fullmatch, data[at:cut].split(b"\r\n")) if m)
        head = {k.decode(): v.decode() for k, v in head.items()}
        end = cut + 4 + int(head["Content-Length"])
        block = data[cut + 4:end]
        yield at, end - at, head, block[block.index(b"\r\n\r\n") + 4:]
        at = end + 4


def _page(name: str) -> int | None:
    got = _ID.fullmatch(name)[1]
    return None if got == "null" else int(got)


def _captures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            rows = []
            for offset, length, head, payload in records(data.as_py()):
                kind = head["WARC-Type"]
                revisit = kind == "revisit"
                rows.append((url_key(head["WARC-Target-URI"]), _page(head["WARC-Record-ID"]), file, offset, length, kind,
                             int(head["X-Payload-Length"]) if revisit else len(payload),
                             head["WARC-Payload-Digest"].removeprefix("sha256:") if revisit
                             else hashlib.sha256(payload).hexdigest(),
                             _page(head["WARC-Refers-To"]) if revisit else None))
            if rows:
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(),
                         pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=[x.split()[0] for x in CAPTURE.split(", ")])


def captures(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.read.format("binaryFile").schema(schema).option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(_captures, CAPTURE)


def _blocks(batches: Iterator[pa.RecordBatch], block_lines: int) -> Iterator[pa.RecordBatch]:
    """Captures sorted by key -> (first_key, last_key, n, data): compressed runs
    of lines ``key <tab> JSON``."""
    held: list[tuple[str, str]] = []

    def block(lines: list) -> pa.RecordBatch:
        data = zlib.compress("\n".join(f"{k}\t{v}" for k, v in lines).encode())
        return pa.RecordBatch.from_arrays(
            [pa.array([lines[0][0]]), pa.array([lines[-1][0]]), pa.array([len(lines)], pa.int32()),
             pa.array([data], pa.binary())], names=["first_key", "last_key", "n", "data"])

    for b in batches:
        for row in b.to_pylist():
            key = row.pop("key").replace("\t", "%09").replace("\n", "%0A")
            held.append((key, json.dumps(row, ensure_ascii=False)))
            if len(held) == block_lines:
                yield block(held)
                held = []
    if held:
        yield block(held)


def _lines(data: bytes) -> list[tuple[str, dict]]:
    got = [x.split("\t", 1) for x in zlib.decompress(data).decode().split("\n")]
    return [(k, json.loads(v)) for k, v in got]


class CaptureIndex:
    """blocks: (block, first_key, last_key, n, data); directory: the same without data."""

    def __init__(self, blocks: DataFrame):
        self.blocks = blocks
        self.directory = blocks.select("first_key", "last_key", "block")

    @classmethod
    def build(cls, found: DataFrame, block_lines: int = BLOCK_LINES) -> CaptureIndex:
        cut = found.repartitionByRange("key", "page_id", "file", "offset") \
            .sortWithinPartitions("key", "page_id", "file", "offset")
        blocks = cut.mapInArrow(lambda b: _blocks(b, block_lines), "first_key string, last_key string, n int, data binary") \
            .withColumn("block", F.monotonically_increasing_id())
        return cls(materialise(blocks, "warc-index"))

    def scan(self) -> DataFrame:
        """All captures, from the compressed blocks."""
        names = [x.split()[0] for x in CAPTURE.split(", ")]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data in b.column(0):
                    rows = [{"key": k, **v} for k, v in _lines(data.as_py())]
                    yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([
                        (n, pa.string() if n in ("key", "file", "record_type", "payload_digest") else pa.int64())
                        for n in names]))

        return self.blocks.select("data").mapInArrow(run, CAPTURE)

    def sparse(self) -> list[tuple[str, str, int]]:
        """The directory, one entry per block (1 / BLOCK_LINES of the captures),
        sorted; kept by a reader that serves lookups."""
        return sorted((r["first_key"], r["last_key"], r["block"]) for r in self.directory.collect())

    def lookup(self, url: str, directory: list | None = None) -> list[dict]:
        """Captures of a URL: binary search in the directory, then in its blocks."""
        key = url_key(url).replace("\t", "%09").replace("\n", "%0A")
        directory = self.sparse() if directory is None else directory
        hi = bisect.bisect_right(directory, key, key=lambda e: e[0])
        lo = bisect.bisect_left(directory, key, hi=hi, key=lambda e: e[1])
        wanted = [e[2] for e in directory[lo:hi]]
        out = []
        for r in self.blocks.where(F.col("block").isin(wanted)).orderBy("block").select("data").collect():
            lines = _lines(r["data"])
            at = bisect.bisect_left(lines, key, key=lambda e: e[0])
            while at < len(lines) and lines[at][0] == key:
                out.append(lines[at][1])
                at += 1
        return out


def read_range(spark: SparkSession, file: str, offset: int, length: int) -> tuple[dict, bytes]:
    """(headers, payload) of the record at a byte range, from any store Spark reads."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(file)
    stream = path.getFileSystem(spark._jsc.hadoopConfiguration()).open(path)
    try:
        stream.seek(offset)
        data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()
    _, _, head, payload = next(records(data))
    return head, payload


def archive(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
            path: str | None = None, block_lines: int = BLOCK_LINES) -> CaptureIndex:
    """Write the archives of ``pages`` (below spark.checkpoint.dir unless a path is
    given), read them back, and index what was read."""
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write(pages, path, key, url, html)
    return CaptureIndex.build(captures(spark, path), block_lines)

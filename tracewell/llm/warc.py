"""WARC records in ZIP archives: written by Spark's own sink, read back by ranges without extraction.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (each record a gzip member of its own),
``indexes/index.cdxj`` (a line of JSON with offset and length for each record) and ``datapackage.json``. The reader
parses the end record, the ZIP64 directory where there is one, the central directory and a member's local header;
then the index tells which range of the archive holds a record, and just that range is read and inflated.

Archives are written through the text sink, so that they reach any file system that Spark knows, under its commit
protocol: a lost executor leaves no half archive. That sink ends each row with a newline, which is the one byte of
the archive's comment, its last byte.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm.common import Scratch, text_bytes

#: Compressed bytes after which a new archive begins.
ARCHIVE_BYTES = 32 << 20
#: Bytes of neighbouring records that are read at once.
RANGE_BYTES = 4 << 20
DATA, INDEX, PACKAGE = "archive/data.warc.gz", "indexes/index.cdxj", "datapackage.json"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"


def _safe(value: str) -> str:
    """A header value without control characters or blanks: they are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC 1.1 record; with ``refers_to`` a revisit, which holds the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {RESPONSE if refers_to is None else REVISIT}", f"WARC-Record-ID: <urn:x-page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_safe(url) if url else 'about:blank'}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:x-page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class ArchiveWriter:
    """Collects records; ``close`` gives the bytes of the archive, whose comment is one newline."""

    def __init__(self):
        self.data, self.index = bytearray(), []

    def add(self, raw: bytes, **entry) -> None:
        packed = gzip.compress(raw, 3, mtime=0)
        self.index.append(json.dumps(entry | {"offset": len(self.data), "length": len(packed)}))
        self.data += packed

    def close(self) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
            for name, data in ((DATA, self.data), (INDEX, "\n".join(self.index).encode()), (PACKAGE, json.dumps({"profile": "data-package", "resources": [{"path": DATA}, {"path": INDEX}]}).encode())):
                with archive.open(zipfile.ZipInfo(name), "w", force_zip64=True) as member:
                    member.write(data)
            archive.comment = b"\n"
        return out.getvalue()


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    packed: int
    size: int
    header: int


class ZipReader:
    """A ZIP archive given as its size and a function that reads a range of it; nothing else is read."""

    def __init__(self, size: int, read_at: Callable[[int, int], bytes]):
        self.size, self.read_at = size, read_at
        self.members = {m.name: m for m in self._directory()}

    @classmethod
    def over(cls, data: bytes) -> ZipReader:
        view = memoryview(data)
        return cls(len(data), lambda at, n: bytes(view[at : at + n]))

    @classmethod
    def within(cls, file: pa.NativeFile, size: int) -> ZipReader:
        """An archive in a file that can be read at any place."""
        return cls(size, lambda at, n: file.read_at(n, at))

    def _directory(self) -> Iterator[Member]:
        tail = self.read_at(start := max(0, self.size - 65_557), self.size - start)
        if (at := tail.rfind(b"PK\x05\x06")) < 0:
            raise ValueError("no end record: not a ZIP archive")
        entries, length, first = struct.unpack_from("<HII", tail, at + 10)
        locator = start + at - 20
        if locator >= 0 and (found := self.read_at(locator, 20))[:4] == b"PK\x06\x07":
            (end,) = struct.unpack_from("<Q", found, 8)
            wide = self.read_at(end, 56)
            if wide[:4] != b"PK\x06\x06":
                raise ValueError("broken ZIP64 end record")
            entries, length, first = struct.unpack_from("<QQQ", wide, 32)
        raw, at = self.read_at(first, length), 0
        for _ in range(entries):
            if raw[at : at + 4] != b"PK\x01\x02":
                raise ValueError("broken central directory")
            flags, method = struct.unpack_from("<HH", raw, at + 8)
            packed, size, named, extra, comment = struct.unpack_from("<IIHHH", raw, at + 20)
            (header,) = struct.unpack_from("<I", raw, at + 42)
            name = raw[at + 46 : at + 46 + named].decode("utf-8" if flags & 0x800 else "cp437")
            more = raw[at + 46 + named : at + 46 + named + extra]
            values = self._wide(more)
            size = next(values) if size == 0xFFFFFFFF else size
            packed = next(values) if packed == 0xFFFFFFFF else packed
            header = next(values) if header == 0xFFFFFFFF else header
            yield Member(name, method, packed, size, header)
            at += 46 + named + extra + comment

    @staticmethod
    def _wide(extra: bytes) -> Iterator[int]:
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:
                yield from struct.unpack_from(f"<{n // 8}Q", extra, at + 4)
            at += 4 + n

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        """A range of a stored member."""
        member = self.members[name]
        if member.method:
            raise ValueError(f"{name} is compressed: it has no ranges")
        head = self.read_at(member.header, 30)
        if head[:4] != b"PK\x03\x04":
            raise ValueError("broken local header")
        named, extra = struct.unpack_from("<HH", head, 26)
        length = member.size - offset if length is None else length
        if offset < 0 or length < 0 or offset + length > member.size:
            raise ValueError("range beyond the member")
        return self.read_at(member.header + 30 + named + extra + offset, length)


def parse(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers (names in lower case), and the payload of a record."""

    def headers(part: bytes) -> dict[str, str]:
        return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in part.decode("utf-8", "replace").split("\r\n")[1:]) if k}

    top, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(top)
    block = rest[: int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return warc, headers(http), payload


def records(archive: ZipReader, at_once: int = RANGE_BYTES) -> Iterator[tuple[dict[str, str], dict[str, str], bytes]]:
    """Every record that the archive's index locates. Records that lie next to each other are read as one range of up to ``at_once`` bytes, or of one record."""
    run: list[tuple[int, int]] = []

    def cut():
        first = run[0][0]
        raw = archive.read(DATA, first, run[-1][0] + run[-1][1] - first)
        for offset, length in run:
            yield parse(gzip.decompress(raw[offset - first : offset - first + length]))

    for line in archive.read(INDEX).splitlines():
        entry = json.loads(line)
        if run and (run[-1][0] + run[-1][1] != entry["offset"] or entry["offset"] + entry["length"] - run[0][0] > at_once):
            yield from cut()
            run.clear()
        run.append((entry["offset"], entry["length"]))
    if run:
        yield from cut()


def _ranged(path: str) -> bool:
    """Whether Arrow has a file system for the path, by which Python workers read ranges of it."""
    try:
        FileSystem.from_uri(_uri(path))
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError):
        return False
    return True


def _uri(path: str) -> str:
    """A path as Spark names it, as Arrow reads it."""
    return "/" + path.removeprefix("file:").lstrip("/") if path.startswith("file:") else path


def write_archives(pages: DataFrame, path: str, min_payload: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for each row of ``pages`` (page_id, url, html; others are ignored) into archives under ``path``.

    A null html is an empty payload. Of rows with equal payloads of at least ``min_payload`` bytes those with the
    largest page_id are responses, the others revisits of it; smaller payloads are all responses. Null page_ids
    rank lowest and are never revisited. Payloads are compared by SHA-1; counts are taken before the shuffle, and AQE splits
    the rows of a payload that many pages share.
    """
    narrow = pages.select("page_id", "url", "html", F.sha1(text_bytes(F.col("html"))).alias("sha1"), F.octet_length(F.coalesce("html", F.lit(""))).alias("size"))
    shared = (
        narrow.where(F.col("size") >= min_payload).groupBy("sha1", "size")
        .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("holder")).where("n > 1").select("sha1", "size", "holder")
    )
    refers = F.when((F.col("holder") != F.col("page_id")) | (F.col("holder").isNotNull() & F.col("page_id").isNull()), F.col("holder"))
    rows = narrow.join(shared, ["sha1", "size"], "left").select("page_id", "url", "html", "sha1", refers.alias("refers_to"))

    def pack(batches):
        archive = ArchiveWriter()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for page_id, url, html, sha1, refers_to in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns)):
                    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                    archive.add(record(page_id, url, (html or "").encode(), digest, refers_to), url=url, digest=digest)
                    if len(archive.data) >= archive_bytes:
                        yield pa.RecordBatch.from_pydict({"value": pa.array([archive.close()[:-1]], pa.binary())})
                        archive = ArchiveWriter()
        if archive.index:
            yield pa.RecordBatch.from_pydict({"value": pa.array([archive.close()[:-1]], pa.binary())})

    rows.mapInArrow(pack, "value binary").select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record of the archives under ``path``: page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload (null for revisits).

    Spark lists the archives, a row for each, and its tasks read directories, index and records by ranges through Arrow's
    file systems; a worker holds one range. Of a store that Arrow doesn't know, archives come whole through Spark's reader
    (each under 2 GB) and are read by ranges in memory. No records give no archives; a file without bytes, as the sink may leave one, is passed over.

    A response's size and digest are those of the payload read, and it is an error if they aren't the ones its
    headers state; a revisit's come from its headers.
    """
    schema = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, payload binary"

    def unpack(batches):
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]

        def number(urn: str | None) -> int | None:
            return int(text) if urn and (text := urn.rpartition(":")[2].rstrip(">")) else None

        for batch in batches:
            for path_, length, content in zip(*batch.columns):
                rows = []
                if ranged:
                    system, name = FileSystem.from_uri(_uri(path_.as_py()))
                    archive = ZipReader.within(system.open_input_file(name), length.as_py())
                else:
                    archive = ZipReader.over(content.as_buffer())
                for warc, http, payload in records(archive):
                    stated = (int(http["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:"))
                    response = warc["warc-type"] == RESPONSE
                    if response and (len(payload), digest32(payload)) != stated:
                        raise ValueError(f"{warc['warc-record-id']}: payload and headers differ")
                    rows.append((number(warc["warc-record-id"]), warc["warc-target-uri"], warc["warc-type"], number(warc.get("warc-refers-to")), *stated, payload if response else None))
                    if len(rows) == 512:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    ranged = _ranged(where.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(where).toString())
    found = spark.read.format("binaryFile").load(path).where("length > 0")
    if ranged:
        # a task for each archive, or several for as many as the session has partitions
        tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
        found = found.select("path", "length").repartition(tasks, "path").withColumn("content", F.lit(None).cast("binary"))
    return found.select("path", "length", "content").mapInArrow(unpack, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read the digest columns back from there."""
    spark = pages.sparkSession
    path = f"{Scratch(spark, 'warc').root}/archives"
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

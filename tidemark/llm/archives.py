"""WARC records in ZIP packages, and a reader that works by ranges.

A package holds two stored members: archive/data.warc.gz (one gzip member for each record) and indexes/index.cdxj (one
line for each record: key, number, JSON with offset and length in the archive).  The reader finds the end record, the
ZIP64 locator and directory where there is one, the central directory and the members' local headers, and then reads
single records by their offset and length; nothing is extracted.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, lean, ship, slices, stored, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "1970-01-01T00:00:00Z"  # pages carry no capture time


def _line(text: str) -> str:
    """A header value: control characters and non-ASCII as percent escapes."""
    return "".join(c if " " <= c <= "~" else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in text)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {_line(url or '')}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_package(records: list[tuple[int | None, str | None, bytes]], zip64: bool = True) -> bytes:
    """A package of (page_id, url, record) in order."""
    data, index, at = [], [], 0
    for n, (page_id, url, raw) in enumerate(records):
        part = gzip.compress(raw, 1, mtime=0)
        data.append(part)
        index.append(f"{_line(url or '').replace(' ', '%20')} {n:09d} " + json.dumps({"page_id": page_id, "offset": at, "length": len(part)}))
        at += len(part)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, raw in ((DATA, b"".join(data)), (INDEX, ("\n".join(index) + "\n").encode())):
            with z.open(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), "w", force_zip64=zip64) as member:
                member.write(raw)
    return out.getvalue()


class Package:
    """Reads a package from a seekable file by ranges."""

    def __init__(self, file: BinaryIO):
        self.file = file
        self.size = file.seek(0, 2)
        self.members = self._directory()

    def range(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        raw = self.file.read(size)
        if len(raw) != size:
            raise ValueError(f"the package ends within {size} bytes at {at}")
        return raw

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """name: (method, size, local header's place)."""
        tail = self.range(max(0, self.size - 65_557), min(self.size, 65_557))
        end = tail.rfind(b"PK\5\6")
        if end < 0 or len(tail) - end < 22:
            raise ValueError("no end of central directory")
        count, size, at = struct.unpack("<HII", tail[end + 10 : end + 20])
        place = self.size - len(tail) + end
        if place >= 20 and (locator := self.range(place - 20, 20))[:4] == b"PK\6\7":
            record64 = self.range(struct.unpack("<Q", locator[8:16])[0], 56)
            if record64[:4] != b"PK\6\6":
                raise ValueError("no ZIP64 end of central directory")
            count, size, at = struct.unpack("<QQQ", record64[32:56])
        raw, i, out = self.range(at, size), 0, {}
        for _ in range(count):
            if raw[i : i + 4] != b"PK\1\2":
                raise ValueError("the central directory is broken")
            flags, method = struct.unpack("<HH", raw[i + 8 : i + 12])
            packed, full, n, m, k = struct.unpack("<IIHHH", raw[i + 20 : i + 34])
            local = struct.unpack("<I", raw[i + 42 : i + 46])[0]
            name, extra = raw[i + 46 : i + 46 + n], raw[i + 46 + n : i + 46 + n + m]
            j = 0
            while j + 4 <= len(extra):
                tag, length = struct.unpack("<HH", extra[j : j + 4])
                if tag == 1:  # ZIP64: those of the three that don't fit in 32 bits, in this order
                    wide = iter(struct.unpack(f"<{length // 8}Q", extra[j + 4 : j + 4 + length // 8 * 8]))
                    full = next(wide) if full == 0xFFFFFFFF else full
                    packed = next(wide) if packed == 0xFFFFFFFF else packed
                    local = next(wide) if local == 0xFFFFFFFF else local
                j += 4 + length
            out[name.decode("utf-8" if flags & 0x800 else "cp437")] = (method, packed, local)
            i += 46 + n + m + k
        return out

    def place(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes."""
        method, size, local = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed; only stored members can be read by range")
        head = self.range(local, 30)
        if head[:4] != b"PK\3\4":
            raise ValueError(f"{name} has no local header")
        n, m = struct.unpack("<HH", head[26:30])
        return local + 30 + n + m, size

    def index(self) -> Iterator[dict]:
        for line in self.range(*self.place(INDEX)).decode().splitlines():
            yield json.loads(line.split(" ", 2)[2])

    def read(self, offset: int, length: int) -> tuple[dict[str, str], bytes]:
        """Headers and block of one record."""
        at, size = self.place(DATA) if not hasattr(self, "_data") else self._data
        self._data = at, size
        if not 0 <= offset <= offset + length <= size:
            raise ValueError("the record is not in the archive")
        raw = zlib.decompress(self.range(at + offset, length), 31)
        head, _, rest = raw.partition(b"\r\n\r\n")
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = dict(line.split(": ", 1) for line in lines)
        return headers, rest[: int(headers["Content-Length"])]


def with_revisits(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, html, digest, refers_to: equal payloads of at least `least` bytes refer to the smallest page_id.

    A null html is empty.  A row with a null page_id is always a response, and so is each of rows that share the
    smallest page_id.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    # page_id and digest only: payloads that many pages share, or short ones, make no heavy key
    light = rows.where((F.octet_length("html") >= least) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = stored(light.groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first"), "first")
    links = stored(light.join(first, "digest").where("page_id > first").select("page_id", "digest", F.col("first").alias("refers_to")).distinct(), "links")
    discard(first)
    return rows.join(links, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")


PACKAGES = "part int, package int, n_records long, file binary"
READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def write_packages(pages: DataFrame, package_bytes: int = 8 << 20) -> DataFrame:
    """Rows (part, package, n_records, file) of packages with about package_bytes of payload each, one longer page at most beyond."""
    ship(pages.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        part, n, size = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []

        def out():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int32()), pa.array([len(held)], pa.int64()), pa.array([write_package(held)], pa.binary())], names=["part", "package", "n_records", "file"])

        for batch in batches:
            for i, j in slices(batch, column="html"):
                for r in batch.slice(i, j - i).to_pylist():
                    payload = r["html"].encode("utf-8", "surrogatepass")
                    held.append((r["page_id"], r["url"], record(r["page_id"], r["url"], payload, r["digest"], r["refers_to"])))
                    size += len(payload)
                    if size >= package_bytes:
                        yield out()
                        held, n, size = [], n + 1, 0
        if held:
            yield out()

    return with_revisits(pages).mapInArrow(lean(run), PACKAGES)


def read_packages(packages: DataFrame) -> DataFrame:
    """A row for each record in the packages; a response's digest and length are taken from its payload."""
    ship(packages.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])

    def number(urn: str) -> int | None:
        return int(urn[10:-1]) if len(urn) > 11 else None

    def run(batches):
        for batch in batches:
            for blob in batch.column("file"):
                package, rows, size = Package(io.BytesIO(blob.as_buffer())), [], 0
                for entry in package.index():
                    head, block = package.read(entry["offset"], entry["length"])
                    payload = block.partition(b"\r\n\r\n")[2]
                    kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(payload).hexdigest() != digest:
                        raise ValueError(f"page {entry['page_id']}: the payload doesn't have its digest")
                    rows.append({"page_id": number(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": len(payload) if kind == "response" else int(head["X-Payload-Length"]), "payload_digest": digest, "record_type": kind, "refers_to": number(head["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None})
                    size += len(payload)
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return packages.select("file").mapInArrow(lean(run), READ)


def op10_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract op10: pages as WARC records in ZIP packages, read back."""
    packages = stored(write_packages(table(spark, sf_dir, "pages")), "packages", compression="none")
    return read_packages(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN p.page_id > f.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > f.first THEN f.first END AS refers_to
FROM p LEFT JOIN f ON f.payload_digest = p.payload_digest
"""

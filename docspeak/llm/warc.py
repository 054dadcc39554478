"""Legacy ARC archives to WARC.

Pages are written as ARC files of either version, parsed by the version's own
header line and the declared lengths, and converted: record ids, timestamps, types
and digests that ARC lacks are made from what it has. A payload that an earlier
record holds becomes a revisit. A record's id comes from its archive's name and its place
there, so no two share one. In both formats each record is a gzip member of its own. Archives are
files of Spark's own text writer, one a row, so they are committed and read back wherever
Spark can write; what the writer ends a row with is an empty member.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Bytes of an archive before compression, about; payloads from this size on are deduplicated.
ARCHIVE_BYTES, REVISIT_BYTES = 4 << 20, 100
#: How hard records are compressed.
LEVEL = 3
ADDRESS, DATE = "0.0.0.0", "20200101000000"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
V1 = "URL IP-address Archive-date Content-type Archive-length"
V2 = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
_ODD = re.compile(r"[\x00-\x20\x7f]")
_EMPTY_MEMBER = zlib.compress(b"", 6, 31).decode("latin-1")
_SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


@dataclass
class Record:
    offset: int
    uri: str
    address: str
    date: str
    kind: str
    block: bytes
    archive: str = ""

    @property
    def head(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[0]

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    def field(self, name: str) -> str | None:
        for line in self.head.decode("utf-8").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            if key.lower() == name.lower():
                return value.strip()
        return None

    @property
    def page_id(self) -> int | None:
        got = self.field("X-Page-Id")
        return int(got) if got else None


def http_block(page_id: int | None, payload: bytes) -> bytes:
    own = "" if page_id is None else f"X-Page-Id: {page_id}\r\n"
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{own}\r\n".encode() + payload


def arc_start(name: str, version: int) -> bytes:
    """The version block that an archive begins with."""
    body = f"{version} 0 docspeak\n{V1 if version == 1 else V2}\n".encode()
    more = "" if version == 1 else "200 - - 0 " + name + " "
    return f"filedesc://{name} {ADDRESS} {DATE} text/plain {more}{len(body)}\n".encode() + body + b"\n"


def arc_record(uri: str | None, block: bytes, version: int, offset: int, name: str) -> bytes:
    """A record; white space in an address is percent-encoded, as it would end the field."""
    uri = _ODD.sub(lambda m: f"%{ord(m[0]):02X}", uri) if uri else "urn:none"
    more = "" if version == 1 else f"200 {zlib.crc32(block):08x} - {offset} {name} "
    return f"{uri} {ADDRESS} {DATE} text/html {more}{len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes) -> Iterator[Record]:
    """Records of one archive. The version block tells which fields a header line has; lengths are as declared."""
    at, fields, archive = 0, 0, ""
    while at < len(data):
        if data[at : at + 1] == b"\n":  # between records
            at += 1
            continue
        end = data.index(b"\n", at)
        line = data[at:end].decode("utf-8")
        if not fields:
            if not line.startswith("filedesc://"):
                raise ValueError("an archive begins with its version block")
            size = int(line.rpartition(" ")[2])
            version = data[end + 1 : end + 1 + size].split(b" ", 1)[0]
            if version not in (b"1", b"2"):
                raise ValueError(f"ARC version {version!r}")
            fields, archive = 5 if version == b"1" else 10, line.split(" ", 1)[0].removeprefix("filedesc://")
            at = end + 1 + size
            continue
        part = line.rsplit(" ", fields - 1)
        if len(part) != fields:
            raise ValueError(f"not a header of {fields} fields at byte {at}")
        size = int(part[-1])
        if end + 1 + size > len(data):
            raise ValueError("the archive ends within a record")
        yield Record(at, part[0], part[1], part[2], part[3], data[end + 1 : end + 1 + size], archive)
        at = end + 1 + size


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))])
    return f"WARC/1.0\r\n{lines}\r\n".encode() + block + b"\r\n\r\n"


def record_id(archive: str, place: int | str) -> str:
    """The same for the record at that place of an archive of that name, whenever it is converted."""
    return f"<urn:uuid:{uuid.uuid5(_SPACE, f'{archive} {place}')}>"


def warc_date(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def convert(r: Record, refers: tuple[int | None, str, str, int] | None) -> bytes:
    """The WARC record of an ARC record; ``refers``: page, address, archive and place of the record that holds the payload."""
    digest = hashlib.sha256(r.payload).hexdigest()
    block = r.block if refers is None else r.head + b"\r\n\r\n"
    fields = [
        ("WARC-Type", "response" if refers is None else "revisit"),
        ("WARC-Record-ID", record_id(r.archive, r.offset)),
        ("WARC-Date", warc_date(r.date)),
        ("WARC-Target-URI", r.uri),
        ("WARC-IP-Address", r.address),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if refers is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(*refers[2:])), ("WARC-Refers-To-Target-URI", refers[1])]
        if refers[0] is not None:
            fields.append(("X-Refers-To-Page-Id", str(refers[0])))
    return warc_record(fields, block)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields, in lower case, and block of each record."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        first, *lines = data[at:end].decode("utf-8").split("\r\n")
        if not first.startswith("WARC/1."):
            raise ValueError(f"no WARC record at byte {at}")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        size = int(fields["content-length"])
        yield fields, data[end + 4 : end + 4 + size]
        at = end + 4 + size + 4


def members(parts: list[bytes]) -> bytes:
    """Each part as a gzip member."""
    return b"".join([zlib.compress(p, LEVEL, 31) for p in parts])


def unpacked(content: bytes) -> bytes:
    return gzip.GzipFile(fileobj=io.BytesIO(content)).read()


def _write(archives: DataFrame, name: str) -> str:
    """Write the bytes of each row as a file."""
    path = common.scratch_path(archives.sparkSession, name)
    rows = archives.select(F.col("value").cast("string"))
    rows.write.option("compression", "none").option("encoding", "ISO-8859-1").option("lineSep", _EMPTY_MEMBER).option("maxRecordsPerFile", 1).text(path)
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")


def write_arc(pages: DataFrame, versions: tuple[int, ...] = (1, 2)) -> str:
    """Write ``page_id, url, html`` as ARC files in the shared folder; archives of a task take the versions in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size, n, task = [], 0, 0, TaskContext.get().partitionId()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([members(parts)], pa.binary())], names=["value"])

        for batch in common.small(batches):
            for page_id, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                version, name = versions[n % len(versions)], f"docspeak-{task:06d}-{n:06d}.arc"
                if not parts:
                    parts = [arc_start(name, version)]
                    size = len(parts[0])
                parts.append(arc_record(url, http_block(page_id, (html or "").encode()), version, size, name))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    parts, n = [], n + 1
        if parts:
            yield done()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return _write(rows.mapInArrow(run, "value binary"), "arc")


def list_arc(spark: SparkSession, path: str) -> DataFrame:
    """Archive, place, page, address, size and digest of every ARC record, without payloads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = [(name, r.archive, r.offset, r.page_id, r.uri, len(r.payload), hashlib.sha256(r.payload).hexdigest()) for r in parse_arc(unpacked(content.as_py()))]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["path", "archive", "at", "page_id", "uri", "n", "digest"])

    return _files(spark, path).mapInArrow(run, "path string, archive string, at long, page_id long, uri string, n long, digest string")


def revisits(records: DataFrame) -> DataFrame:
    """For each archive, the records whose payload another one holds, and which.

    The record of the smallest page holds it; records of one page are ordered by
    place, those without page come last. Digests that occur once never meet again after the count.
    """
    place = F.struct(F.coalesce("page_id", F.lit((1 << 63) - 1)).alias("k"), "archive", "at", "page_id", "uri")
    first = records.where(F.col("n") >= REVISIT_BYTES).groupBy("digest").agg(F.min(place).alias("first"), F.count("*").alias("times")).where(F.col("times") > 1)
    again = records.where(F.col("n") >= REVISIT_BYTES).join(first, "digest")
    again = again.where((F.col("archive") != F.col("first.archive")) | (F.col("at") != F.col("first.at")))
    return again.groupBy("path").agg(F.collect_list(F.struct("at", F.col("first.page_id").alias("page_id"), F.col("first.uri").alias("uri"), F.col("first.archive").alias("archive"), F.col("first.at").alias("place"))).alias("refers"))


def to_warc(spark: SparkSession, arc: str, again: DataFrame) -> str:
    """Convert ARC files into WARC files, one for one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, refers in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                known = {r["at"]: (r["page_id"], r["uri"], r["archive"], r["place"]) for r in refers or ()}
                records = list(parse_arc(unpacked(content.as_py())))
                info = warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(records[0].archive, "info")), ("WARC-Date", warc_date(DATE)), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.0\r\n")
                data = members([info, *(convert(r, known.get(r.offset)) for r in records)])
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["value"])

    rows = _files(spark, arc).join(again, "path", "left").select("content", "refers")
    return _write(rows.mapInArrow(run, "value binary"), "warc")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """What the archives hold: a row for each response or revisit. A payload that doesn't match its digest fails."""
    added = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "record_id": pa.string(), "warc_date": pa.string(), "target_uri": pa.string()}

    def one(f: dict[str, str], block: bytes) -> tuple:
        r = Record(0, "", "", "", "", block)
        digest, size = f["warc-payload-digest"].removeprefix("sha256:"), int(r.field("Content-Length"))
        if f["warc-type"] == "response" and (len(r.payload) != size or hashlib.sha256(r.payload).hexdigest() != digest):
            raise ValueError(f"damaged record {f['warc-record-id']}")
        refers = f.get("x-refers-to-page-id")
        return r.page_id, size, digest, f["warc-type"], int(refers) if refers else None, f["warc-record-id"], f["warc-date"], f["warc-target-uri"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(1):
                rows = [one(f, block) for f, block in parse_warc(unpacked(content.as_py())) if f["warc-type"] != "warcinfo"]
                cols = list(zip(*rows, strict=True)) if rows else [()] * len(added)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, added.values(), strict=True)], names=list(added))

    return _files(spark, path).mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, warc_date string, target_uri string")


def archive(pages: DataFrame) -> DataFrame:
    """Pages to ARC, ARC to WARC, and the WARC files read back: a row a page.

    A null html is an empty payload, a null url ``urn:none``; a page without id keeps
    none. Payloads under ``REVISIT_BYTES`` are always responses. Of repeated
    rows one is the response, the others revisit its page. An empty table gives no row.
    """
    spark = pages.sparkSession
    arc = write_arc(pages)
    again = common.saved(revisits(list_arc(spark, arc)), "revisits")
    return read_warc(spark, to_warc(spark, arc, again))

"""Legacy archive converter: ARC files of version 1 and 2 become WARC records.

ARC: a first record names the file and the version, whose field list says how each later header line reads; the
declared length says where a record ends. WARC: identifiers, ISO timestamps, types and digests are made from what
the ARC record holds. Archives are rows of whole files; Spark's text writer puts one in each file (its bytes pass
unchanged), so any store that Spark writes to will do. Archives are written as one Zstandard frame each; gzip members
and plain files are read as well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shared_path

#: Bytes of records, before compression, after which a new archive begins.
ARCHIVE_BYTES = 8 << 20
#: A byte that ends each file: readers of compressed members pass over zeros.
PADDING = "\x00"
#: Fixed values of the formats.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_ID = "X-Page-Id"


@dataclass
class ArcRecord:
    url: str
    ip: str
    date: str
    content_type: str
    content: bytes


#: What may lie between records.
_GAP = re.compile(rb"[\r\n\x00]*")


def compressed(data: bytes, level: int = 3) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=level).compress(data)


def plain(data: bytes) -> bytes:
    import zstandard

    reader = zstandard.ZstdDecompressor().decompressobj()
    try:
        found = reader.decompress(data)
    except zstandard.ZstdError as e:
        raise ValueError(str(e)) from e
    if not reader.eof:
        raise ValueError("a compressed member is cut short")
    return found


def members(data: bytes) -> Iterator[bytes]:
    """The plain bytes of each compressed member; data without compression is one member."""
    if data[:4] == b"\x28\xb5\x2f\xfd":
        yield plain(data)
        return
    if data[:2] != b"\x1f\x8b":
        yield data
        return
    while data.rstrip(b"\x00"):
        reader = zlib.decompressobj(31)
        yield reader.decompress(data) + reader.flush()
        if not reader.eof:
            raise ValueError("a compressed member is cut short")
        data = reader.unused_data


def arc_head(name: str, date: str, version: int) -> bytes:
    body = f"{version} 0 origin\n{' '.join(ARC_FIELDS[version])}\n".encode()
    tail = f"text/plain {len(body)}" if version == 1 else f"text/plain 200 - - 0 {name} {len(body)}"
    return f"filedesc://{name} 0.0.0.0 {date} {tail}\n".encode() + body + b"\n"


def arc_record(url: str, ip: str, date: str, content_type: str, content: bytes, version: int, name: str = "-", offset: int = 0) -> bytes:
    url = re.sub(r"\s", lambda m: f"%{ord(m[0]):02X}", url) or "-"
    if version == 1:
        head = f"{url} {ip} {date} {content_type} {len(content)}"
    else:
        head = f"{url} {ip} {date} {content_type} 200 {hashlib.md5(content).hexdigest()} - {offset} {name} {len(content)}"
    return head.encode() + b"\n" + content + b"\n"


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """Records of one archive, its first (file description) left out. A damaged header or length ends the archive with an error."""
    version = None
    for part in members(data):
        at = 0
        while True:
            while at < len(part) and part[at] in b"\r\n\x00":
                at += 1
            if at >= len(part):
                break
            end = part.find(b"\n", at)
            fields = part[at : end if end >= 0 else len(part)].decode("utf-8", "replace").split(" ")
            expected = 5 if version == 1 else 10 if version == 2 else len(fields)
            if end < 0 or len(fields) != expected or not fields[-1].strip().isdigit():
                raise ValueError(f"no header line of ARC version {version} at byte {at}")
            length = int(fields[-1])
            content = part[end + 1 : end + 1 + length]
            if len(content) < length:
                raise ValueError(f"a record at byte {at} declares {length} bytes and has {len(content)}")
            if version is None:
                if not fields[0].startswith("filedesc://"):
                    raise ValueError("the first record of an ARC file describes it")
                version = int(content.split(b" ", 1)[0])
                if version not in ARC_FIELDS:
                    raise ValueError(f"ARC version {version}")
            else:
                yield ArcRecord(fields[0], fields[1], fields[2], fields[3], content)
            at = end + 1 + length


def payload_of(http: bytes) -> tuple[bytes, bytes]:
    """(header block with its empty line, payload) of an HTTP response."""
    head, gap, payload = http.partition(b"\r\n\r\n")
    return (head + gap, payload) if gap else (b"", http)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(record: ArcRecord) -> str:
    """The same record always gets the same identifier."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{record.url} {record.date} {digest(record.content)}')}"


def iso_date(date: str) -> str:
    date = (date + "00000101000000"[len(date) :])[:14] if len(date) < 14 else date[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(record: ArcRecord, refers_to: tuple[str, str] | None = None) -> bytes:
    """A response, or with refers_to (identifier, URL) a revisit, which keeps the HTTP headers only. Content that isn't HTTP becomes a resource."""
    head, payload = payload_of(record.content)
    http = bool(head)
    kind = "revisit" if refers_to else "response" if http else "resource"
    block = head if refers_to else record.content
    lines = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id(record)}>"),
        ("WARC-Date", iso_date(record.date)),
        ("WARC-Target-URI", record.url),
        ("WARC-IP-Address", record.ip),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"),
        ("WARC-Block-Digest", f"sha1:{digest(block)}"),
    ]
    if refers_to:
        lines += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<{refers_to[0]}>"), ("WARC-Refers-To-Target-URI", refers_to[1])]
    lines += [("Content-Type", "application/http;msgtype=response" if http else record.content_type), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def read_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record."""
    for part in members(data):
        at = 0
        while (at := _GAP.match(part, at).end()) < len(part):
            end = part.find(b"\r\n\r\n", at)
            first, *lines = part[at:end].decode("utf-8", "replace").split("\r\n")
            if end < 0 or not first.startswith("WARC/"):
                raise ValueError(f"no WARC record at byte {at}")
            head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            length = int(head["content-length"])
            block = part[end + 4 : end + 4 + length]
            if len(block) < length:
                raise ValueError(f"a record at byte {at} declares {length} bytes and has {len(block)}")
            yield head, block
            at = end + 4 + length


def write_archives(archives: DataFrame, path: str) -> None:
    """archives: one binary column, a whole archive in each row."""
    column = F.col(archives.columns[0]).cast("string")
    archives.select(column.alias("value")).write.option("maxRecordsPerFile", 1).option("lineSep", PADDING).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def pages_to_arc(pages: DataFrame, version_of=lambda n: 1 + n % 2, date: str = "20240101000000") -> DataFrame:
    """Archives (binary) of pages (page_id, url, html). Versions take turns from archive to archive. Null html is an empty payload."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, parts, size = 0, [], 0

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([compressed(b"".join(parts))], pa.binary())], names=["content"])

        for batch in batches:
            for page, url, html in zip(*(batch.column(i) for i in range(3)), strict=True):
                payload, page = html.as_py() or b"", page.as_py()
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n{HTTP_ID}: {'' if page is None else page}\r\n\r\n"
                name, version = f"part-{n}.arc", version_of(n)
                if not parts:
                    parts.append(arc_head(name, date, version))
                    size = len(parts[0])
                parts.append(arc_record(url.as_py() or "", "0.0.0.0", date, "text/html", head.encode() + payload, version, name, size))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield done()
                    n, parts, size = n + 1, [], 0
        if parts:
            yield done()

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("binary")).mapInArrow(build, "content binary")


_CONVERTED = "page_id long, url string, ip string, date string, content_type string, http binary, record_id string, payload_bytes long, payload_digest string, error string"
#: What reading a damaged archive raises.
_FAULTS = (ValueError, KeyError, EOFError, zlib.error)


def _until_damaged(read, data: bytes) -> Iterator:
    """What read yields, and the message of a fault that ends it."""
    try:
        yield from read(data)
    except _FAULTS as e:
        yield f"{type(e).__name__}: {e}"


def arc_records(archives: DataFrame) -> DataFrame:
    """One row per ARC record, with what its WARC record will be made from; http is compressed, as it is shuffled. Where an
    archive is damaged, its records before the damage are rows, and one row has nothing but the error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("page_id", pa.int64()), *((x, pa.string()) for x in ("url", "ip", "date", "content_type")), ("http", pa.binary()), ("record_id", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("error", pa.string())])
        for batch in batches:
            for archive in batch.column(0):
                rows: list[tuple] = []
                size = 0
                for r in _until_damaged(read_arc, archive.as_py()):
                    if isinstance(r, str):
                        rows.append((*[None] * 9, r))
                        continue
                    head, payload = payload_of(r.content)
                    page = re.search(rf"(?mi)^{HTTP_ID}: (-?\d+)\r?$", head.decode("utf-8", "replace"))
                    rows.append((int(page[1]) if page else None, r.url, r.ip, r.date, r.content_type, compressed(r.content, 1), record_id(r), len(payload), digest(payload), None))
                    size += len(r.content)
                    if size >= ARCHIVE_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return archives.mapInArrow(parse, _CONVERTED)


def warc_archives(records: DataFrame, first_of: DataFrame) -> DataFrame:
    """records (arc_records) as WARC archives. first_of (record_id, refers_id, refers_url): the records that become revisits."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for url, ip, date, kind, http, refers, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                parts.append(warc_record(ArcRecord(url, ip, date, kind, plain(http)), (refers, refers_url) if refers else None))
                size += len(parts[-1])
                if size >= ARCHIVE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([compressed(b"".join(parts))], pa.binary())], names=["content"])
                    parts, size = [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array([compressed(b"".join(parts))], pa.binary())], names=["content"])

    joined = records.join(first_of, "record_id", "left")
    return joined.select("url", "ip", "date", "content_type", "http", "refers_id", "refers_url").mapInArrow(build, "content binary")


def warc_index(archives: DataFrame) -> DataFrame:
    """One row per WARC record: page_id, record_id, record_type, payload_bytes, payload_digest, refers_id, error. The digest of
    the payload is made again, that of the block where a record holds no payload: where it differs, and where an archive is
    damaged, the row has an error."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for archive in batch.column(0):
                rows = []
                for found in _until_damaged(read_warc, archive.as_py()):
                    if isinstance(found, str):
                        rows.append((*[None] * 6, found))
                        continue
                    head, block = found
                    http, payload = payload_of(block)
                    page = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r?$", http)
                    declared = re.search(rb"(?mi)^Content-Length: (\d+)\r?$", http)
                    revisit = head.get("warc-type") == "revisit"
                    error = None
                    if "sha1:" + digest(block if revisit else payload) != head.get("warc-block-digest" if revisit else "warc-payload-digest"):
                        error = f"digest of {head.get('warc-record-id')}"
                    size = int(declared[1]) if revisit and declared else len(payload)
                    rows.append((int(page[1]) if page else None, head.get("warc-record-id", "").strip("<>"), head.get("warc-type"), size, head.get("warc-payload-digest", "").removeprefix("sha1:"), head.get("warc-refers-to", "").strip("<>") or None, error))
                if rows:
                    kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "refers_id", "error"])

    return archives.mapInArrow(parse, "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, refers_id string, error string")


def revisits(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(record_id, refers_id, refers_url) of each record whose payload an earlier one has. Only narrow columns are shuffled;
    the first of equal payloads is found with a map-side minimum, so one payload may hold any share of the rows."""
    large = records.where(F.col("payload_bytes") >= least_bytes).select("record_id", "url", "page_id", "payload_bytes", "payload_digest")
    same = ["payload_digest", "payload_bytes"]
    # a null page_id comes last among equal payloads
    place = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")
    first = large.groupBy(*same).agg(F.min(place).alias("first"))
    return large.join(first, same).where("record_id <> first.record_id").select("record_id", F.col("first.record_id").alias("refers_id"), F.col("first.url").alias("refers_url")).distinct()


def convert(archives: DataFrame, path: str, least_bytes: int = 0) -> DataFrame:
    """ARC archives (content binary) to WARC files in the folder path. Returns the errors of damaged archives (error), whose
    records before the damage are converted."""
    records = arc_records(archives)
    narrow = cut(records.select("record_id", "url", "page_id", "payload_bytes", "payload_digest", "error"), "arc-index")
    write_archives(warc_archives(records.where("error IS NULL").drop("error"), revisits(narrow.where("error IS NULL"), least_bytes)), path)
    return narrow.where("error IS NOT NULL").select("error")


def pages_through_warc(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write pages as ARC, convert to WARC, and read that back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    Null html is an empty payload, null url is '-'. Rows repeated with all their columns are one capture written
    twice: they share an identifier and so all are responses. An empty table gives no rows.
    """
    spark = pages.sparkSession
    arc, warc = shared_path(spark, "arc"), shared_path(spark, "warc")
    write_archives(pages_to_arc(pages), arc)
    convert(read_archives(spark, arc), warc, least_bytes)
    index = cut(warc_index(read_archives(spark, warc)), "warc-index")
    if not index.where("error IS NOT NULL").isEmpty():  # what was written just now
        raise ValueError(f"{warc} is damaged")
    targets = index.where("record_type <> 'revisit'").groupBy(F.col("record_id").alias("refers_id")).agg(F.min("page_id").alias("refers_to"))
    return index.join(targets, "refers_id", "left").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

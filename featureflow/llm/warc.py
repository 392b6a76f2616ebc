"""Legacy ARC archives to WARC, and reading WARC back.

An ARC file starts with a version block; its version says which fields a record's header line has.
A header line ends with the declared length of the record's content. Each record becomes a WARC
record: its identifier, timestamp, type and digests are made from what the ARC line and the content
say. Of records with equal payloads of some size, the one with the largest page id stays a response,
the others become revisits that refer to it.

WARC files are written by Spark's text writer, whose commit leaves no parts of lost tasks: a string
column may hold any bytes, and the line separator is the end of a record. They are read back whole,
as a stream through the decompressor, by declared lengths.

Cases: an empty table gives an archive without records. Texts of any length are one payload, and a
worker holds one ARC file of pages at a time. Null html is an empty payload; a null url becomes "-", white space in a url is percent-coded.
A null page_id has no page header and is read back as null; it never becomes the response that
others refer to. Rows that repeat the largest page_id are responses all. Other columns are ignored.
An archive that breaks off, or whose digest doesn't match, raises ValueError.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from featureflow.llm.common import BROADCAST_BYTES, drop, in_worker, materialise

#: The fields of a record's header line in each version of the ARC format, as published.
ARC_FIELDS = {
    1: ("url", "ip", "date", "type", "length"),
    2: ("url", "ip", "date", "type", "result", "checksum", "location", "offset", "file", "length"),
}
#: Bytes of pages in one ARC file.
ARC_BYTES = 4 << 20
#: Payloads from this size on are replaced by revisits where they repeat.
LEAST = 1000
#: Bytes of records in one WARC file before compression, and of a record's headers; bytes of a broadcast original.
WARC_BYTES, HEADER_BYTES, ORIGINAL_BYTES = 256 << 20, 600, 128
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _http(page_id: int | None, payload: bytes) -> bytes:
    page = b"" if page_id is None else b"X-Page-Id: %d\r\n" % page_id
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%sContent-Length: %d\r\n\r\n" % (page, len(payload))


def write_arc(name: str, version: int, records: list[tuple[int | None, str | None, bytes]], date: str = "20240101000000") -> bytes:
    """An ARC file of (page_id, url, payload) records."""
    fields = ARC_FIELDS[version]
    about = b"%d 0 featureflow\n%s\n" % (version, " ".join({"url": "URL", "ip": "IP-address", "date": "Archive-date", "type": "Content-type", "result": "Result-code", "checksum": "Checksum", "location": "Location", "offset": "Offset", "file": "Filename", "length": "Archive-length"}[f] for f in fields).encode())
    out = io.BytesIO()

    def put(url: str, kind: str, content: bytes) -> None:
        values = {"url": url, "ip": "0.0.0.0", "date": date, "type": kind, "result": "200", "checksum": "-", "location": "-", "offset": str(out.tell()), "file": name, "length": str(len(content))}
        out.write(" ".join(values[f] for f in fields).encode() + b"\n" + content + b"\n")

    put(f"filedesc://{name}", "text/plain", about)
    for page_id, url, payload in records:
        clean = re.sub(r"\s", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "-")
        put(clean, "text/html", _http(page_id, payload) + payload)
    return out.getvalue()


def read_arc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and content of each record of an ARC file, the version block first."""
    at, fields = 0, ARC_FIELDS[1]
    while at < len(data):
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("an ARC header line breaks off")
        line = data[at:end].decode("utf-8", "surrogateescape")
        if not at:  # the version block's own line has the fields of its version, and a length at its end in both
            first = data[end + 1 : end + 64].split(b" ", 1)[0]
            if not first.isdigit() or int(first) not in ARC_FIELDS:
                raise ValueError(f"unknown ARC version {first[:20]!r}")
            fields = ARC_FIELDS[int(first)]
        values = line.rsplit(" ", len(fields) - 1)  # an old url may hold spaces
        if len(values) != len(fields) or not values[-1].isdigit():
            raise ValueError(f"not an ARC header line: {line[:80]!r}")
        size = int(values[-1])
        content = data[end + 1 : end + 1 + size]
        if len(content) < size:
            raise ValueError("an ARC record breaks off")
        yield dict(zip(fields, values, strict=True)), content
        at = end + 1 + size
        while data[at : at + 1] == b"\n":
            at += 1


def warc_date(arc_date: str) -> str:
    """ARC's digits, which may leave out the time or its seconds, or the day and month, as WARC writes it."""
    year, month, day = arc_date[:4].ljust(4, "0"), arc_date[4:6].ljust(2, "0"), arc_date[6:8].ljust(2, "0")
    t = arc_date[8:14].ljust(6, "0")
    return f"{year}-{'01' if month == '00' else month}-{'01' if day == '00' else day}T{t[:2]}:{t[2:4]}:{t[4:6]}Z"


RECORD = "page_id long, uri string, date string, ip string, kind string, content_type string, head binary, payload binary, payload_bytes long, payload_digest string, block_digest string"


def convert_record(line: dict[str, str], content: bytes, first: bool = False) -> tuple:
    """RECORD's values for a record of an ARC file; the first one is its version block."""
    page = None
    if first:
        kind, type_, head, payload = "warcinfo", "application/warc-fields", b"", content
    elif line["url"].startswith(("http:", "https:")) or content.startswith(b"HTTP/"):
        head, gap, payload = content.partition(b"\r\n\r\n")
        head += gap
        kind, type_ = "response", "application/http; msgtype=response"
        found = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r$", head)
        page = int(found[1]) if found else None
    else:  # dns, ftp and other schemes have no protocol headers of their own
        kind, type_, head, payload = "resource", line["type"], b"", content
    return page, line["url"], warc_date(line["date"]), line["ip"], kind, type_, head, payload, len(payload), hashlib.sha1(payload).hexdigest(), hashlib.sha1(content).hexdigest()


def convert_arc(files: DataFrame) -> DataFrame:
    """ARC files (content binary) -> RECORD, one row a record; version blocks are left out, each WARC file gets its own."""
    names = [f.split()[0] for f in RECORD.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[f.split()[1]] for f in RECORD.split(", ")]

    @in_worker("warc")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                rows = [convert_record(*r) for n, r in enumerate(read_arc(file.as_py())) if n]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return files.select("content").mapInArrow(run, RECORD)


def pages_to_arc(pages: DataFrame) -> DataFrame:
    """pages (page_id, url, html) -> ARC files (content binary) of both versions by turns."""

    @in_worker("warc")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str | None, bytes]] = []
        size = n = 0
        for batch in batches:
            for page_id, url, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                held.append((page_id, url, payload))
                size += len(payload)
                if size >= ARC_BYTES or len(held) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array([write_arc(f"pages-{n}.arc", 1 + n % 2, held)], pa.binary())], ["content"])
                    held, size, n = [], 0, n + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([write_arc(f"pages-{n}.arc", 1 + n % 2, held)], pa.binary())], ["content"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "content binary")


def originals(payloads: DataFrame) -> DataFrame:
    """payloads (page_id, payload_bytes, payload_digest) -> payload_digest, original: the largest page_id of each payload that repeats."""
    large = payloads.filter((F.col("payload_bytes") >= LEAST) & F.col("page_id").isNotNull())
    return large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.max("page_id").alias("original")).filter("n > 1").drop("n")


def with_revisits(records: DataFrame, first: DataFrame) -> DataFrame:
    """records with refers_to: the page_id of the response that stands for the payload, null where the record is that itself.

    Where the originals take few bytes they are broadcast, and payloads stay where they are; beyond that
    records are dealt by digest, small ones, which need no original, by their place.
    """
    few = first.count() * ORIGINAL_BYTES <= BROADCAST_BYTES
    key = F.when(F.col("payload_bytes") >= LEAST, F.col("payload_digest")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id", "uri").cast("string")))
    first = first.withColumnRenamed("payload_digest", "_key")
    joined = records.withColumn("_key", key).join(F.broadcast(first) if few else first, "_key", "left").drop("_key")
    return joined.withColumn("refers_to", F.when((F.col("payload_bytes") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("original")), F.col("original"))).drop("original")


def page_urn(page_id: Column) -> Column:
    """A custom (version 8) UUID that holds the page id."""
    h = F.lpad(F.lower(F.hex(page_id)), 16, "0")
    return F.concat(F.lit("urn:uuid:"), F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-8000-8000-"), F.substring(h, 13, 4), F.lit("00000000"))


def page_of_urn(urn: str) -> int | None:
    found = re.search(r"urn:uuid:([0-9a-f]{8})-([0-9a-f]{4})-8000-8000-([0-9a-f]{4})00000000", urn)
    value = int("".join(found.groups()), 16) if found else None
    return value - (1 << 64) if value is not None and value >> 63 else value


def _record() -> Column:
    """A WARC record up to the last line end of its terminator."""
    eol = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    d = F.sha1(F.concat("uri", "date", "payload_digest"))
    other = F.concat(F.lit("urn:uuid:"), F.substring(d, 1, 8), F.lit("-"), F.substring(d, 9, 4), F.lit("-5"), F.substring(d, 14, 3), F.lit("-a"), F.substring(d, 18, 3), F.lit("-"), F.substring(d, 21, 12))
    block = F.when(revisit, F.col("head")).otherwise(F.concat("head", "payload"))
    headers = [
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.col("kind"))),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.coalesce(page_urn(F.col("page_id")), other), F.lit(">"))),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", F.col("uri")),
        ("WARC-IP-Address", F.col("ip")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        ("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.when(revisit, F.sha1("head")).otherwise(F.col("block_digest")))),
        ("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        ("WARC-Refers-To", F.when(revisit, F.concat(F.lit("<"), page_urn(F.col("refers_to")), F.lit(">")))),
        ("X-Payload-Length", F.col("payload_bytes").cast("string")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.octet_length(block).cast("string")),
    ]
    lines = [F.coalesce(F.concat(F.lit(f"{name}: "), value, eol), F.lit("")) for name, value in headers]
    return F.concat(F.concat(F.lit("WARC/1.1\r\n"), *lines, eol).cast("binary"), block, eol.cast("binary")).cast("string")


def write_warc(records: DataFrame, path: str, mean_bytes: float) -> None:
    """records (RECORD and refers_to), whose payloads have `mean_bytes` on average, as gzip-compressed WARC files of about WARC_BYTES under path."""
    most = max(1, int(WARC_BYTES / (mean_bytes + HEADER_BYTES)))
    records.select(_record().alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", most).text(path)


def _parse(stream: io.BufferedReader) -> Iterator[tuple]:
    while line := stream.readline():
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        headers: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            name, _, value = line.decode("utf-8", "surrogateescape").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers["content-length"])
        block = stream.read(size)
        if len(block) < size:
            raise ValueError("a WARC record breaks off")
        kind, digest = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:")
        head, payload = b"", block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            head += b"\r\n"
        if kind != "revisit":
            found = hashlib.sha1(payload).hexdigest()
            if digest and digest != found:
                raise ValueError(f"the payload of {headers.get('warc-record-id')} doesn't match its digest")
            digest = found
        page = re.search(rb"(?mi)^X-Page-Id: (-?\d+)\r$", head)
        length = int(headers["x-payload-length"]) if kind == "revisit" else len(payload)
        yield int(page[1]) if page else None, length, digest, kind, page_of_urn(headers.get("warc-refers-to", ""))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """WARC files under path -> page_id, payload_bytes, payload_digest, record_type, refers_to, one row a record."""
    names, kinds = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"], [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    @in_worker("warc")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0):
                raw = io.BytesIO(file.as_py())
                stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if raw.getbuffer()[:2] == b"\x1f\x8b" else io.BufferedReader(raw)
                rows = list(_parse(stream))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(pages: DataFrame, path: str) -> None:
    """pages (page_id, url, html) through ARC files into WARC files with revisits under path."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    payloads = pages.select(F.col("page_id").cast("long").alias("page_id"), F.octet_length(html).alias("payload_bytes"), F.sha1(html).alias("payload_digest"))
    first = materialise(originals(payloads), "originals")
    mean = pages.agg(F.avg(F.octet_length(html))).first()[0] or 0.0
    write_warc(with_revisits(convert_arc(pages_to_arc(pages)), first), path, mean)
    drop(first)

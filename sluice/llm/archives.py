"""Legacy ARC archives, their conversion to WARC, and WARC archives read back.

An ARC record is a header line and as many bytes as it declares. Version 1 has five fields (URL, address, date, type,
length); version 2 has ten (with result code, checksum, location, offset and file name before the length). Conversion
makes the identifiers, dates, types and digests that WARC asks for; a payload seen before becomes a revisit.

An archive is one gzip file of ARCHIVE_BYTES inflated, or of one record if that is larger; it is inflated record by
record. A WARC record's identifier names the archive and the place that it came from, so that equal records differ.

Inputs and edge cases: a null html is an empty payload, a null url gets a urn of the page; white space in a URL is
percent-escaped; of equal payloads, empty ones included, exactly one record is the response (that with the smallest
page_id, of repeated rows and of null ids the first in the archives; a null page_id never wins over another) and the
others are revisits; payloads may hold any bytes, also what looks like a header. A record whose declared length runs
beyond its archive is an error. An empty table gives archives without records. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.sources.scratch import Scratch

#: Fields of a header line by ARC version.
ARC_FIELDS = {1: 5, 2: 10}
#: Bytes of records, before compression, at which an archive ends.
ARCHIVE_BYTES = 16 << 20
#: The archive date of pages that have none, and the fixed name space of the identifiers made here.
DATE = "20240101000000"
_NAMES = uuid.UUID("9b1c6a52-3f0e-5d57-8a55-2f6f1d2f7c11")
_REVISIT = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_PAGE = b"X-Page-Id: "


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class _Parts:
    """Gathers records, each ending in a newline, into archives; every archive begins with what `begin` makes."""

    def __init__(self, begin: Callable[[bytes], bytes], most: int):
        self.begin, self.most, self.records, self.size = begin, most, [], 0

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.records and self.size + len(record) > self.most:
            yield from self.end()
        if not self.records:
            self.records, self.size = [self.begin(record)], 0
        self.records.append(record)
        self.size += len(record)

    def end(self) -> Iterator[pa.RecordBatch]:
        if self.records:  # the writer adds the last newline
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(self.records)[:-1]], pa.binary())], ["archive"])
        self.records = []


def _write(archives: DataFrame, path: str) -> None:
    """A gzip file for each row."""
    archives.select(F.col("archive").cast("string")).write.option("maxRecordsPerFile", 1).option("zlib.compress.level", "BEST_SPEED").text(path, compression="gzip")


def _archives(spark: SparkSession, path: str) -> DataFrame:
    """name, content of the archives in a folder."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")


def _opened(content: pa.Scalar) -> io.BufferedReader:
    return io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(content.as_buffer())), 1 << 16)


def write_arc(pages: DataFrame, path: str, version: int = 1, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """One ARC record for each page: its HTTP answer, which names the page_id. An archive begins with a version block."""
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html"))
    about = f"{version} 0 sluice\nURL IP-address Archive-date Content-type Archive-length\n".encode()
    begin = _arc_line(version, b"filedesc://pages.arc", b"text/plain", len(about)) + about + b"\n"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(lambda _: begin, archive_bytes)
        for b in batches:
            for page, url, html in zip(b["page_id"], b["url"], b["html"]):
                page, url, html = page.as_py(), url.as_py(), html.as_py()
                url = f"urn:page:{page}" if not url else "%20".join(url.split()) or f"urn:page:{page}"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"" if page is None else _PAGE + b"%d\r\n" % page) + b"Content-Length: %d\r\n\r\n" % len(html)
                yield from parts.add(b"".join((_arc_line(version, url.encode(), b"text/html", len(head) + len(html)), head, html, b"\n")))
        yield from parts.end()

    _write(pages.mapInArrow(run, "archive binary"), path)


def _arc_line(version: int, url: bytes, kind: bytes, length: int) -> bytes:
    more = [b"200", b"-", b"-", b"0", b"pages.arc"] if version == 2 else []
    return b" ".join([url, b"0.0.0.0", DATE.encode(), kind, *more, b"%d" % length]) + b"\n"


def parse_arc(archive: io.BufferedIOBase) -> Iterator[dict]:
    """The records of an ARC archive, one at a time. Its version block, which comes first, tells how many fields a
    header line has."""
    fields = 0
    while line := archive.readline():
        if not (line := line.strip(b"\r\n")):
            continue
        first = line.startswith(b"filedesc://")
        if not first and not fields:
            raise ValueError("the ARC archive does not begin with a version block")
        length = int(line.rsplit(b" ", 1)[1])
        block = archive.read(length)
        if len(block) < length:
            raise ValueError(f"ARC record {line.split(b' ', 1)[0]!r} declares {length} bytes, beyond the end of its archive")
        if first:
            fields = ARC_FIELDS[int(block.split(b" ", 1)[0])]
        url, address, date, kind, *more, _ = line.rsplit(b" ", fields - 1)
        yield {"url": url.decode(errors="replace"), "address": address.decode(), "date": date.decode(), "kind": kind.decode(), "status": more[0].decode() if more else None, "block": block}


def _http(block: bytes) -> tuple[bytes, bytes, int | None]:
    """Header, payload and the page's id of an HTTP answer; a block that is none is all payload."""
    if not block.startswith(b"HTTP/") or (end := block.find(b"\r\n\r\n")) < 0:
        return b"", block, None
    head = block[: end + 4]
    at = head.find(_PAGE)
    return head, block[end + 4 :], None if at < 0 else int(head[at + len(_PAGE) :].split(b"\r", 1)[0])


def _warc_fields(r: dict, name: str, place: int) -> dict:
    """What a WARC header needs of an ARC record, with its HTTP header and payload."""
    head, payload, page = _http(r["block"])
    d, sha = r["date"], digest(payload)
    return {
        "archive": name, "place": place, "page_id": page, "uri": r["url"], "date": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z", "address": r["address"],
        "warc_type": "response" if head else "metadata" if r["url"].startswith("dns:") else "resource",
        "record_id": uuid.uuid5(_NAMES, f"{name} {place} {r['url']} {d} {sha}").urn, "head": head, "payload": payload, "payload_bytes": len(payload), "payload_digest": sha,
    }


def _numbered(content: pa.Scalar) -> Iterator[tuple[int, dict]]:
    """The records of an ARC archive but for its version block, which becomes the warcinfo record of each WARC archive."""
    return enumerate(r for r in parse_arc(_opened(content)) if not r["url"].startswith("filedesc://"))


_ARC = "archive string, place bigint, page_id bigint, uri string, date string, address string, warc_type string, record_id string, head binary, payload binary, payload_bytes bigint, payload_digest string"
_TYPES = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}


def _batches(rows: Iterator[dict], columns: str) -> Iterator[pa.RecordBatch]:
    """Record batches of at most 2000 rows, or as many as have 4 MB of payload."""
    schema = pa.schema([(x.split()[0], _TYPES[x.split()[1]]) for x in columns.split(", ")])
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r.get("payload") or b"")
        if len(held) == 2000 or size > 4 << 20:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def read_arc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the ARC archives in a folder, with the WARC fields made of each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for name, content in zip(b["name"].to_pylist(), b["content"]):
                for place, r in _numbered(content):
                    found = _warc_fields(r, name, place)
                    yield found if payloads else found | {"payload": None, "head": None}

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), _ARC), _ARC)


def convert(spark: SparkSession, arc: str, warc: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """ARC archives as WARC 1.0 archives: of records with equal payloads of min_bytes or more, the one with the smallest
    page_id is a response and the others are revisits of it, without payload.

    The archives are read twice: for the digests alone, from which the revisits follow, and to be converted. Payloads
    are not shuffled; an archive meets the list of its own revisits.
    """
    scratch = Scratch(spark, "convert")
    key = ["payload_digest", "payload_bytes"]
    records = scratch.save(read_arc(spark, arc, payloads=False).where(F.col("payload_bytes") >= min_bytes).select("archive", "place", "page_id", "record_id", *key), "digests")
    order = F.struct(F.col("page_id").isNull().alias("nameless"), "page_id", "archive", "place", "record_id")
    first = records.groupBy(*key).agg(F.min(order).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    again = records.join(first, key).where("record_id <> first.record_id").select("archive", F.struct("place", F.col("first.record_id").alias("of_record"), F.col("first.page_id").alias("of_page")).alias("r"))
    again = again.groupBy("archive").agg(F.collect_list("r").alias("revisits"))  # at most the records of one archive
    found = _archives(spark, arc).join(again.withColumnRenamed("archive", "name"), "name", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = _Parts(_warcinfo, archive_bytes)
        for b in batches:
            for name, content, revisits in zip(b["name"].to_pylist(), b["content"], b["revisits"].to_pylist()):
                of = {x["place"]: x for x in revisits or ()}
                for place, r in _numbered(content):
                    yield from parts.add(_warc_record(_warc_fields(r, name, place), r["block"], of.get(place)))
        yield from parts.end()

    _write(found.mapInArrow(run, "archive binary"), warc)
    scratch.drop(records)


def _warcinfo(record: bytes) -> bytes:
    """The first record of an archive, named after the one that it stands before."""
    info = b"software: sluice\r\nformat: WARC File Format 1.0\r\n"
    name = uuid.uuid5(_NAMES, "info " + hashlib.sha1(record).hexdigest()).urn
    return _warc({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<{name}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, info)


def _warc_record(r: dict, block: bytes, revisit: dict | None) -> bytes:
    fields = {
        "WARC-Type": "revisit" if revisit else r["warc_type"], "WARC-Record-ID": f"<{r['record_id']}>", "WARC-Date": r["date"], "WARC-Target-URI": r["uri"], "WARC-IP-Address": r["address"],
        "Content-Type": "application/http; msgtype=response" if r["head"] else "application/octet-stream", "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
    }
    if revisit:
        block = r["head"]
        fields |= {"WARC-Profile": _REVISIT, "WARC-Refers-To": f"<{revisit['of_record']}>", "X-Payload-Length": r["payload_bytes"]}
        fields |= {} if revisit["of_page"] is None else {"X-Refers-To-Page": revisit["of_page"]}
    return _warc(fields | {"WARC-Block-Digest": f"sha1:{digest(block)}"}, block)


def _warc(fields: dict, block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def parse_warc(archive: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """The header fields and the block of each record, one at a time."""
    while line := archive.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/1."):
            raise ValueError(f"{line[:40]!r} stands where a WARC record should begin")
        fields = {}
        while line := archive.readline().strip(b"\r\n"):
            name, _, value = line.decode(errors="replace").partition(": ")
            fields[name] = value
        length = int(fields["Content-Length"])
        block = archive.read(length)
        if len(block) < length:
            raise ValueError(f"WARC record {fields.get('WARC-Record-ID')} declares more bytes than its archive has")
        yield fields, block


_READ = "page_id bigint, uri string, record_id string, record_type string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_record string"


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives in a folder, warcinfo left out. A stored payload is held against its digest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for b in batches:
            for content in b["content"]:
                for f, block in parse_warc(_opened(content)):
                    if f["WARC-Type"] == "warcinfo":
                        continue
                    _, payload, page = _http(block)
                    sha, again = f["WARC-Payload-Digest"].removeprefix("sha1:"), f["WARC-Type"] == "revisit"
                    if not again and digest(payload) != sha:
                        raise ValueError(f"WARC record {f['WARC-Record-ID']}: the payload does not match its digest")
                    yield {
                        "page_id": page, "uri": f["WARC-Target-URI"], "record_id": f["WARC-Record-ID"][1:-1], "record_type": f["WARC-Type"], "payload": payload if payloads and not again else None,
                        "payload_bytes": int(f["X-Payload-Length"]) if again else len(payload), "payload_digest": sha,
                        "refers_to": int(f["X-Refers-To-Page"]) if "X-Refers-To-Page" in f else None, "refers_to_record": f["WARC-Refers-To"][1:-1] if again else None,
                    }

    return _archives(spark, path).mapInArrow(lambda batches: _batches(rows(batches), _READ), _READ)


def op2_warc_convert(spark, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op2")
    write_arc(spark.read.parquet(f"{sf_dir}/pages.parquet"), f"{scratch.root}/arc", version=2)
    convert(spark, f"{scratch.root}/arc", f"{scratch.root}/warc")
    return read_warc(spark, f"{scratch.root}/warc", payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_CHARS = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
QUERIES = {"op2_warc_convert": op2_warc_convert}
SQL = {"op2_warc_convert": f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT h, i, ('0x' || substr(h, 5 * i + 1, 5))::INTEGER AS v FROM (SELECT DISTINCT h FROM p), range(8) AS t(i)),
b AS (SELECT h, string_agg({_CHARS}, '' ORDER BY i) AS payload_digest FROM g GROUP BY h),
m AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first, row_number() OVER (PARTITION BY h ORDER BY page_id NULLS LAST) AS r FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN r = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN r > 1 THEN first END AS refers_to FROM m JOIN b ON m.h = b.h"""}

r"""Legacy ARC archives to WARC.

ARC files hold records of a header line and a body of the declared length; the version block at a file's start (``filedesc://``) says which header fields
follow: five in version 1, ten in version 2. The converter reads records by their lengths, never by searching for marks, and gives each its WARC
counterpart: identifier (from the record itself, so that a retry gives the same), timestamp, type and digests. Of captures with equal payloads of
``REVISIT`` bytes or more, that with the largest page id is the response, the others revisit it and leave out the payload. Records are handled as bytes in
any encoding. A body that is no HTTP message (DNS answers, old protocols) is payload as a whole and becomes a ``resource`` of its content type. The head of a
message ends at its first empty line, of either kind of line end; without one all of it is head. Header URLs may hold blanks and bytes that are no UTF-8: both are
percent-encoded. Dates that lack parts get the first month, day or hour. An ``X-Page-Id`` that is missing or no 64-bit integer: null page id.

Archives are written by Spark's text writer as gzip files, in the folder that executors share, and read whole by tasks that decompress them as a stream, so a
task holds one file of about an input split. No pages: no records. Null URL: ``-``; white space in URLs is percent-encoded. Null html: an empty payload. Null page id: below all
ids. Repeated rows of the id that is the response: the same record again. Extra columns are left out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import new_path, small_batches, stored
from .words import slices

REVISIT = 1000
#: Fixed values of the formats.
FIELDS = {1: ("url", "ip", "date", "type", "length"), 2: ("url", "ip", "date", "type", "code", "checksum", "location", "offset", "filename", "length")}
TITLES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_BLANKS = {**{c: f"%{c:02X}" for c in range(33)}, 127: "%7F", **{ord(c): "".join(f"%{b:02X}" for b in c.encode()) for c in "\x85\xa0  "}}
#: Level 3 takes about half the time of the default and a few per cent more space.
GZIP = {"compression": "gzip", "zlib.compress.level": "THREE", "lineSep": "\n"}
_SECTION = 1 << 24  # bytes after which a new version block begins
#: Fields around the URL, which may hold blanks: address and date are known by their form, the rest is counted from the right.
_HEADERS = {v: re.compile(rb"(.+?) ([0-9A-Fa-f.:]*[.:][0-9A-Fa-f.:]*|-) (\d{4,17}) (.+)" + rb" (\S+)" * (len(f) - 4)) for v, f in FIELDS.items()}
_HEAD_END = re.compile(rb"\r?\n\r?\n")
_MESSAGE = "application/http; msgtype=response"
_RECORD = "page_id long, url string, date string, kind string, http binary, payload binary, digest string, record_id string"


def http_head(page_id: int | None, payload: bytes) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode()


def arc_version_block(version: int, date: str) -> bytes:
    body = f"{version} 0 export\n{TITLES[version]}\n\n".encode()
    rest = f"{len(body)}" if version == 1 else f"200 - - 0 export.arc {len(body)}"
    return f"filedesc://export.arc 0.0.0.0 {date} text/plain {rest}\n".encode() + body


def arc_record(version: int, url: str, date: str, block: bytes) -> bytes:
    extra = "" if version == 1 else "200 - - 0 export.arc "
    return f"{url} 0.0.0.0 {date} text/html {extra}{len(block)}\n".encode() + block


def write_arc(pages: DataFrame, path: str, date: str = "20240101000000", key: str = "page_id", url: str = "url", html: str = "html") -> None:
    """pages as ARC files, tasks of even number in version 1, others in version 2."""

    def run(batches):
        version, size = 1 + TaskContext.get().partitionId() % 2, _SECTION
        for batch in slices(batches, "html"):
            rows = []
            for i, u, h in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html"))):
                if size >= _SECTION:
                    rows.append(arc_version_block(version, date))
                    size = 0
                payload = (h or "").encode()
                record = arc_record(version, (u or "-").translate(_BLANKS) or "-", date, http_head(i, payload) + payload)
                size += len(record)
                rows.append(record)
            yield pa.record_batch([pa.array(rows, pa.binary())], names=["value"])

    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")).mapInArrow(run, "value binary")
    _as_text(rows).write.options(**GZIP).text(path)


def _address(raw: bytes) -> str:
    """A URL in UTF-8; white space is percent-encoded, and where the bytes are no UTF-8 all beyond ASCII."""
    try:
        return raw.decode().translate(_BLANKS)
    except UnicodeDecodeError:
        return "".join(chr(b) if b < 128 else f"%{b:02X}" for b in raw).translate(_BLANKS)


def _fields(line: bytes, version: int) -> dict:
    found = _HEADERS[version].fullmatch(line)
    values = found.groups() if found else line.rsplit(b" ", len(FIELDS[version]) - 1)
    if len(values) != len(FIELDS[version]):
        raise ValueError(f"{len(values)} header fields, expected {len(FIELDS[version])}")
    return {f: _address(v) if f == "url" else v.decode("latin-1") for f, v in zip(FIELDS[version], values)}


def split_message(block: bytes) -> tuple[bytes, bytes]:
    """Head of an HTTP message, empty line included, and payload; together they are the block."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = _HEAD_END.search(block)
    return (block[: end.end()], block[end.end() :]) if end else (block, b"")


def _page_id(head: bytes) -> int | None:
    for line in head.split(b"\n"):
        name, _, value = line.partition(b":")
        if name.strip().lower() == b"x-page-id" and re.fullmatch(rb"-?\d{1,19}", value.strip()):
            return int(value) if -(1 << 63) <= int(value) < 1 << 63 else None
    return None


def parse_arc(stream: BinaryIO) -> Iterator[dict]:
    """Records with the fields of their version and ``block``; line ends between records are skipped."""
    version = 1
    while line := stream.readline():
        line = line.rstrip(b"\r\n")
        if not line:
            continue
        if line.startswith(b"filedesc://"):
            body = stream.read(int(line.rsplit(b" ", 1)[1]))
            version = int(body.split(b" ", 1)[0])
            continue
        record = _fields(line, version)
        record["block"] = stream.read(int(record["length"]))
        if len(record["block"]) != int(record["length"]):
            raise ValueError("record shorter than declared")
        yield record


def _opened(content: bytes) -> BinaryIO:
    return gzip.open(io.BytesIO(content)) if content[:2] == b"\x1f\x8b" else io.BytesIO(content)


def _batches(rows: Iterator[tuple], names: list[str], kinds: list, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Rows in record batches of about ``most`` bytes."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, (bytes, str))) + 64
        if size >= most:
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names=names)


def _files(spark, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("content")


def read_arc(spark, path: str, narrow: bool = False) -> DataFrame:
    """Captures: page_id, url, date, kind (content type of the block), http (head), payload (zlib), digest (SHA-1, base 32), record_id. narrow: page_id, digest, size, record_id."""

    def captures(batches):
        for batch in batches:
            for content in batch["content"]:
                for r in parse_arc(_opened(content.as_py())):
                    head, payload = split_message(r["block"])
                    page = _page_id(head)
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    ident = str(uuid.uuid5(uuid.NAMESPACE_URL, f"{'' if page is None else page} {r['url']} {r['date']} {digest}"))
                    yield (page, digest, len(payload), ident) if narrow else (page, r["url"], r["date"], _MESSAGE if head else r["type"], head, zlib.compress(payload, 1), digest, ident)

    if narrow:
        names, kinds, shape = ["page_id", "digest", "size", "record_id"], [pa.int64(), pa.string(), pa.int64(), pa.string()], "page_id long, digest string, size long, record_id string"
    else:
        names, kinds, shape = ["page_id", "url", "date", "kind", "http", "payload", "digest", "record_id"], [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), pa.string(), pa.string()], _RECORD
    return _files(spark, path).mapInArrow(lambda batches: _batches(captures(batches), names, kinds), shape)


def warc_record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *fields, ("Content-Length", str(len(block)))])
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _warc_date(date: str) -> str:
    d = date[:14] + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _as_text(blocks: DataFrame) -> DataFrame:
    """Bytes as they are for Spark's text writer, which copies them."""
    return blocks.select(F.col("value").cast("string"))


def arc_to_warc(spark, source: str, target: str) -> None:
    """Converts the ARC files of a folder. Which captures revisit which is settled on digests alone and joined by record, so bodies move once, compressed, and evenly."""
    digests = stored(read_arc(spark, source, narrow=True), "captures").where(F.col("size") >= REVISIT).withColumn("page", F.coalesce("page_id", F.lit(-(1 << 63))))
    keepers = (digests.groupBy("digest").agg(F.max(F.struct("page", "record_id")).alias("x"), F.count("*").alias("n")).where("n > 1")
               .select("digest", F.col("x.page").alias("keeper"), F.col("x.record_id").alias("refers_to")))
    marks = digests.join(keepers, "digest").where("page <> keeper").select("record_id", "refers_to").distinct()
    rows = read_arc(spark, source).join(marks, "record_id", "left")

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                again = r["refers_to"] is not None
                block = r["http"] if again else r["http"] + zlib.decompress(r["payload"])
                fields = [("WARC-Record-ID", f"<urn:uuid:{r['record_id']}>"), ("WARC-Date", _warc_date(r["date"])), ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", f"sha1:{r['digest']}"),
                          ("WARC-Block-Digest", "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()), ("Content-Type", r["kind"])]
                if again:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:uuid:{r['refers_to']}>")]
                kind = "revisit" if again else "response" if r["http"] else "resource"
                out.append(warc_record(kind, fields, block)[:-1])  # the writer adds the last line end
            yield pa.record_batch([pa.array(out, pa.binary())], names=["value"])

    _as_text(rows.mapInArrow(run, "value binary")).write.options(**GZIP).text(target)


def parse_warc(stream: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record, by Content-Length."""
    while line := stream.readline():
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8", "replace").partition(":")
            headers[k] = v.strip()
        block = stream.read(int(headers["Content-Length"]))
        if len(block) != int(headers["Content-Length"]):
            raise ValueError("record shorter than declared")
        yield headers, block


def read_warc(spark, path: str) -> DataFrame:
    """page_id, record_id, record_type, payload_bytes (null: revisits), payload_digest (hex), target (record id that a revisit refers to). Digests of blocks and payloads are checked."""
    names = ["page_id", "record_id", "record_type", "payload_bytes", "payload_digest", "target"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def records(batches):
        for batch in batches:
            for content in batch["content"]:
                for h, block in parse_warc(_opened(content.as_py())):
                    head, payload = split_message(block)
                    again = h["WARC-Type"] == "revisit"
                    digest = base64.b32decode(h["WARC-Payload-Digest"][5:])
                    if base64.b32decode(h["WARC-Block-Digest"][5:]) != hashlib.sha1(block).digest() or not again and digest != hashlib.sha1(payload).digest():
                        raise ValueError(f"digest of {h['WARC-Record-ID']} differs")
                    yield _page_id(head), h["WARC-Record-ID"], h["WARC-Type"], None if again else len(payload), digest.hex(), h.get("WARC-Refers-To")

    return _files(spark, path).mapInArrow(lambda batches: _batches(records(batches), names, kinds), "page_id long, record_id string, record_type string, payload_bytes long, payload_digest string, target string")


def archive(pages: DataFrame) -> DataFrame:
    """pages through ARC and WARC files and back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    small_batches(spark)
    arc, warc = new_path(spark, "arc"), new_path(spark, "warc")
    write_arc(pages, arc)
    arc_to_warc(spark, arc, warc)
    records = stored(read_warc(spark, warc), "records")
    responses = records.where("target IS NULL").select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes").distinct()
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    alone = records.where("target IS NULL").withColumn("refers_to", F.lit(None).cast("long")).select(*columns)
    return alone.unionByName(records.where("target IS NOT NULL").drop("payload_bytes").join(responses, "target", "left").select(*columns))

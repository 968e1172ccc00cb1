"""WARC archives written by Spark, and a reader that salvages damaged ones (operator 11).

Writing. A page becomes a ``response`` record: an HTTP head and the html in UTF-8 as payload, with
SHA-1 digests of block and payload. Of pages with equal payloads (by length and SHA-256) the one with
the largest id is the response; the others are ``revisit`` records, which keep the HTTP head but not
the payload. Each record is a gzip member of its own (or plain text). Spark's text writer puts the
records, byte by byte, into files of about ``archive_bytes``, in whatever store the path is in. It
ends each row by a separator, so a row lacks its record's last byte: that of a member is 0 (a size
under 16 MB; larger records are followed by an empty member), that of a plain record a line feed.

Reading. Each archive is read as one row and checked from its start: a member by its CRC and size, a
record by its version line, fields, length, end mark and digests. After a check that fails, the reader
looks for the next byte that starts a member or a version line and passes all checks; everything
before it is one quarantined gap (start, end, reason), and reading goes on. A version line inside the
payload of a sound record is never looked at.

Shuffles: pages meet by digest, aggregated in each task first, so a payload with a third of all
rows is one row per task. Only groups of two or more are joined back, by a broadcast when they are few
(counted), else by a shuffle whose skew Spark splits.

Defined cases: a NULL html is empty, and empty payloads are equal like any other; a NULL url is left
out; a NULL id never owns a payload that another page has an id for, and if all ids of a payload are
NULL all its pages are responses; pages that share the largest id are all responses; equal rows are
records of their own; no rows, no archives; extra columns are ignored. A record over 2 GB can't be
written, as no Spark row can hold it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from clickweave.llm.common import bounded, written

ARCHIVE_BYTES = 32 << 20
_START = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r\n")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_HEAD_BYTES = 1 << 16
_EMPTY_MEMBER = zlib.compressobj(wbits=31).flush()
#: Fields that every record has: fixed values of the format.
_MANDATORY = {"warc-type", "warc-record-id", "warc-date", "content-length"}
#: The profile of a revisit whose payload is equal to another record's: a fixed value of the format.
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class Damage(ValueError):
    """A check that failed."""


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_record(page_id: int | None, url: str | None, html: bytes, owner: int | None, date: str) -> bytes:
    """A page as a plain record; with ``owner`` a revisit of that page's record."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(html)
    block = http if owner is not None else http + html
    fields = [("WARC-Type", "response" if owner is None else "revisit"), ("WARC-Record-ID", _urn(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    if owner is not None:
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", _urn(owner))]
    fields += [("WARC-Payload-Digest", "sha1:" + digest(html)), ("WARC-Block-Digest", "sha1:" + digest(block)),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def member(record: bytes, level: int = 6) -> bytes:
    """A record as a gzip member whose last byte is 0."""
    packer = zlib.compressobj(level, wbits=31)
    packed = packer.compress(record) + packer.flush()
    return packed if packed[-1] == 0 else packed + _EMPTY_MEMBER


def _rows(batches: Iterable[pa.RecordBatch], compressed: bool, torn_every: int, archive_bytes: int, date: str) -> Iterator[pa.RecordBatch]:
    stored, seen = 0, 0
    for batch in batches:
        parts, records, waiting = [], [], 0
        for page_id, url, html, owner in zip(*batch.columns):
            record = page_record(page_id.as_py(), url.as_py(), html.as_buffer().to_pybytes(), owner.as_py(), date)
            data = member(record) if compressed else record
            seen += 1
            if torn_every and seen % torn_every == 0:
                data = data[:len(data) // 2] + data
            parts.append(stored // archive_bytes)
            records.append(data[:-1])
            stored, waiting = stored + len(data), waiting + len(data)
            if waiting > 8 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(records, pa.binary()).view(pa.string())], names=["part", "value"])
                parts, records, waiting = [], [], 0
        if parts:
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array(records, pa.binary()).view(pa.string())], names=["part", "value"])


def with_owners(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html as bytes, and the page (``owner``) that a page revisits; NULL for responses."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("key", F.concat(F.sha2("html", 256), F.lit(" "), F.octet_length("html").cast("string")))
    owners = written(rows.where(F.octet_length("html") >= least_bytes).groupBy("key").agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n"))
                     .where("n > 1 and largest is not null").select("key", "largest"), "warc-owners")
    found = rows.join(bounded(owners), "key", "left")
    revisit = F.col("largest").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("largest"))
    return found.select("page_id", "url", "html", F.when(revisit, F.col("largest")).alias("owner"))


def write_archives(pages: DataFrame, path: str, compressed: bool = True, least_bytes: int = 0, torn_every: int = 0,
                   archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z") -> None:
    """Archives of all pages under ``path``. With ``torn_every`` = n, every n-th record of a task stands
    behind the first half of itself, as where a crawler was stopped and wrote the record again."""
    rows = with_owners(pages, least_bytes).mapInArrow(lambda b: _rows(b, compressed, torn_every, archive_bytes, date), "part int, value string")
    rows.write.partitionBy("part").option("lineSep", "\x00" if compressed else "\n").option("compression", "none").text(path)


# -- reading --------------------------------------------------------------------------------

def _member(data: bytes, at: int) -> tuple[bytes, int]:
    """What a gzip member holds, and where it ends."""
    unpacker, out, pos, view = zlib.decompressobj(wbits=31), [], at, memoryview(data)
    try:
        while not unpacker.eof:
            if pos >= len(data):
                raise Damage("member cut short")
            chunk = view[pos:pos + (1 << 16)]
            out.append(unpacker.decompress(chunk))
            pos += len(chunk)
    except zlib.error:
        raise Damage("member fails its checks") from None
    return b"".join(out), pos - len(unpacker.unused_data)


def _record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Fields and block of the record at a place, and where it ends."""
    if not _VERSION.match(data, at):
        raise Damage("no version line")
    end = data.find(b"\r\n\r\n", at, at + _HEAD_BYTES)
    if end < 0:
        raise Damage("fields without an end")
    fields = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damage("a field without a name")
        key = name.decode("utf-8", "replace").lower()
        if key in fields and key != "warc-concurrent-to":  # as where a torn head runs into the next record's
            raise Damage("a field twice")
        fields[key] = value.strip().decode("utf-8", "replace")
    if not _MANDATORY <= fields.keys():
        raise Damage("a mandatory field is missing")
    length = fields["content-length"]
    if not re.fullmatch("[0-9]{1,12}", length):
        raise Damage("no length")
    start, past = end + 4, end + 4 + int(length)
    if data[past:past + 4] != b"\r\n\r\n":
        raise Damage("no end mark where the length says")
    block = data[start:past]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + digest(block):
        raise Damage("block digest differs")
    return fields, block, past + 4


def payload_of(fields: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """The payload (None for a revisit) and the length of the full payload."""
    if not fields.get("content-type", "").startswith("application/http"):
        return block, len(block)
    head, end, body = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", head)
    if not end or not said:
        raise Damage("no HTTP head")
    if fields.get("warc-type") == "revisit":
        return None, int(said[1])
    if len(body) != int(said[1]) or fields.get("warc-payload-digest", "sha1:" + digest(body)) != "sha1:" + digest(body):
        raise Damage("payload digest or length differs")
    return body, len(body)


def salvage(data: bytes) -> Iterator[tuple]:
    """The sound records (start, end, fields, payload, payload bytes) and the gaps (start, end, reason)
    of an archive, in order."""
    at, bad = 0, None
    while at < len(data):
        try:
            found = []
            if data.startswith(b"\x1f\x8b", at):
                raw, end = _member(data, at)
                pos = 0
                while pos < len(raw):
                    fields, block, pos = _record(raw, pos)
                    found.append((fields, *payload_of(fields, block)))
            else:
                fields, block, end = _record(data, at)
                found.append((fields, *payload_of(fields, block)))
        except Damage as e:
            bad = bad or (at, str(e))
            start = _START.search(data, at + 1)
            at = start.start() if start else len(data)
            continue
        if bad:
            yield bad[0], at, bad[1]
            bad = None
        for fields, payload, n in found:
            yield at, end, fields, payload, n
        at = end
    if bad:
        yield bad[0], len(data), bad[1]


_READ = T.StructType([T.StructField(n, t) for n, t in (
    ("archive", T.StringType()), ("start", T.LongType()), ("end", T.LongType()), ("gap_reason", T.StringType()), ("record_type", T.StringType()),
    ("record_id", T.StringType()), ("target_uri", T.StringType()), ("refers_to", T.StringType()), ("payload_digest", T.StringType()),
    ("payload_bytes", T.LongType()), ("payload", T.BinaryType()))])
_ARROW = pa.schema([(f.name, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[f.dataType.simpleString()]) for f in _READ.fields])


def _salvaged(batches: Iterable[pa.RecordBatch], payloads: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(*batch.columns):
            rows, size = [], 0
            for x in salvage(content.as_buffer().to_pybytes()):
                if len(x) == 3:
                    rows.append((path.as_py(), *x, *[None] * 7))
                else:
                    start, end, f, payload, n = x
                    kept = payload if payloads else None
                    size += len(kept or b"")
                    rows.append((path.as_py(), start, end, None, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), f.get("warc-refers-to"),
                                 f.get("warc-payload-digest", "").removeprefix("sha1:") or None, n, kept))
                if size > 8 << 20 or len(rows) >= 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW.types)], schema=_ARROW)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives under ``path``; a gap has a ``gap_reason`` and no fields."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInArrow(lambda b: _salvaged(b, payloads), _READ)


def quarantined(read: DataFrame) -> DataFrame:
    """The log of byte gaps."""
    return read.where("gap_reason is not null").select("archive", "start", "end", F.col("gap_reason").alias("reason"))


def _page(urn: str) -> F.Column:
    return F.regexp_extract(urn, "^<urn:page:(-?[0-9]+)>$", 1).try_cast("long")


def page_report(read: DataFrame) -> DataFrame:
    """Of the records that :func:`write_archives` wrote: page_id, payload_bytes, payload_digest,
    record_type and refers_to (a page_id)."""
    return read.where("gap_reason is null").select(
        _page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _page("refers_to").alias("refers_to"))

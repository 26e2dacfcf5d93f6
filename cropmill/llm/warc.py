"""WARC archives: a writer and a salvage reader.

The writer makes one gzip member of each record and lets Spark's own text writer put them on any file system Spark knows: a record is
written as its bytes but the last, and the line separator is that last byte, a zero (a gzip member ends with the high byte of its
length, which is zero below 16 MB; to longer ones an empty member is added). So files are plain ``.warc.gz`` bytes.

Records of equal payloads of some length are written once; the others are ``revisit`` records that refer to it.

The reader takes archives of gzip members, plain records or both. Where a check fails (the member, the version line, the length, the
end of the record, a digest) it searches for the next member or version line that starts a valid record, goes on there, and logs the
bytes between as a gap.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cropmill.storage import settle, small_batches

MAGIC, VERSION = b"\x1f\x8b\x08", b"WARC/"
_EMPTY = zlib.compressobj(6, zlib.DEFLATED, 31).flush()
_STARTS = re.compile(rb"\x1f\x8b\x08|WARC/[0-9]\.[0-9]\r\n")
_VERSION_LINE = re.compile(rb"WARC/[0-9]\.[0-9]\r\n")
_PROFILE = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Header lines of a record take no more bytes than this.
MOST_HEADER = 1 << 20
#: Archives hold this many bytes of payload at most (or one record), as the reader takes each whole; payloads up to ``SMALL`` share archives.
MOST_ARCHIVE, SMALL = 256 << 20, 64 << 10


def member(record: bytes) -> bytes:
    """The record as one gzip member; an empty member follows where the last byte would not be zero."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = z.compress(record) + z.flush()
    return out if not out[-1] else out + _EMPTY


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "2024-01-01T00:00:00Z") -> bytes:
    """A response record with an HTTP message around the payload, or a revisit record with the message's header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    name = b"<urn:page:%s>"
    block = http + payload if refers_to is None else http
    lines = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: " + name % (b"" if page_id is None else b"%d" % page_id), b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(), b"WARC-Block-Digest: sha256:" + hashlib.sha256(block).hexdigest().encode()]
    if url is not None:
        lines.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if refers_to is not None:
        lines += [b"WARC-Refers-To: " + name % (b"%d" % refers_to), b"WARC-Profile: " + _PROFILE]
    lines += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"


class BadRecord(ValueError):
    """A check failed; the text says which."""


def parse_record(data: bytes, at: int) -> tuple[int, dict[bytes, bytes], bytes]:
    """The record that starts at ``at``: its end, its header lines by lower-case name, its block."""
    if not _VERSION_LINE.match(data, at):
        raise BadRecord("version line")
    stop = data.find(b"\r\n\r\n", at, at + MOST_HEADER)
    if stop < 0:
        raise BadRecord("header")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("header")
        head[name.strip().lower()] = value.strip()
    if not head.get(b"content-length", b"").isdigit():
        raise BadRecord("length")
    end = stop + 4 + int(head[b"content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise BadRecord("end of record")
    block = data[stop + 4 : end]
    if (said := head.get(b"warc-block-digest", b"")).startswith(b"sha256:") and said[7:].lower() != hashlib.sha256(block).hexdigest().encode():
        raise BadRecord("block digest")
    return end + 4, head, block


def inflate(data: bytes, at: int) -> tuple[int, bytes]:
    """The gzip member that starts at ``at``: its end and its content. Read in steps, so that nothing after it is copied."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data):
                raise BadRecord("cut member")
            parts.append(z.decompress(data[pos : pos + 65536]))
            pos += 65536
    except zlib.error as e:
        raise BadRecord("member") from e
    return min(pos, len(data)) - len(z.unused_data), b"".join(parts)


def inflated_as_far(data: bytes, at: int) -> bytes:
    """What can be read of a broken gzip member."""
    z, parts = zlib.decompressobj(31), []
    for pos in range(at, len(data), 4096):
        try:
            parts.append(z.decompress(data[pos : pos + 4096]))
        except zlib.error:
            # The step that fails gives nothing: read it again byte by byte.
            z = zlib.decompressobj(31)
            parts = [z.decompress(data[at:pos])]
            for p in range(pos, min(pos + 4096, len(data))):
                try:
                    parts.append(z.decompress(data[p : p + 1]))
                except zlib.error:
                    break
            break
        if z.eof:
            break
    return b"".join(parts)


def records_within(inner: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes] | None, bytes, str]]:
    """(offset, length, header, block, reason) of the valid records of inflated bytes, and of the gaps between."""
    at, gap, why = 0, None, ""
    while at < len(inner):
        try:
            end, head, block = parse_record(inner, at)
        except BadRecord as e:
            if gap is None:
                gap, why = at, str(e)
            m = _VERSION_LINE.search(inner, at + 1)
            at = m.start() if m else len(inner)
            continue
        if gap is not None:
            yield gap, at - gap, None, b"", why
            gap = None
        yield at, end - at, head, block, ""
        at = end
    if gap is not None:
        yield gap, len(inner) - gap, None, b"", why


def read_archive(data: bytes) -> Iterator[tuple[int, int, dict[bytes, bytes] | None, bytes, str]]:
    """(offset, length, header, block, reason) of records in order; a gap has no header, and the reason of its first failed check.

    Offsets and lengths are of the file's bytes. Within a gzip member that holds a bad record, the valid records before and after it are
    read, and the member is logged as a gap besides them, its reason telling the bad range of inflated bytes. A member that breaks off
    gives the records that can be inflated; the search for the next start goes on within it.
    """
    at, gap, why = 0, None, ""
    while at < len(data):
        found: list = []
        try:
            if data.startswith(MAGIC, at):
                end, inner = inflate(data, at)
                found = list(records_within(inner))
                if inner and not any(head for _, _, head, _, _ in found):
                    raise BadRecord(found[0][4])
            else:
                end, head, block = parse_record(data, at)
                found = [(0, end - at, head, block, "")]
        except BadRecord as e:
            broken = [x for x in records_within(inflated_as_far(data, at)) if x[2] is not None] if data.startswith(MAGIC, at) else []
            if broken and gap is not None:
                yield gap, at - gap, None, b"", why
                gap = None
            if gap is None:
                gap, why = at, str(e)
            m = _STARTS.search(data, at + 1)
            end = m.start() if m else len(data)
            for _, _, head, block, _ in broken:
                yield at, end - at, head, block, ""
            at = end
            continue
        if gap is not None and found:
            yield gap, at - gap, None, b"", why
            gap = None
        for start, size, head, block, reason in found:
            yield at, end - at, head, block, reason if head is not None else f"{reason} at {start}, {size} bytes of the member's content"
        at = end
    if gap is not None:
        yield gap, len(data) - gap, None, b"", why


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", least_bytes: int = 100) -> None:
    """Write a record for each row to archives under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes the one with the smallest id is a response (rows that repeat that id
    too), the others are revisits of it. A null body is empty; rows of null id are responses. An empty table writes no record. Archives are
    added to what ``path`` holds.
    """
    small_batches(pages.sparkSession)
    body = F.coalesce(F.col(body_col).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), body.alias("body")).withColumn("digest", F.sha2("body", 256))
    narrow = rows.select("digest", "page_id", F.octet_length("body").alias("size"))
    first = narrow.where(F.col("size") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    # Written first, so that the joins meet plain exchanges, whose large partitions Spark can split. Only narrow rows meet by digest, as
    # those of a common page are many; payloads meet by id.
    first = settle(first, "payloads")
    again = narrow.join(first, "digest").where(F.col("page_id") > F.col("first")).select("page_id", "digest", F.col("first").alias("refers_to")).distinct()
    known = rows.join(settle(again, "revisits"), ["page_id", "digest"], "left").select("page_id", "url", "body", "digest", "refers_to")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [member(record_bytes(*(batch.column(c)[i].as_py() for c in range(5))))[:-1] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    largest = narrow.agg(F.max("size")).first()[0] or 0
    size = F.octet_length("body")
    for mine, at_most in ((size <= SMALL, SMALL), (size > SMALL, largest))[: 1 + (largest > SMALL)]:
        members = known.where(mine).mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
        members.write.mode("append").option("lineSep", "\0").option("maxRecordsPerFile", max(1, MOST_ARCHIVE // (at_most + 4096))).text(path)


_FIELDS = "path string, offset long, length long, gap boolean, reason string, record_type string, page_id long, url string, payload_bytes long, payload_digest string, refers_to long"


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record and each gap of the archives under ``path``.

    A record's ``payload_digest`` and ``payload_bytes`` are of its full payload: a response's are taken from its bytes (and its digest
    line must agree), a revisit's from its header lines. Gaps have ``gap`` true, their place and the check that failed.
    """
    small_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def number(x: bytes | None) -> int | None:
        m = re.fullmatch(rb"<urn:page:(-?[0-9]+)>", x or b"")
        return int(m[1]) if m else None

    def row(where: str, at: int, size: int, head: dict[bytes, bytes] | None, block: bytes, why: str) -> tuple:
        if head is None:
            return (where, at, size, True, why, *[None] * 6)
        kind, said = head.get(b"warc-type", b"").decode(errors="replace"), head.get(b"warc-payload-digest", b"").removeprefix(b"sha256:").decode(errors="replace").lower()
        http, blank, payload = block.partition(b"\r\n\r\n")
        length = re.search(rb"(?im)^content-length:\s*([0-9]+)", http)
        if kind == "revisit":
            n, digest = int(length[1]) if length else None, said
        else:
            n, digest = len(payload), hashlib.sha256(payload).hexdigest()
            if said and said != digest:
                return (where, at, size, True, "payload digest", *[None] * 6)
        uri = head.get(b"warc-target-uri")
        return (where, at, size, False, None, kind, number(head.get(b"warc-record-id")), uri.decode(errors="replace") if uri is not None else None, n, digest, number(head.get(b"warc-refers-to")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("gap", pa.bool_()), ("reason", pa.string()), ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for where, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = [row(where, *x) for x in read_archive(content.as_py())]
                for a in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found[a : a + 10_000], strict=True), schema, strict=True)], schema=schema)

    return files.mapInArrow(run, _FIELDS)

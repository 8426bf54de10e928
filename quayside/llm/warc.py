"""WARC archives: writing with revisits and segments, and reassembly.

Writing: of pages with equal payloads of at least ``min_bytes`` bytes, the
one with the smallest id is a response and the others are revisits without a
body.  A response is an HTTP message in chunked transfer framing; when it is
longer than ``segment_bytes`` it is cut into a first record and continuation
records.  Records are gzip members in files of about ``file_bytes``.

Reading: continuation records are grouped by the origin's record id, ordered
by segment number, and must be gapless and add up to the stated total length;
then the chunked framing is decoded and the payload's digest is verified.
Records that are not segmented need no grouping.  Continuations may lie in
other files than their origin.

Defined cases: a null payload is an empty one; rows with equal payloads and
the same smallest id are all responses; a null id never is the smallest while
another exists; if all ids are null, all are responses; an empty table writes
no file and reads back as no rows.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .blobs import read_blobs, write_blobs

# fixed values: the last member of a file is an empty gzip member, whose crc
# and length, eight zero bytes, are the file's ending
GZIP_EMPTY = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0])
ENDING = "\0" * 8
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2026-01-01T00:00:00Z"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = 4096) -> bytes:
    """Chunked transfer framing of a payload."""
    parts = []
    for i in range(0, len(payload), size):
        part = payload[i:i + size]
        parts += [b"%x\r\n" % len(part), part, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are skipped."""
    parts, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0].strip(), 16)
        at = end + 2
        if size == 0:
            return b"".join(parts)
        part = body[at:at + size]
        if len(part) != size or body[at + size:at + size + 2] != b"\r\n":
            raise ValueError("chunked framing is damaged")
        parts.append(part)
        at += size + 2


def http_payload(block: bytes) -> bytes:
    """Payload of an HTTP response block, decoded from its transfer framing."""
    head, _, body = block.partition(b"\r\n\r\n")
    if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head):
        return unchunked(body)
    return body


def record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    """One WARC record as a gzip member."""
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in headers if v is not None),
             f"Content-Length: {len(block)}"]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def page_records(page_id, url, payload: bytes, refers_to, name: str,
                 segment_bytes: int) -> list[bytes]:
    """The records of one page: a revisit, or a response in its segments."""
    # a header holds no line breaks
    uri = re.sub(r"[\x00-\x20]", lambda m: f"%{ord(m[0]):02X}", url) if url is not None else None
    common = [("WARC-Date", DATE), ("WARC-Target-URI", uri), ("X-Page-Id", page_id)]
    digest = [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
              ("X-Payload-Length", len(payload))]
    kind = [("Content-Type", "application/http; msgtype=response")]
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name),
                        ("WARC-Profile", REVISIT_PROFILE), ("X-Refers-To-Page", refers_to),
                        *common, *digest, *kind], head + b"\r\n")]
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    main = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, *digest, *kind]
    if len(block) <= segment_bytes:
        return [record(main, block)]
    cuts = range(0, len(block), segment_bytes)
    out = [record([*main, ("WARC-Segment-Number", 1)], block[:segment_bytes])]
    for n, at in enumerate(cuts[1:], 2):
        out.append(record([("WARC-Type", "continuation"),
                           ("WARC-Record-ID", f"{name[:-1]}:segment:{n}>"), *common,
                           ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", n),
                           ("WARC-Segment-Total-Length",
                            len(block) if n == len(cuts) else None)],
                          block[at:at + segment_bytes]))
    return out


def with_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
                  payload_col: str = "html", min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to (null for responses).

    Payloads are compared by SHA-1 and length.  Only digests that occur more
    than once take part in the join; a digest of many rows is one row on the
    other side, so the skew join splits it.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"),
                        F.col(url_col).cast("string").alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).cast("binary").alias("payload"))
    keyed = rows.withColumn("digest", F.sha1("payload"))
    first = (keyed.where(F.length("payload") >= min_bytes).groupBy("digest")
             .agg(F.count("*").alias("n"), F.min("page_id").alias("first"))
             .where("n > 1").select("digest", "first"))
    return keyed.join(first, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   payload_col: str = "html", min_bytes: int = 0, segment_bytes: int = 16_384,
                   file_bytes: int = 8_000_000) -> None:
    """Write the pages' records to gzip WARC files in a new folder."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        part, n, members, size = TaskContext.get().partitionId(), 0, [], 0

        def file():
            return pa.RecordBatch.from_pydict({"file": [b"".join([*members, GZIP_EMPTY])]})

        for batch in batches:
            for page in zip(*(batch.column(i) for i in range(4))):
                page_id, url, payload, refers = (x.as_py() for x in page)
                name = f"<urn:x-page:{page_id}:{part}.{n}>"
                for member in page_records(page_id, url, payload, refers, name, segment_bytes):
                    members.append(member)
                    size += len(member)
                n += 1
                if size >= file_bytes:
                    yield file()
                    members, size = [], 0
        if members:
            yield file()

    rows = with_revisits(pages, id_col, url_col, payload_col, min_bytes)
    write_blobs(rows.mapInArrow(build, "file binary"), "file", path, ENDING)


def parse_archive(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of each record of a file."""
    view, at = memoryview(content), 0
    while at < len(view):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:   # bounded windows, so that little is copied per member
            if at >= len(view):
                raise ValueError("the archive is cut short")
            window = view[at:at + 65_536]
            parts.append(z.decompress(window))
            at += len(window) - len(z.unused_data)
        raw = b"".join(parts)
        if not raw:
            continue
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in
                   (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("the record's length is wrong")
        yield headers, rest[:size]


def finish_record(headers: dict[str, str], block: bytes) -> dict:
    """The read-back row of a whole (reassembled) response or a revisit."""
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    number = lambda k: int(headers[k]) if headers.get(k, "None") != "None" else None
    row = {"page_id": number("x-page-id"), "url": headers.get("warc-target-uri"),
           "record_type": headers["warc-type"], "payload_digest": digest,
           "payload_bytes": int(headers["x-payload-length"]),
           "refers_to": number("x-refers-to-page"), "payload": None}
    if row["record_type"] == "response":
        payload = http_payload(block)
        if base32_sha1(payload) != digest or len(payload) != row["payload_bytes"]:
            raise ValueError(f"payload of {headers['warc-record-id']} fails its digest")
        row["payload"] = payload
    return row


_ROW = ("page_id long, url string, record_type string, payload_digest string, "
        "payload_bytes long, refers_to long, payload binary")
_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()),
                    ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                    ("refers_to", pa.int64()), ("payload", pa.binary())])
_SEGMENT = "origin string, number long, total long, headers map<string,string>, block binary"
_SEGMENT_ARROW = pa.schema([("origin", pa.string()), ("number", pa.int64()),
                            ("total", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())),
                            ("block", pa.binary())])


def _batched(rows: Iterator[tuple[dict, int]], schema: pa.Schema, limit: int = 8_000_000):
    held, size = [], 0
    for row, n in rows:
        held.append(row)
        size += n
        if size >= limit or len(held) >= 10_000:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def reassemble(segments: list[tuple[int, int | None, bytes]]) -> bytes:
    """The block of (number, total length or null, bytes) segments in any order."""
    segments = sorted(segments, key=lambda s: s[0])
    if [s[0] for s in segments] != list(range(1, len(segments) + 1)):
        raise ValueError("segments are missing or repeated")
    block = b"".join(s[2] for s in segments)
    if segments[-1][1] != len(block):
        raise ValueError("total length is wrong or missing")
    return block


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page: page_id, url, record_type, payload_digest,
    payload_bytes, refers_to, payload (null for revisits)."""

    def whole(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for headers, block in parse_archive(content.as_py()):
                        if "warc-segment-number" not in headers:
                            yield finish_record(headers, block), len(block)
        yield from _batched(rows(), _ARROW)

    def parts(batches):
        def rows():
            for batch in batches:
                for content in batch.column(0):
                    for headers, block in parse_archive(content.as_py()):
                        if "warc-segment-number" in headers:
                            total = headers.get("warc-segment-total-length")
                            yield {"origin": headers.get("warc-segment-origin-id",
                                                         headers["warc-record-id"]),
                                   "number": int(headers["warc-segment-number"]),
                                   "total": int(total) if total else None,
                                   "headers": list(headers.items()), "block": block}, len(block)
        yield from _batched(rows(), _SEGMENT_ARROW)

    def join(batches):
        def rows():
            for batch in batches:
                for group in batch.column(0):
                    group = group.as_py()
                    first = next(s for s in group if s["number"] == 1)
                    block = reassemble([(s["number"], s["total"], s["block"]) for s in group])
                    yield finish_record(dict(first["headers"]), block), len(block)
        yield from _batched(rows(), _ARROW)

    files = read_blobs(spark, path).select("content")
    # a group is one record's segments
    groups = (files.mapInArrow(parts, _SEGMENT).groupBy("origin")
              .agg(F.collect_list(F.struct("number", "total", "headers", "block")).alias("group"))
              .select("group"))
    return files.mapInArrow(whole, _ROW).unionByName(groups.mapInArrow(join, _ROW))

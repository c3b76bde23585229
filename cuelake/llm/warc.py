"""WARC archives: writer with revisit records, and a splittable reader.

The reader plans byte ranges over gzip-per-record archives.  A task scans its
range for the gzip magic, decodes the head of each candidate and takes it as a
member only if it begins with a WARC header, and owns the records that start
inside its range, wherever they end.  From a member's end the next one is
found without scanning; an archive is opened once a range.  Text payloads
can't hold the magic, as it is no UTF-8.  A payload that is itself an archive
can: deflate stores what it can't compress, so a range that starts inside such
a payload may give its inner records as well.

Archives of other writers are read too: payload digests in base32 or hex are
checked, other algorithms and absent ones are not; a digest that differs from
its payload gives a row with an ``error``; lengths and ids that are no numbers
are null; records of other types are passed over.

The writer keeps one payload of each group of equal payloads of MIN_REVISIT
bytes or more, that of the largest id; the others become revisit records that
carry its digest, its length and the id they refer to.

Defined cases: a null payload is empty; a null id gives a record without one
and can't be referred to; rows that repeat the largest id with equal payloads
are all responses; an empty table gives no archive and an empty result.
Headers hold no line breaks: those of a url become spaces.  A very long
payload is one record, which its task holds whole; other columns of the pages
are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .archives import filesystem, fresh_name, ranges, retried
from .common import Scratch

MIN_REVISIT = 1000
HOT = 1000
SPLIT_BYTES = 8 << 20
#: An archive file is closed once it holds so many bytes.
FILE_BYTES = 256 << 20
_MAGIC = b"\x1f\x8b\x08"
_HEAD = 64 << 10
_CHUNK = 1 << 20

_RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary, error string, path string, offset long"


def _member(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(f"WARC-Target-URI: {' '.join((url or '').split())}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def _writer(folder: str):
    """Rows (page_id, url, html, digest, refers_to) to archives; yields (path, size, records)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = filesystem(folder)
        system.create_dir(base, recursive=True)
        out, name, size, count, done = None, "", 0, 0, []
        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(k)[i].as_py() for k in range(5))
                if out is None:
                    name, size, count = fresh_name(base, ".warc.gz"), 0, 0
                    out = retried(lambda: system.open_output_stream(name, compression=None))  # noqa: B023
                blob = _member(page_id, url, (html or "").encode(), digest, refers_to)
                out.write(blob)
                size, count = size + len(blob), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    done.append((f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}", size, count))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder.rstrip('/')}/{name.rsplit('/', 1)[1]}", size, count))
        yield pa.RecordBatch.from_pylist([dict(zip(("path", "size", "records"), x, strict=True)) for x in done], pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))

    return run


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, scratch: Scratch, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archives of ``pages`` under ``folder``; the table (path, size, records) of those that count.

    Only what successful tasks report is listed, so files of lost tries are never read.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = rows.withColumn("digest", F.sha1(payload)).withColumn("large", F.octet_length(payload) >= MIN_REVISIT)
    count = rows.where("large").groupBy("digest").agg(F.max("page_id").alias("target"), F.count("*").alias("n")).where("n > 1")
    first = scratch.store(count.where("target is not null"), "targets")
    # Payloads with more than a HOT-th of the repeated rows are at most HOT, and met by a broadcast; all others meet in a join on the digest.
    least = max(1, (first.agg(F.sum("n")).first()[0] or 0) // HOT)
    often = F.broadcast(first.where(F.col("n") > least).select(F.col("digest").alias("hot"), F.col("target").alias("hot_target")))
    rows = rows.join(often, F.when(F.col("large"), F.col("digest")) == F.col("hot"), "left")
    # Rows without a partner to look for are dealt out evenly.
    alone = ~F.col("large") | F.col("hot_target").isNotNull()
    key = F.when(alone, F.concat(F.lit("-"), F.xxhash64("page_id", "url", "digest").cast("string"))).otherwise(F.col("digest"))
    rows = rows.withColumn("key", key).join(first.where(F.col("n") <= least).select(F.col("digest").alias("key"), "target"), "key", "left").withColumn("target", F.coalesce("hot_target", "target"))
    refers = F.when(F.col("large") & ~F.coalesce(F.col("page_id") == F.col("target"), F.lit(False)), F.col("target"))
    rows = rows.select("page_id", "url", "html", "digest", refers.alias("refers_to"))
    return scratch.store(rows.mapInArrow(_writer(folder), "path string, size long, records long"), "archives")


class _Archive:
    """One archive, open over a task's byte range; opened again after an input/output error."""

    def __init__(self, path: str):
        self.path, self.source, self.size = path, None, 0

    def read(self, at: int, size: int) -> bytes:
        def once() -> bytes:
            if self.source is None:
                system, name = filesystem(self.path)
                self.source = system.open_input_file(name)
                self.size = self.source.size()
            try:
                self.source.seek(min(at, self.size))
                return self.source.read(size)
            except OSError:
                self.close()
                raise

        return retried(once)

    def close(self) -> None:
        if self.source is not None:
            self.source.close()
        self.source = None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The member at ``at`` and its end, or None if no WARC record begins there."""
        inflate, parts, read = zlib.decompressobj(31), [], 0
        while not inflate.eof:
            chunk = self.read(at + read, _HEAD if not read else _CHUNK)
            if not chunk:
                return None
            read += len(chunk)
            try:
                parts.append(inflate.decompress(chunk))
            except zlib.error:
                return None
            head = parts[0]
            if len(parts) == 1 and not b"WARC/".startswith(head[:5]) and not head.startswith(b"WARC/"):
                return None
        whole = b"".join(parts)
        return (whole, at + read - len(inflate.unused_data)) if whole.startswith(b"WARC/") and b"\r\n\r\n" in whole else None

    def first_member(self, first: int, last: int) -> tuple[int, bytes, int] | None:
        """The first member that starts in [first, last): its place, content and end."""
        at = first
        while at < last:
            window = self.read(at, min(_CHUNK, last - at) + len(_MAGIC) - 1)
            spot = window.find(_MAGIC)
            while 0 <= spot and at + spot < last:
                if found := self.member(at + spot):
                    return at + spot, *found
                spot = window.find(_MAGIC, spot + 1)
            at += _CHUNK
        return None


def _number(text: str, signed: bool = False) -> int | None:
    """A whole number in a header; what is none says nothing."""
    text = text.strip()
    digits = text.removeprefix("-") if signed else text
    return int(text) if digits.isascii() and digits.isdigit() else None


def _sha1(stated: str) -> str | None:
    """The lower-case hex form of a stated SHA-1 in hex or base32; None for other algorithms and forms."""
    kind, _, value = stated.strip().partition(":")
    if kind.lower() not in ("sha1", "sha-1"):
        return None
    value = value.strip()
    if len(value) == 40 and all(c in "0123456789abcdefABCDEF" for c in value):
        return value.lower()
    try:
        return base64.b32decode(value.upper()).hex() if len(value) == 32 else None
    except ValueError:
        return None


def _parse(whole: bytes) -> dict | None:
    head, _, rest = whole.partition(b"\r\n\r\n")
    fields: dict[str, str] = {}
    for line in head.split(b"\r\n")[1:]:
        name, _, value = line.decode("utf-8", "replace").partition(":")
        fields.setdefault(name.strip().lower(), value.strip())
    kind, length = fields.get("warc-type"), _number(fields.get("content-length", ""))
    if kind not in ("response", "revisit") or length is None:
        return None
    http, _, body = rest[:length].partition(b"\r\n\r\n")
    stated = next((_number(x.split(b":", 1)[1].decode("ascii", "replace")) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), None)
    given, refers = _sha1(fields.get("warc-payload-digest", "")), fields.get("warc-refers-to", "").removeprefix("<urn:page:").rstrip(">")
    digest = hashlib.sha1(body).hexdigest() if kind == "response" else given
    return {
        "page_id": _number(fields.get("x-page-id", ""), signed=True),
        "url": fields.get("warc-target-uri"),
        "record_type": kind,
        "refers_to": _number(refers, signed=True),
        "payload_bytes": len(body) if kind == "response" else stated,
        "payload_digest": digest,
        "payload": None if kind == "revisit" else body,
        "error": "payload digest differs from its header" if kind == "response" and given and given != digest else None,
    }


_SCHEMA = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("error", pa.string()), ("path", pa.string()), ("offset", pa.int64()),
])


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, _, first, last in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            archive = _Archive(path)
            try:
                found = archive.first_member(first, last)
                rows, held = [], 0
                while found and found[0] < last:
                    at, whole, end = found
                    if record := _parse(whole):
                        rows.append(record | {"path": path, "offset": at})
                        held += len(whole)
                    if held > _CHUNK:
                        yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
                        rows, held = [], 0
                    if end >= last:
                        break
                    following = archive.member(end)
                    found = (end, *following) if following else archive.first_member(end, last)
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _SCHEMA)
            finally:
                archive.close()


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The response and revisit records of the archives (path, size)."""
    return ranges(files.select("path", "size"), split_bytes).mapInArrow(_reader, _RECORD)


ORACLE = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
t AS (SELECT digest, max(page_id) AS target FROM p WHERE n >= 1000 AND page_id IS NOT NULL GROUP BY digest HAVING count(*) > 1)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN n >= 1000 AND target IS NOT NULL AND page_id IS DISTINCT FROM target THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM target THEN target END AS refers_to
FROM p LEFT JOIN t ON p.digest = t.digest
"""

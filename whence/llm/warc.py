"""Legacy ARC archives converted to WARC, with revisit records for repeats.

An ARC file starts with a `filedesc://` block that names its version (1 or 2)
and the fields of its header lines; each record is such a line, whose last
field declares the length of what follows.  The converter reads records by
those lengths and makes up what WARC adds: record identifiers, ISO timestamps,
record types and digests.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The header fields that the two versions declare.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: Pages of one archive that arc_archives() makes.
PAGES_PER_ARCHIVE = 256
#: Records of one WARC file; a task holds a file compressed, and one of its records.
RECORDS_PER_FILE = 500
#: HTTP header that holds a record's own key.
KEY = "X-Record-Key"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(rb"[\x00-\x20\x7f]")


class ArcRecord(NamedTuple):
    offset: int
    fields: dict[str, str]
    content: bytes


def safe_url(url: str | None) -> str:
    """An ARC header is cut at spaces, so those and controls are escaped."""
    raw = (url or "about:blank").encode("utf-8", "replace")
    return _UNSAFE.sub(lambda m: b"%%%02X" % m[0][0], raw).decode("utf-8", "replace")


def arc_header(name: str, version: int, date: str = "20000101000000") -> bytes:
    body = f"{version} 0 archive\n{ARC_FIELDS[version]}\n".encode()
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{middle} {len(body)}\n".encode() + body


def arc_record(version: int, url: str, content: bytes, offset: int, name: str, ip: str = "0.0.0.0", date: str = "20000101000000", kind: str = "text/html", status: int = 200) -> bytes:
    middle = "" if version == 1 else f" {status} {hashlib.md5(content).hexdigest()} - {offset} {name}"
    return f"\n{url} {ip} {date} {kind}{middle} {len(content)}\n".encode() + content


def parse_arc(data: bytes) -> Iterator[ArcRecord]:
    """All records, the filedesc record first.  An empty archive has none; a
    header or length that does not fit raises ValueError with its offset."""
    at, names = 0, None
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)].decode("utf-8", "replace").rstrip("\r")
        width = len(names) if names else len(ARC_FIELDS[1 if line.count(" ") == 4 else 2].split())
        values = line.rsplit(" ", width - 1)
        if end < 0 or len(values) != width or not values[-1].isdigit() or end + 1 + int(values[-1]) > len(data):
            raise ValueError(f"no ARC record at offset {at}")
        content = data[end + 1 : end + 1 + int(values[-1])]
        if names is None:
            first, declared = content.decode("utf-8", "replace").split("\n")[:2]
            version = int(first.split()[0])
            names = declared.split()
            if not line.startswith("filedesc://") or version not in ARC_FIELDS or len(names) != width:
                raise ValueError("not an ARC archive of version 1 or 2")
        yield ArcRecord(at, dict(zip(names, values, strict=True)), content)
        at = end + 1 + len(content)


def iso(date: str) -> str:
    """14 digits to ISO 8601; missing digits count as the earliest time."""
    d = date + "00000101000000"[len(date) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, payload


def batches_of(rows: Iterator[tuple], schema: pa.Schema, most: int = 500, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row if isinstance(x, bytes))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def arc_archives(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", per_archive: int = PAGES_PER_ARCHIVE) -> DataFrame:
    """(archive, content): legacy archives of the pages, version 1 and 2 in turn."""
    schema = pa.schema([("archive", pa.string()), ("content", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def archives() -> Iterator[tuple]:
            part, number, name, data, n, size = TaskContext.get().partitionId(), 0, "", [], 0, 0
            for batch in batches:
                for k, u, h in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    version = 1 + number % 2
                    if not data:
                        name = f"pages-{part:05d}-{number:05d}.arc"
                        data = [arc_header(name, version)]
                        size = len(data[0])
                    body = h or b""
                    own = "" if k is None else f"{KEY}: {k}\r\n"
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n{own}\r\n"
                    data.append(arc_record(version, safe_url(u), head.encode() + body, size, name))
                    size += len(data[-1])
                    n += 1
                    if n >= per_archive or size >= 16 << 20:
                        yield name, b"".join(data)
                        data, n, number = [], 0, number + 1
            if data:
                yield name, b"".join(data)

        yield from batches_of(archives(), schema, most=1)

    source = pages.select(F.col(key).cast("long"), F.col(url).cast("string"), F.col(html).cast("string").cast("binary"))
    return source.mapInArrow(run, "archive string, content binary")


RECORD = "key long, record_id string, record_type string, target_uri string, date string, ip string, payload_digest string, block binary"


def arc_to_warc(archives: DataFrame) -> DataFrame:
    """Records of archives(archive, content): what each ARC record becomes.

    filedesc -> warcinfo, an HTTP message -> response, anything else -> resource.
    The identifier is made from the record's own key, where its HTTP header has
    one, else from archive name and offset.  Null content holds no record.
    """
    schema = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORD.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                for name, content in zip(batch.column(0), batch.column(1), strict=True):
                    for r in parse_arc(content.as_py() or b""):
                        key, kind, sha, block = None, "resource", None, r.content
                        where = f"{name.as_py()}:{r.offset}"
                        if r.fields["URL"].startswith("filedesc://"):
                            kind, block = "warcinfo", f"software: arc conversion\r\nisPartOf: {name.as_py()}\r\n".encode()
                        elif block.startswith(b"HTTP/"):
                            head, payload = http_parts(block)
                            kind, sha = "response", digest(payload)
                            own = head.get(KEY.lower(), "")
                            key = int(own) if re.fullmatch(r"-?\d+", own) else None
                        else:
                            sha = digest(block)
                        ident = f"urn:x-record:{key}" if key is not None else uuid.uuid5(uuid.NAMESPACE_URL, where).urn
                        yield key, ident, kind, r.fields["URL"], iso(r.fields["Archive-date"]), r.fields["IP-address"], sha, block

        yield from batches_of(records(), schema)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def with_revisits(records: DataFrame) -> DataFrame:
    """Adds refers_to: of response records with one payload digest, that with
    the largest key stays a response and the others revisit it.  Records that
    repeat the largest key stay responses; so do all of a payload without keys."""
    last = records.where("record_type = 'response'").groupBy(F.col("payload_digest").alias("same")).agg(F.max("key").alias("last"), F.count("*").alias("n"))
    last = last.where("n > 1 and last is not null").select("same", "last")
    joined = records.join(last, (records.payload_digest == last.same) & (records.record_type == "response"), "left")
    revisits = F.col("last").isNotNull() & ~F.col("last").eqNullSafe(F.col("key"))
    return joined.select(*records.columns, F.when(revisits, F.col("last")).alias("refers_to"))


def warc_record(record_id: str, kind: str, uri: str | None, date: str, ip: str | None, sha: str | None, block: bytes, refers_to: int | None = None) -> bytes:
    """One record without the two line ends that close it."""
    if refers_to is not None:  # the HTTP head stays, so the payload's length does too
        kind, block = "revisit", block.partition(b"\r\n\r\n")[0] + b"\r\n\r\n"
    types = {"warcinfo": "application/warc-fields", "response": "application/http;msgtype=response", "revisit": "application/http;msgtype=response"}
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {date}"]
    if kind != "warcinfo":
        lines += [f"WARC-Target-URI: {uri}", f"WARC-IP-Address: {ip}", f"WARC-Payload-Digest: sha1:{sha}"]
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: <urn:x-record:{refers_to}>"]
    lines += [f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Type: {types.get(kind, 'application/octet-stream')}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def write_warc(records: DataFrame, path: str, compression: str = "gzip", records_per_file: int = RECORDS_PER_FILE) -> None:
    """Spark's text sink writes the records' bytes; its line separator is what
    closes a WARC record, so each file is an archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [warc_record(*row) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(data, pa.binary())], names=["value"])

    rows = records.select("record_id", "record_type", "target_uri", "date", "ip", "payload_digest", "block", "refers_to").mapInArrow(run, "value binary")
    rows.select(F.col("value").cast("string")).write.option("lineSep", "\r\n\r\n").option("compression", compression).option("maxRecordsPerFile", records_per_file).text(path)


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header with lower-case names, block) of each record of an archive, one
    after the other: of a compressed one no more than a record is held at once."""
    raw = io.BytesIO(data)
    source = io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 20) if data[:2] == b"\x1f\x8b" else raw
    while first := source.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {first[:40]!r}")
        head = {}
        while (line := source.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = int(head["content-length"])
        block = source.read(size)
        if len(block) != size or source.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {head.get('warc-record-id')} does not end where it says")
        yield head, block


def read_warc(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """key, record_id, record_type, target_uri, date, refers_to (a record id),
    payload_digest, payload_bytes and, if asked for, payload.

    For a response, digest and length are those of the payload read, and a
    digest that differs from the declared one raises ValueError.  A revisit
    has no payload here: both are declared ones.
    """
    kinds = {"key": pa.int64(), "payload_bytes": pa.int64(), "payload": pa.binary()}
    names = ["key", "record_id", "record_type", "target_uri", "date", "refers_to", "payload_digest", "payload_bytes"] + ["payload"] * with_payload
    schema = pa.schema([(n, kinds.get(n, pa.string())) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[tuple]:
            for batch in batches:
                for content in batch.column(0):
                    for head, block in parse_warc(content.as_py()):
                        kind = head["warc-type"]
                        http, payload = http_parts(block) if kind in ("response", "revisit") else ({}, block)
                        declared = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                        if kind == "revisit":
                            payload, n = None, int(http["content-length"])
                        else:
                            n = len(payload)
                            if declared and digest(payload) != declared:
                                raise ValueError(f"{head['warc-record-id']}: the payload has another digest")
                        own = http.get(KEY.lower())
                        row = (int(own) if own else None, head["warc-record-id"][1:-1], kind, head.get("warc-target-uri"), head["warc-date"], head.get("warc-refers-to", "")[1:-1] or None, declared, n)
                        yield (*row, payload) if with_payload else row

        yield from batches_of(records(), schema)

    ddl = ", ".join(f"{n} {'long' if n in ('key', 'payload_bytes') else 'binary' if n == 'payload' else 'string'}" for n in names)
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, ddl)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages: to legacy archives, to WARC files, and read back."""
    from .common import new_path, table

    path = new_path(spark, "warc")
    write_warc(with_revisits(arc_to_warc(arc_archives(table(spark, sf_dir, "pages")))), path)
    back = read_warc(spark, path, with_payload=False).where("record_type <> 'warcinfo'")
    return back.select(
        F.col("key").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.regexp_extract("refers_to", r"^urn:x-record:(-?\d+)$", 1).cast("long").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (SELECT hex, max(page_id) AS last FROM p GROUP BY hex)
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (((('0x' || substr(hex, (10 * (i // 8) + 1)::BIGINT, 10))::BIGINT >> ((7 - i % 8) * 5)::INTEGER) & 31) + 1)::BIGINT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g USING (hex)
"""

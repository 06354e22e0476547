"""Delimited text as it comes: encoding and dialect probed, every row kept.

A short row is padded, what a long one has too much goes to __surplus_1 and so
on, and each row has its number and an identifier that follows from the data
set's version and that number.
"""

from __future__ import annotations

import json
from collections import Counter
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Encodings in the order in which they are tried, delimiters that are known.
ENCODINGS = ("utf-8", "utf-8-sig", "cp1252", "latin-1")
DELIMITERS = (",", ";", "\t", "|")
#: Bytes of a file's start and end that a probe reads.
WINDOW = 1 << 20


class Probe(NamedTuple):
    encoding: str
    rejected: tuple[tuple[str, int], ...]  # encodings that don't fit, and the offset of the first bad byte
    delimiter: str
    header: tuple[str, ...]


def probe_encoding(head: bytes, tail: bytes = b"", candidates: tuple[str, ...] = ENCODINGS) -> tuple[str, tuple[tuple[str, int], ...]]:
    """The first encoding in which a file's start and end can be read strictly."""
    rejected = []
    for name in candidates:
        at = 0
        try:
            for part, cut in ((head, True), (tail, False)):
                text = part[: len(part) - 3] if cut and tail else part  # a letter may be cut where the window ends,
                if not cut:  # or where it begins
                    text = text.lstrip(bytes(range(0x80, 0xC0))) if name.startswith("utf-8") else text
                text.decode(name)
                at += len(part)
        except UnicodeDecodeError as bad:
            rejected.append((name, at + bad.start))
            continue
        return name, tuple(rejected)
    raise ValueError(f"no encoding fits: {rejected}")


def sniff(text: str) -> str:
    """The delimiter that most of the first lines have equally often; a comma if none does."""
    lines = [line for line in text.splitlines()[:50] if line.strip()]
    best = (0.0, 0, ",")
    for d in reversed(DELIMITERS):
        often, share = Counter(line.count(d) for line in lines if d in line).most_common(1)[0] if any(d in line for line in lines) else (0, 0)
        if often and (share / len(lines), often) >= best[:2]:
            best = (share / len(lines), often, d)
    return best[2]


def probe(spark: SparkSession, path: str) -> Probe:
    """Of one file, or of a folder of its parts, from its start and end only."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = [hadoop]
    if fs.getFileStatus(hadoop).isDirectory():  # a file in parts, whose names are in order
        parts = sorted((f.getPath() for f in fs.listStatus(hadoop) if f.getLen() and f.getPath().getName()[0] not in "._"), key=lambda p: p.getName())
    size = fs.getFileStatus(parts[-1]).getLen() if parts else 0

    def read(part, at: int, n: int) -> bytes:
        stream = fs.open(part)
        try:
            stream.seek(at)
            return bytes(stream.readNBytes(n))
        finally:
            stream.close()

    head = read(parts[0], 0, WINDOW) if parts else b""
    if len(parts) > 1:
        tail = read(parts[-1], max(0, size - WINDOW), WINDOW)
    else:
        tail = read(parts[0], max(WINDOW, size - WINDOW), min(size - WINDOW, WINDOW)) if size > WINDOW else b""
    encoding, rejected = probe_encoding(head, tail)
    text = head.decode(encoding, "ignore").lstrip("﻿")
    delimiter = sniff(text)
    return Probe(encoding, rejected, delimiter, tuple(text.splitlines()[0].split(delimiter)) if text else ())


def letters(encoding: str) -> tuple[str, str]:
    """What a one-byte encoding makes of the upper bytes, where Latin-1 differs."""
    latin = [chr(b) for b in range(128, 256)]
    own = [bytes([b]).decode(encoding, "replace") for b in range(128, 256)]
    pairs = [(x, y) for x, y in zip(latin, own, strict=True) if x != y]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def decoded(raw: Column, encoding: str) -> Column:
    """Text of bytes.  Spark knows few encodings: bytes of another one with one byte
    a letter are read as Latin-1 and its letters translated; a byte that it doesn't
    have becomes U+FFFD, as malformed UTF-8 does."""
    name = encoding.lower()
    if name.startswith("utf-8"):
        return F.decode(raw, "UTF-8") if name == "utf-8" else F.regexp_replace(F.decode(raw, "UTF-8"), "^\ufeff", "")
    text = F.decode(raw, "ISO-8859-1")
    return text if name in ("latin-1", "iso-8859-1") else F.translate(text, *letters(name))


def encoded(text: Column, encoding: str) -> Column:
    """Bytes of text in a one-byte encoding; letters that it doesn't have become question marks."""
    old, new = letters(encoding)
    kept = [(x, y) for x, y in zip(old, new, strict=True) if y != "\ufffd"]
    return F.encode(F.translate(text, "".join(y for _, y in kept), "".join(x for x, _ in kept)), "ISO-8859-1")


def _line(encoding: str) -> Column:
    """Spark keeps a line's bytes as they are, whatever they mean."""
    return (F.col("value") if encoding.lower() == "utf-8" else decoded(F.col("value").cast("binary"), encoding)).alias("line")


def numbered(spark: SparkSession, path: str, encoding: str = "utf-8") -> DataFrame:
    """row_number (from 1, in file order), line (read by a probe's encoding).  Lines are
    counted by the splits that Spark reads and numbered by adding up: nothing is
    sorted or gathered."""
    from ..shared import written

    lines = spark.read.text(path).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("id"), _line(encoding))
    lines = written(lines, "lines")
    splits = lines.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    before = [(r["file"], r["block"], r["first"], r["n"]) for r in splits.orderBy("file", "block").collect()]  # a row for each split
    starts, at = [], 0
    for file, block, first, n in before:
        starts.append((file, block, at - first))
        at += n
    offsets = spark.createDataFrame(starts, "file string, block long, shift long")
    return lines.join(F.broadcast(offsets), ["file", "block"]).select((F.col("id") + F.col("shift") + 1).alias("row_number"), "line")


def evidence_id(version: str, row_number: Column) -> Column:
    """Which row of which version of a data set."""
    return F.concat(F.lit("rec:"), F.substring(F.sha2(F.concat_ws("|", F.lit(version), row_number.cast("string")), 256), 1, 16))


def fields(line: Column, delimiter: str) -> Column:
    """A line's fields; quoted ones may hold the delimiter and doubled quotes."""
    quoted = F.regexp_extract_all(F.concat(F.lit(delimiter), line), F.lit(rf'\{delimiter}("(?:[^"]|"")*"|[^\{delimiter}]*)'), F.lit(1))
    return F.transform(quoted, lambda f: F.when(f.startswith('"') & f.endswith('"') & (F.length(f) > 1), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f))


def records(lines: DataFrame, header: tuple[str, ...], delimiter: str, version: str, surplus: int = 2) -> DataFrame:
    """evidence_id, row_number, the header's columns, __surplus_1 ..., shape of
    numbered lines: shape is SHORT, LONG or FULL.  Fields that a short row lacks
    are empty; the last surplus column holds all that is left."""
    own = F.col("fields")
    rows = lines.select("row_number", fields(F.col("line"), delimiter).alias("fields"))
    n = len(header)
    named = [F.coalesce(F.get(own, i), F.lit("")).alias(c) for i, c in enumerate(header)]
    more = [F.get(own, n + i).alias(f"__surplus_{i + 1}") for i in range(surplus - 1)]
    last = F.when(F.size(own) >= n + surplus, F.array_join(F.slice(own, n + surplus, F.size(own)), delimiter)).alias(f"__surplus_{surplus}")
    shape = F.when(F.size(own) < n, "SHORT").when(F.size(own) > n, "LONG").otherwise("FULL").alias("shape")
    return rows.select(evidence_id(version, F.col("row_number")).alias("evidence_id"), "row_number", *named, *more, last, shape)


def pin(spark: SparkSession, path: str, encoding: str = "utf-8") -> dict:
    """Name, bytes and content hash of a file's lines, by which a later reader can
    tell that it reads the same: an order-free sum, so no task reads all."""
    size = spark.read.format("binaryFile").load(path).agg(F.sum("length")).first()[0]
    half = lambda at: F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("row_number").cast("string"), "line"), 256), at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    row = numbered(spark, path, encoding).agg(F.count("*").alias("rows"), F.concat_ws(":", half(1), half(16)).alias("content")).first()
    return {"schema": 1, "path": path.rsplit("/", 1)[-1], "bytes": size, "rows": row["rows"], "content": row["content"]}


def write_pin(spark: SparkSession, path: str, to: str) -> None:
    spark.createDataFrame([(json.dumps(pin(spark, path), sort_keys=True),)], "value string").coalesce(1).write.text(to)


def read_pin(spark: SparkSession, at: str) -> dict:
    return json.loads(spark.read.text(at).first()[0])


def write_layers(judged: DataFrame, to: str) -> None:
    """records, quarantine and ledger under one folder as JSON lines: judged rows
    have reasons (array<string>, empty for clean ones) beside their columns."""
    clean = F.size("reasons") == 0
    judged.where(clean).drop("reasons").write.json(f"{to}/records")
    judged.where(~clean).write.json(f"{to}/quarantine")
    ledger = judged.select(F.explode(F.when(clean, F.array(F.lit("CLEAN"))).otherwise(F.col("reasons"))).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))
    ledger.write.json(f"{to}/ledger")

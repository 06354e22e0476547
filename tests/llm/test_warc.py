import base64
import hashlib
import random

import duckdb
import pytest
from whence.llm import warc as W
from whence.llm.common import new_path


def test_arc_round_trip():
    for version in (1, 2):
        bodies = [b"", b"\n\nhttp://x 1 2 3 4\n", bytes(range(256)) * 3]
        data = W.arc_header("a.arc", version)
        for b in bodies:
            data += W.arc_record(version, W.safe_url("http://h/a b\n"), b, len(data), "a.arc", date="20050102")
        first, *rest = W.parse_arc(data)
        assert first.fields["URL"] == "filedesc://a.arc" and [r.content for r in rest] == bodies
        assert {r.fields["URL"] for r in rest} == {"http://h/a%20b%0A"}
        assert W.iso(rest[0].fields["Archive-date"]) == "2005-01-02T00:00:00Z"
        with pytest.raises(ValueError):
            list(W.parse_arc(data[:-1]))
    assert list(W.parse_arc(b"")) == []


PAGES = [
    (1, "http://a/ x", "same"), (2, None, "same"), (9, "", "same"), (3, "http://b", None), (4, "http://b", ""),
    (5, "http://c", "WARC/1.1\r\n\r\nx\r\n\r\n"), (6, "http://c", "é" * 300_000), (7, "u", "one\r\n\r\n"), (7, "u", "twice"), (7, "u", "twice"), (None, "u", "same"), (None, None, "alone"), (None, None, "alone"),
]


def expected(pages):
    out = []
    for k, _, h in pages:
        body = (h or "").encode()
        keys = [q for q, _, g in pages if (g or "") == (h or "") and q is not None]
        last = max(keys, default=None)
        ref = last if last is not None and last != k else None
        out.append((k, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if ref is None else "revisit", ref))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 5])
def test_query(spark, tmp_path, parts):
    df = spark.createDataFrame([(*p, "x", b"y") for p in PAGES], "page_id long, url string, html string, block string, key binary")
    df.repartition(parts).write.parquet(f"{tmp_path}/pages.parquet")
    assert sorted(map(tuple, W.op3_warc(spark, str(tmp_path)).collect()), key=str) == expected(PAGES)


def test_payloads_come_back(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    path = new_path(spark, "test")
    W.write_warc(W.with_revisits(W.arc_to_warc(W.arc_archives(df, per_archive=2))), path, records_per_file=3)
    rows = W.read_warc(spark, path).collect()
    got = {(r.key, bytes(r.payload)) for r in rows if r.record_type == "response"}
    assert got == {(k, (h or "").encode()) for k, _, h in PAGES} - {(k, b"same") for k in (1, 2, None)} - {(3, b"")}
    assert sum(r.record_type == "warcinfo" for r in rows) >= 7


def test_empty(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert W.op3_warc(spark, str(tmp_path)).collect() == []


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{d}/pages.parquet'")
    want = con.execute(W.OP3_SQL).fetchall()
    assert sorted(map(tuple, W.op3_warc(spark, d).collect())) == sorted(want)

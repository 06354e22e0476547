"""Raw files, mappings, and graphs without some of their events."""

import json
import random

import pytest
from pyspark.sql import functions as F
from whence.functions import mapping
from whence.functions.temporal import interval
from whence.operators import causal_graph, simulation
from whence.sources import delimited


def test_encodings():
    assert delimited.probe_encoding("é plain".encode()) == ("utf-8", ())
    assert delimited.probe_encoding("é".encode("cp1252") + b" x") == ("cp1252", (("utf-8", 0), ("utf-8-sig", 0)))
    assert delimited.probe_encoding(b"ab\x81c")[0] == "latin-1" and delimited.probe_encoding(b"ab\x81c")[1][2] == ("cp1252", 2)
    head, tail = "aé".encode()[:2] + b"zzz", "é tail".encode()[1:]  # letters cut at the window's ends
    assert delimited.probe_encoding(head[:2], tail)[0] == "utf-8"
    with pytest.raises(ValueError):
        delimited.probe_encoding(b"\xff", candidates=("utf-8",))


@pytest.mark.parametrize("encoding", ["utf-8", "utf-8-sig", "cp1252", "latin-1"])
def test_probe_and_read_in_other_encodings(spark, tmp_path, encoding):
    lines = ["näme;preis"] + [f"café{i};{i} {'€' if encoding != 'latin-1' else '£'} “ü”".replace("“", '"' if encoding == "latin-1" else "“").replace("”", "x") for i in range(300)]
    path = tmp_path / "in.csv"
    path.write_bytes("\n".join(lines).encode(encoding) + (b"\n\x81" if encoding == "latin-1" else b""))
    found = delimited.probe(spark, f"file://{path}")
    assert found.encoding == ("utf-8" if encoding == "utf-8-sig" else encoding) and found.header == ("näme", "preis")
    rows = delimited.numbered(spark, f"file://{path}", encoding).collect()
    assert [r.line for r in sorted(rows, key=lambda r: r.row_number)][: len(lines)] == lines
    back = spark.createDataFrame([(x,) for x in lines], "t string").select(delimited.encoded(F.col("t"), "cp1252").alias("b")).collect()
    assert encoding != "cp1252" or [bytes(r.b) for r in back] == [x.encode("cp1252") for x in lines]


def test_dialects():
    assert delimited.sniff("a;b;c\n1,5;2;3\n4;5,1;6\n") == ";"
    assert delimited.sniff("a\tb\n1\t2\n") == "\t" and delimited.sniff("a|b\n1|2\n") == "|"
    assert delimited.sniff("one\ntwo\n") == "," and delimited.sniff("") == ","


def test_lines_to_layers(spark, tmp_path):
    rng = random.Random(1)
    lines = ["id;name;day"] + [rng.choice(["{i};x;2024-01-02", "{i};short", "{i};a;2024-01-03;more;and;more", '{i};"q;""z""";never']).format(i=i) for i in range(500)]
    path = tmp_path / "in.csv"
    path.write_text("\n".join(lines))
    found = delimited.probe(spark, f"file://{path}")
    assert found == ("utf-8", (), ";", ("id", "name", "day"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        numbered = delimited.numbered(spark, f"file://{path}").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r.line for r in sorted(numbered, key=lambda r: r.row_number)] == lines
    assert sorted(r.row_number for r in numbered) == list(range(1, len(lines) + 1))
    rows = delimited.records(delimited.numbered(spark, f"file://{path}").where("row_number > 1"), found.header, ";", "v").collect()
    for r in rows:
        line = lines[r.row_number - 1]
        assert r["shape"] == ("SHORT" if "short" in line else "LONG" if "more" in line else "FULL")
        assert (r["__surplus_1"], r["__surplus_2"]) == (("more", "and;more") if "more" in line else (None, None))
        assert r["name"] == ('q;"z"' if "q" in line else line.split(";")[1]) and (r["day"] == "") == ("short" in line)
    assert len({r.evidence_id for r in rows}) == 500
    made = mapping.Mapping("thing", ("id",), (mapping.Field("kind", "name", ("TRIM",), {"x": 1, "a": 2}),), (("at", "day", "yyyy-MM-dd", "DAY"),))
    judged = mapping.apply(spark.createDataFrame(rows), made)
    delimited.write_layers(judged, f"file://{tmp_path}/layers")
    clean = [json.loads(x) for f in (tmp_path / "layers/records").glob("*.json") for x in f.read_text().splitlines()]
    bad = [json.loads(x) for f in (tmp_path / "layers/quarantine").glob("*.json") for x in f.read_text().splitlines()]
    ledger = {r["code"]: r["rows"] for f in (tmp_path / "layers/ledger").glob("*.json") for r in map(json.loads, f.read_text().splitlines())}
    assert len(clean) + len(bad) == 500 and ledger["CLEAN"] == len(clean)
    assert all(r["reasons"] for r in bad) and ledger["UNPARSED_at"] == sum("short" in x or "never" in x for x in lines)
    delimited.write_pin(spark, f"file://{path}", f"file://{tmp_path}/pin")
    assert delimited.read_pin(spark, f"file://{tmp_path}/pin") == delimited.pin(spark, f"file://{path}")
    path.write_text("\n".join([lines[0], lines[2], lines[1], *lines[3:]]))
    changed = lines[1].split(";", 1)[1] != lines[2].split(";", 1)[1] or lines[1] != lines[2]
    assert (delimited.read_pin(spark, f"file://{tmp_path}/pin")["content"] != delimited.pin(spark, f"file://{path}")["content"]) == changed


def test_times_of_occurrence(spark):
    df = spark.createDataFrame([("2024-01-01", "2024-01-05", 3), ("2024-01-05", "2024-01-01", None), (None, "2024-01-01", 1)], "a string, b string, n int")
    df = df.select(interval(F.col("a").cast("timestamp_ntz"), "DAY").alias("a"), interval(F.col("b").cast("timestamp_ntz"), "SECOND").alias("b"), "n")
    between = [r.x for r in df.select(mapping.bounded_between("a", "b").alias("x")).collect()]
    assert [(x.precision, x.provenance) for x in between] == [("DAY", "INFERRED"), ("UNKNOWN", "ASSUMED"), ("UNKNOWN", "ASSUMED")]
    assert (between[0].t_earliest.day, between[0].t_latest.day) == (1, 5)
    later = [r.x for r in df.select(mapping.offset_from("a", F.col("n")).alias("x")).collect()]
    assert [x.precision for x in later] == ["DAY", "UNKNOWN", "UNKNOWN"] and later[0].t_earliest.day == 4


def test_removal_spreads_through_chains_and_diamonds(spark):
    """1 -> 2, 3 -> 4 -> 5, and 6 -> 4 in one world only; 7 -> 8 -> 7 is a circuit fed by 1."""
    edges = [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (1, 7), (7, 8), (8, 7)]
    e = spark.createDataFrame([(w, a, b) for w in ("x", "y") for a, b in edges + [(6, 4)] * (w == "y")], "world string, source long, target long")
    removed = spark.createDataFrame([("x", "a", 1), ("y", "a", 1), ("x", "b", 2), ("y", "c", 2), ("y", "c", 3), ("y", "c", 6)], "world string, set_id string, node long")
    gone = {(r.world, r.set_id, r.node): r.round for r in simulation.eliminated(e, removed, ("world",)).collect()}
    assert gone == {("x", "a", 1): 0, ("x", "a", 2): 1, ("x", "a", 3): 1, ("x", "a", 4): 2, ("x", "a", 5): 3, ("y", "a", 1): 0, ("y", "a", 2): 1, ("y", "a", 3): 1, ("x", "b", 2): 0} | {
        ("y", "c", 2): 0, ("y", "c", 3): 0, ("y", "c", 6): 0, ("y", "c", 4): 1, ("y", "c", 5): 2}
    one = causal_graph.share_of_incoming(spark.createDataFrame([(*p, 1.0) for p in edges], "source long, target long, scalar double"))
    kept = {r.node: r.kept for r in simulation.simulated(one, spark.createDataFrame([("s", 2)], "set_id string, node long")).collect()}
    assert kept == {2: 0.0, 4: 0.5}  # half of the diamond stays, and nothing behind it is lost


def test_removal_goes_to_the_end_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(12)], "source long, target long")
    gone = {r.node: r.round for r in simulation.eliminated(e, spark.createDataFrame([("s", 0)], "set_id string, node long")).collect()}
    assert gone == {i: i for i in range(13)}


def test_chains_are_shortest_and_most_confident(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (2, 4, 0.5), (3, 4, 0.9), (4, 5, 0.5), (1, 5, 0.1)], "source long, target long, scalar double")
    c = {r.node: (r.distance, r.parent, round(r.confidence, 9)) for r in simulation.chains(e, spark.createDataFrame([(1,)], "node long"), 9).collect()}
    assert c == {2: (1, 1, 0.9), 3: (1, 1, 0.5), 4: (2, 2, 0.45), 5: (1, 1, 0.1)}
    assert simulation.chains(e.limit(0), spark.createDataFrame([(1,)], "node long"), 3).count() == 0

"""Column functions against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F
from whence.functions import identity, scoring, temporal, transforms
from whence.functions.conditions import compile_condition, compile_measurement
from whence.operators import candidates, causal_graph, profiling, rules, sequences

AT = "struct<t_earliest:timestamp_ntz,t_latest:timestamp_ntz,precision:string,provenance:string>"


def test_verdicts(spark):
    import datetime as dt

    t = lambda h: dt.datetime(2024, 1, 1, h)
    cases = [
        ((t(1), t(2), "HOUR", "OBSERVED"), (t(3), t(4), "HOUR", "OBSERVED"), "CERTAIN"),
        ((t(1), t(2), "HOUR", "INFERRED"), (t(3), t(4), "HOUR", "OBSERVED"), "UNDETERMINED"),
        ((t(1), t(3), "HOUR", "OBSERVED"), (t(2), t(4), "HOUR", "OBSERVED"), "UNDETERMINED"),
        ((t(4), t(5), "HOUR", "OBSERVED"), (t(2), t(4), "HOUR", "OBSERVED"), "VIOLATION"),
        ((t(4), t(5), "HOUR", "INFERRED"), (t(2), t(4), "HOUR", "OBSERVED"), "VIOLATION"),
        ((None, None, "UNKNOWN", "ASSUMED"), (t(2), t(4), "HOUR", "OBSERVED"), "UNDETERMINED"),
    ]
    df = spark.createDataFrame([(a, b, v) for a, b, v in cases], f"a {AT}, b {AT}, v string")
    low, high = temporal.separation("a", "b", clipped=True)
    for r in df.select(temporal.verdict("a", "b").alias("got"), "v", low.alias("low"), high.alias("high"), temporal.in_window(low, high, 0, 1, True).alias("fits"), "a").collect():
        assert r.got == r.v
        assert (r.low is None) == (r.a.precision == "UNKNOWN") and (r.low is None or 0 <= r.low <= r.high)
        assert r.low is not None or r.fits


def test_intervals_and_ranks(spark):
    import datetime as dt

    df = spark.createDataFrame([(dt.datetime(2024, 2, 3, 4, 5, 6, 7),), (None,)], "t timestamp_ntz")
    for precision, first in (("DAY", dt.datetime(2024, 2, 3)), ("HOUR", dt.datetime(2024, 2, 3, 4)), ("EXACT", dt.datetime(2024, 2, 3, 4, 5, 6, 7))):
        a, b = (r.x for r in df.select(temporal.interval(F.col("t"), precision).alias("x")).collect())
        assert a.t_earliest == first and a.precision == precision and b.precision == "UNKNOWN" and b.provenance == "ASSUMED" and b.t_earliest is None
    r = spark.range(1).select(temporal.coarser(F.lit("DAY"), F.lit("HOUR")), temporal.weakest(F.lit("OBSERVED"), F.lit("ASSUMED"))).first()
    assert tuple(r) == ("DAY", "ASSUMED")


def test_addresses(spark):
    import hashlib

    df = spark.createDataFrame([("a|b", None), ("a", "b"), ("x\\=,", "")], "p string, q string")
    for r in df.select("p", "q", identity.address("t", F.col("p"), F.col("q")).alias("a")).collect():
        esc = lambda s: (s or "").replace("\\", "\\\\").replace("|", "\\p").replace(",", "\\c").replace("=", "\\e")
        assert r.a == "t:" + hashlib.sha256(f"{esc(r.p)}|{esc(r.q)}".encode()).hexdigest()[:16]


def test_scores(spark):
    rng = random.Random(1)
    rows = [(rng.randint(0, 50), rng.random() * 5, rng.random(), rng.random()) for _ in range(50)] + [(0, None, 0.0, 1.0)]
    df = spark.createDataFrame(rows, "n int, lift double, t double, c double")
    sq = scoring.squashed(F.col("lift"), 3.0)
    sh = scoring.shrinkage(F.col("n"), 20)
    parts = dict.fromkeys(scoring.WEIGHTS, F.col("t"))
    for r in df.select("*", sq.alias("sq"), sh.alias("sh"), scoring.blend(sh, sq, 2 / 3).alias("b"), scoring.ceiling(F.col("t"), scoring.TEMPORAL_CEILING).alias("ceil"), scoring.gated_mean(parts, F.col("t"), F.col("c")).alias("g"), scoring.band(F.col("t"), (("HIGH", 0.7), ("LOW", 0.0))).alias("band")).collect():
        want = 0 if r.lift is None or r.lift <= 1 else min(1, math.log(r.lift) / math.log(3))
        assert r.sq == pytest.approx(want) and r.sh == pytest.approx(r.n / (r.n + 20))
        assert r.b == pytest.approx(0 if want == 0 or r.n == 0 else r.sh ** (2 / 3) * want ** (1 / 3))
        xs, ys = zip(*scoring.TEMPORAL_CEILING)
        i = max(k for k in range(len(xs) - 1) if xs[k] <= r.t)
        assert r.ceil == pytest.approx(ys[i] + (r.t - xs[i]) / (xs[i + 1] - xs[i]) * (ys[i + 1] - ys[i]))
        assert r.g <= r.ceil + 1e-12 and r.g <= r.t + 1e-12 and r.band == ("HIGH" if r.t >= 0.7 else "LOW")
    got = spark.createDataFrame([("0.1234565",), ("-0.0000005",), (None,)], "v string").select(scoring.shown(F.col("v"))).collect()
    assert [r[0] for r in got] == [0.123456, 0.0, None]


def test_conditions_are_two_valued(spark):
    df = spark.createDataFrame([("5", "x"), (None, "y"), ("z", None)], "a string, b string")
    ask = lambda c: [r[0] for r in df.select(compile_condition(c)).collect()]
    assert ask(("a", ">", 3)) == [True, False, False] and ask(("not", ("a", ">", 3))) == [False, True, True]
    assert ask(("all", ("exists", "a"), ("b", "in", ("x",)))) == [True, False, False]
    assert ask(("any", ("b", "=", "y"), ("a", "<=", 5))) == [True, True, False] and ask(("all",)) == [True] * 3
    measure = lambda m: [r[0] for r in df.select(compile_measurement(m)).collect()]
    assert measure(("sum", "a", 1)) == [6.0, None, None] and measure(("ratio", "a", 0)) == [None] * 3
    assert measure(("minimum", "a", 9)) == [5.0, None, None] and measure(("maximum", 1, ("product", "a", 2))) == [10.0, None, None]


def test_transforms(spark):
    df = spark.createDataFrame([(" a ",), ("",), (None,), ("7",), ("nan",), ("Yes",), ("é",)], "v string")
    run = lambda n: [r[0] for r in df.select(transforms.apply(n, F.col("v"))).collect()]
    assert run("TRIM")[0] == "a" and run("UPPERCASE")[0] == " A " and run("EMPTY_TO_NULL")[1:3] == [None, None]
    assert run("PARSE_INTEGER")[3] == 7 and run("PARSE_DECIMAL")[3:5] == [7.0, None] and run("BOOLEAN_FLAG")[5] is True
    assert run("NORMALIZE_UNICODE_NFC")[6] == "é" and run("NORMALIZE_UNICODE_NFC")[2] is None
    with pytest.raises(ValueError):
        transforms.apply("ROT13", F.col("v"))
    kinds = spark.createDataFrame([(v,) for v in ("", "no", "-12", "1.5e3", "2024-01-02", "2024-01-02 03:04:05", "abc", None)], "v string")
    assert [r[0] for r in kinds.select(transforms.classify(F.col("v"))).collect()] == ["EMPTY", "BOOLEAN", "INTEGER", "DECIMAL", "DATE", "DATETIME", "TEXT", "EMPTY"]


def test_empty_tables(spark):
    at = f"timeline_id string, user_id long, event_id long, event_type string, at {AT}, known {AT}, ts timestamp_ntz, value double, k long"
    none = spark.createDataFrame([], at)
    s = sequences.sequence(none)
    p = candidates.ordered_pairs(s)
    assert p.count() == 0 and candidates.shared_identifier(candidates.near_pairs(none, "user_id", 10), "k").count() == 0
    assert sequences.gaps(s, ("a", "b")).count() == 0 and sequences.replay(s, {("x", "a"): "y"}).count() == 0
    assert rules.firings(none, [rules.CausalRule("r", "a", "b", 10, 0.5)], "user_id").count() == 0
    assert profiling.column_profile(none.select("event_type", "value")).count() == 0
    e = spark.createDataFrame([], "source long, target long, scalar double")
    seeds = spark.createDataFrame([("s", 1)], "set_id string, node long")
    assert causal_graph.reach(e, seeds, 3).count() == 0 and causal_graph.share_of_incoming(e).count() == 0


def test_reach_and_walk_on_a_cycle(spark):
    e = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.9), (3, 1, 0.4), (1, 3, 0.2), (3, 4, 0.8)], "source long, target long, scalar double")
    seeds = spark.createDataFrame([("a", 1)], "set_id string, node long")
    assert {(r.node, r.distance) for r in causal_graph.reach(e, seeds, 9).collect()} == {(2, 1), (3, 1), (4, 2)}
    w = {r.node: (r.distance, r.routes, r.weight) for r in causal_graph.walk(e, seeds.select("node"), 3).collect()}
    assert w == {2: (1, 1, 0.5), 3: (1, 2, 0.5), 4: (2, 2, 0.5)}
    without = spark.createDataFrame([("a", 3)], "set_id string, node long")
    assert {r.node for r in causal_graph.reach(e, seeds, 9, without).collect()} == {2}
    t = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", "a"), ("d", "d")], "source_type string, target_type string")
    assert sorted(">".join(r.path) for r in causal_graph.circuits(t, 4).collect()) == ["a>b", "a>b>c", "d"]


def test_delimited_files(spark, tmp_path):
    from whence.sources import tables

    (tmp_path / "x.csv").write_bytes("a;b€\n1;café €\n2;\"x;\ny\"\n".encode("cp1252"))
    df = tables.read_delimited(spark, str(tmp_path / "x.csv"), ";", "cp1252", ["a", "b€"])
    assert [tuple(r) for r in df.collect()] == [("1", "café €"), ("2", "x;\ny")]
    with pytest.raises(ValueError):
        tables.read_delimited(spark, str(tmp_path / "x.csv"), ";", "cp1252", ["a"])
    for run in ("r1", "r2"):
        tables.write_run(df, str(tmp_path / "out"), run)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).groupBy("run_id").count().collect())) == [("r1", 2), ("r2", 2)]


def test_readings_of_a_changed_world(spark):
    from whence.functions import perturbation as P
    from whence.functions import scoring

    rows = [(10.0, 0.5, [0.25, 0.25], False), (10.0, 0.0, [1.0], False), (10.0, -1.0, [0.7, 0.7], False), (10.0, 2.0, [], True), (None, 1.0, [0.5], False), (8.0, 4.0, [-0.1], False)]
    df = spark.createDataFrame(rows, "r double, m double, removed array<double>, gone boolean")
    got = [tuple(x) for x in df.select(P.scaled(F.col("r"), F.col("m")), P.unscaled(F.col("r"), F.col("m")), P.surviving_share(F.col("removed")), P.transmitted(F.col("r"), F.col("removed"), F.col("gone"))).collect()]
    assert got == [(5.0, 20.0, 0.5, 5.0), (0.0, None, 0.0, 0.0), (None, None, None, None), (20.0, 5.0, 1.0, 0.0), (None, None, 0.5, None), (32.0, 2.0, None, None)]
    at = spark.createDataFrame([("2024-01-05",), (None,)], "t string").select(temporal.interval(F.col("t").cast("timestamp_ntz"), "DAY").alias("at"))
    a, b = at.select(P.shifted("at", F.lit(-3_600_000_000)).alias("x")).collect()
    assert (str(a.x.t_earliest), str(a.x.t_latest), a.x.precision, a.x.moved_us) == ("2024-01-04 23:00:00", "2024-01-05 22:59:59.999999", "DAY", -3_600_000_000)
    assert (b.x.t_earliest, b.x.precision, b.x.moved_us) == (None, "UNKNOWN", 0)
    parts = spark.createDataFrame([(0.5, None, 0.25), (None, None, None), (0.0, 1.0, 1.0)], "rule double, temporal double, evidence double")
    own = {c: F.col(c) for c in parts.columns}
    got = [tuple(x) for x in parts.select(F.round(scoring.weighted_mean(own), 9), scoring.minimum(own)).collect()]
    assert got == [(round((0.5 * 0.25 + 0.25 * 0.15) / 0.4, 9), 0.25), (None, None), (round(0.35 / 0.6, 9), 0.0)]

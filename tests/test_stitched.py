import datetime
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F
from whence.operators import machines, sequences
from whence.operators.stitched import bucket_of, stitched
from whence.plans.timelines import MACHINE


def log(spark, n, users, seed=1):
    """Most rows are one user's; some have no time, some times come twice."""
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        user = 0 if rng.random() < 0.7 else rng.choice([*range(1, users), None])
        ts = None if rng.random() < 0.01 else start + datetime.timedelta(seconds=rng.randint(0, n * 40) // 50 * 50)
        rows.append((i, user, ts, rng.choice(["view", "click", "purchase", "error", None]), rng.choice([None, *range(50)])))
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp_ntz, event_type string, value long")


def test_against_plain_windows(spark):
    df = log(spark, 4000, 9)
    got = stitched(df, "user_id", ["ts", "event_id"], bucket_of(F.col("ts")), "position", {"was": "event_type", "was_at": "ts"}, {"next": "value"}, {"most": "value"})
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    want = df.withColumns({"position": F.row_number().over(w) - 1, "was": F.lag("event_type").over(w), "was_at": F.lag("ts").over(w), "next": F.lead("value").over(w), "most": F.max("value").over(w.rowsBetween(Window.unboundedPreceding, -1))})
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_a_hot_key_is_in_many_tasks(spark):
    df = log(spark, 6000, 3)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        for rows in (
            stitched(df, "user_id", ["ts", "event_id"], bucket_of(F.col("ts")), "position"),
            sequences.sequence(df.withColumn("at", F.struct(F.col("ts").alias("t_earliest"), F.col("ts").alias("t_latest"), F.lit("EXACT").alias("precision"), F.lit("OBSERVED").alias("provenance"))), "user_id"),
        ):
            each = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
            assert sum(each) == 6000 and max(each) < 1200  # the hot user has some 4200
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def fold(types, transitions):
    """The machine, event by event."""
    first = {}
    for (_, trigger), to in sorted(transitions.items()):
        first.setdefault(trigger, to)
    state, out = None, []
    for i, t in enumerate(types):
        if t not in first or state == "!":
            continue
        to = first[t] if state is None else transitions.get((state, t), "!")
        out.append((i, state, None if to == "!" else to, to == "!"))
        state = to
    return out


@pytest.mark.parametrize("block", [2, 3, 32])
def test_machine_against_the_fold(spark, monkeypatch, block):
    monkeypatch.setattr(machines, "BLOCK", block)
    monkeypatch.setattr(sequences, "PLACED", 7)
    rng = random.Random(block)
    states = "abcd"
    for transitions in (MACHINE, {(s, t): rng.choice(states) for s in states for t in ("view", "click", "purchase") if rng.random() < 0.95}):
        lines = {k: [rng.choice(["view", "view", "view", "click", "purchase", "error"]) for _ in range(rng.choice([0, 1, 5, 40, 200]))] for k in range(12)}
        rows = [(str(k), i, i * 10 + k, t) for k, ts in lines.items() for i, t in enumerate(ts)]
        df = spark.createDataFrame(rows, "timeline_id string, position long, event_id long, event_type string").withColumn("at", F.struct(F.lit(None).cast("timestamp_ntz").alias("t_earliest")))
        got = sequences.replay(df, transitions).collect()
        want = [(str(k), *r) for k, ts in lines.items() for r in fold(ts, transitions)]
        assert sorted(((r.timeline_id, r.position, r.from_state, r.to_state, r.illegal) for r in got), key=repr) == sorted(want, key=repr)


def test_a_million_events_of_one_timeline(spark):
    """A cycle of three types that is never illegal, so that every event is taken; no Python worker."""
    cycle = {("a", "x"): "b", ("b", "y"): "c", ("c", "z"): "a"}
    df = spark.range(1_000_000, numPartitions=4).select(F.lit("t").alias("timeline_id"), F.col("id").alias("event_id"), F.col("id").alias("position"), F.element_at(F.array(F.lit("x"), F.lit("y"), F.lit("z")), (F.col("id") % 3 + 1).cast("int")).alias("event_type"), F.struct(F.lit(None).cast("timestamp_ntz").alias("t_earliest")).alias("at"))
    got = sequences.replay(df, cycle)
    assert "Python" not in got._jdf.queryExecution().toString() and "Arrow" not in got._jdf.queryExecution().toString()
    (r,) = got.agg(F.count("*").alias("n"), F.count_if("illegal").alias("bad"), F.count_if(F.col("to_state") == F.element_at(F.array(F.lit("b"), F.lit("c"), F.lit("a")), (F.col("position") % 3 + 1).cast("int"))).alias("right")).collect()
    assert (r.n, r.bad, r.right) == (1_000_000, 0, 1_000_000)

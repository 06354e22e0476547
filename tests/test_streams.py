"""Streams whose files come in any order give what the whole log gives."""

import datetime
import random

from pyspark.sql import functions as F
from whence.plans.timelines import MACHINE
from whence.streaming import events


def test_order_of_files_changes_nothing(spark, tmp_path):
    log = spark.read.parquet("/root/testdata/sf0.001/events.parquet").where("ts < timestamp_ntz '2024-01-04 00:00:00'").orderBy("ts").toPandas()
    rng = random.Random(1)
    results, counts = [], []
    for n in range(2):
        parts = list(range(4))
        rng.shuffle(parts)
        for k, p in enumerate(parts):  # a part's rows lie between those of the others
            own = log.iloc[p::4] if n else log.iloc[p * len(log) // 4 : (p + 1) * len(log) // 4]
            spark.createDataFrame(own).withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/{n}/events.parquet")
        s = events.read_log(spark, f"file://{tmp_path}/{n}/events.parquet", 1)
        rows = events.run_to_table(events.replay_stream(s, MACHINE, "30 days"), f"file://{tmp_path}", "append")
        results.append(sorted(map(tuple, events.latest(rows, ["timeline_id"], "version", ["event_id", "from_state", "to_state", "illegal"]).collect()), key=str))
        rows = events.run_to_table(events.window_counts(s, lateness="30 days"), f"file://{tmp_path}", "update")
        counts.append(sorted(map(tuple, events.latest(rows, ["start", "event_type"], "batch", ["n"]).collect()), key=str))
    assert results[0] == results[1] and results[0]
    assert counts[0] == counts[1] and sum(c[2] for c in counts[0]) == len(log)


def deal(spark, rows, path, seed):
    """rows in files whose order has nothing to do with their times, some rows in two files."""
    rng = random.Random(seed)
    rows = rows + rng.sample(rows, len(rows) // 3)
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)


def test_once_and_joined_in_any_order_and_after_a_restart(spark, tmp_path):
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    rows = [(i, rng.randrange(5), rng.choice(["click", "purchase", "view"]), start + datetime.timedelta(minutes=rng.randrange(3000))) for i in range(200)]
    gap = lambda a, b: (b[3] - a[3]).total_seconds()
    pairs = sorted((a[0], b[0]) for a in rows for b in rows if a[1] == b[1] and a[2] == "click" and b[2] == "purchase" and 0 < gap(a, b) <= 7200)
    assert pairs
    for seed in (1, 2):
        path = f"file://{tmp_path}/{seed}/events.parquet"
        deal(spark, rows, path, seed)
        where = f"file://{tmp_path}/once-{seed}"
        events.run_to_table(events.once(events.read_log(spark, path, 1), ["event_id"], "30 days"), "", "append", where)
        late = [(1000 + i, 9, "view", start) for i in range(5)] + rows[:50]  # more comes, and much of it again
        spark.createDataFrame(late, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
        got = events.run_to_table(events.once(events.read_log(spark, path, 1), ["event_id"], "30 days"), "", "append", where)
        assert sorted(r.event_id for r in got.collect()) == sorted([r[0] for r in rows] + [1000 + i for i in range(5)])
        plain = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz")
        plain.repartition(4).write.parquet(f"file://{tmp_path}/{seed}/plain.parquet")
        s = events.read_log(spark, f"file://{tmp_path}/{seed}/plain.parquet", 1)
        met = events.run_to_table(events.joined(s.where("event_type = 'click'"), s.where("event_type = 'purchase'"), "user_id", "2 HOURS", "30 days"), f"file://{tmp_path}", "append")
        assert sorted((r.source, r.target) for r in met.collect()) == pairs


def test_users_of_one_state_keep_their_own_days_and_versions(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(10 * u + i, u, t, start + datetime.timedelta(hours=i)) for u in range(20) for i, t in enumerate(("view", "view", "click"))]
    path, where = f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    put = lambda r: spark.createDataFrame(r, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.mode("append").parquet(path)
    told = []
    for more in (rows, [(9999, 3, "purchase", start + datetime.timedelta(hours=5))]):
        put(more)
        told = events.run_to_table(events.replay_stream(events.read_log(spark, path), MACHINE, "30 days", 1), "", "append", where).collect()
    assert {r.timeline_id for r in told if r.version == 2} == {"3@2024-01-01"}  # only who has new events comes again
    ids = [r.event_id for r in sorted(told, key=lambda r: r.event_id) if r.version == 2]
    assert ids == [30, 31, 32, 9999]
    assert sorted(r.event_id for r in told if r.version == 1) == sorted(r[0] for r in rows)


def test_a_state_is_called_for_many_users(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    rows = [(u, u, "view", start) for u in range(2000)]
    path, where = f"file://{tmp_path}/events.parquet", f"file://{tmp_path}/run"
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, ts timestamp_ntz").coalesce(1).write.parquet(path)
    got = events.run_to_table(events.replay_stream(events.read_log(spark, path), MACHINE), "", "append", where)
    assert got.count() == 2000
    state = spark.read.format("statestore").load(f"{where}/progress")
    assert state.count() <= 256

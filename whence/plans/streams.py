"""Queries that run the log through Structured Streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..shared import shared_dir
from ..streaming import events
from .common import query
from .timelines import _REPLAY, MACHINE


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_window_counts(spark, d):
    """Hourly counts by a watermarked window: of each window its last update."""
    s = events.window_counts(events.read_log(spark, f"{d}/events.parquet"))
    rows = events.latest(events.run_to_table(s, shared_dir(spark), "update"), ["start", "event_type"], "batch", ["n"])
    return rows.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(_REPLAY + "SELECT timeline_id, event_id, event_type, was AS from_state, nullif(state, '!') AS to_state, state = '!' AS illegal FROM m")
def stream_state_replay(spark, d):
    """The state machine of timelines.state_replay, kept in a stream's state: of each day its last version."""
    rows = events.run_to_table(events.replay_stream(events.read_log(spark, f"{d}/events.parquet"), MACHINE), shared_dir(spark), "append")
    return events.latest(rows, ["timeline_id"], "version", ["event_id", "event_type", "from_state", "to_state", "illegal"])


@query("SELECT event_id, user_id, event_type, value FROM events")
def stream_occurrences(spark, d):
    """A log that is delivered twice, as a stream: each event once."""
    path = f"{d}/events.parquet"
    twice = events.read_log(spark, path).union(events.read_log(spark, path))
    return events.run_to_table(events.once(twice, ["event_id"], "60 days"), shared_dir(spark), "append").select("event_id", "user_id", "event_type", "value")


@query("""SELECT a.event_id AS source, b.event_id AS target, user_id, epoch_us(b.ts) - epoch_us(a.ts) AS gap_us FROM events a JOIN events b USING (user_id)
  WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOURS""")
def stream_click_purchases(spark, d):
    """Purchases within twelve hours of a click, joined as two streams."""
    path = f"{d}/events.parquet"
    clicks, bought = events.read_log(spark, path).where("event_type = 'click'"), events.read_log(spark, path).where("event_type = 'purchase'")
    return events.run_to_table(events.joined(clicks, bought, "user_id", "12 HOURS", "60 days"), shared_dir(spark), "append").drop("batch")

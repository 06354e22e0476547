"""Queries on timelines: order, violations, gaps, states, durations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal
from ..operators import sequences
from ..operators.stitched import bucket_of, stitched
from ..sources import tables
from .common import LOG, STEPS, query, sequenced

#: A small machine: what a user's day goes through.
MACHINE = {("idle", "view"): "browsing", ("browsing", "click"): "engaged", ("browsing", "view"): "browsing", ("engaged", "view"): "browsing", ("engaged", "click"): "engaged", ("engaged", "purchase"): "bought", ("bought", "view"): "browsing"}
_STEP = "CASE event_type " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(STEPS)) + " END"
_TO = "CASE " + " ".join(f"WHEN m.state = '{s}' AND x.event_type = '{t}' THEN '{to}'" for (s, t), to in MACHINE.items()) + " ELSE '!' END"
_FIRST: dict[str, str] = {}
for (_, _t), _s in sorted(MACHINE.items()):
    _FIRST.setdefault(_t, _s)
_REPLAY = (
    "WITH RECURSIVE "
    + LOG
    + f""", x AS (SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY position) AS i FROM seq
  WHERE event_type IN ({", ".join(f"'{t}'" for t in _FIRST)})),
m AS (SELECT timeline_id, event_id, event_type, position, ts, i, NULL::VARCHAR AS was,
  CASE event_type {" ".join(f"WHEN '{t}' THEN '{s}'" for t, s in _FIRST.items())} END AS state FROM x WHERE i = 1
  UNION ALL SELECT x.timeline_id, x.event_id, x.event_type, x.position, x.ts, x.i, m.state, {_TO} FROM m
  JOIN x ON x.timeline_id = m.timeline_id AND x.i = m.i + 1 WHERE m.state <> '!')"""
)


@query("WITH " + LOG + """, k AS (SELECT timeline_id, event_id, lo, hi, row_number() OVER w - 1 AS position, lag(hi) OVER w AS before FROM log
  WINDOW w AS (PARTITION BY timeline_id ORDER BY lo, hi, event_id))
SELECT timeline_id, event_id, position, CASE WHEN before IS NULL OR before < lo THEN 'OBSERVED' ELSE 'ASSUMED' END AS provenance FROM k""")
def timeline_sequence(spark, d):
    """Every log event's place in its user's day by the interval in which it is known
    to lie; where what came before may have come after, the place is assumed."""
    return sequences.sequence(tables.log_events(spark, d), at="known").select("timeline_id", "event_id", "position", "provenance")


@query("WITH " + LOG + f", s AS (SELECT *, {_STEP} AS step, lead(event_type) OVER w AS next_type, lead({_STEP}) OVER w AS next_step FROM seq WINDOW w AS (PARTITION BY timeline_id ORDER BY position)) SELECT timeline_id, event_id, event_type, next_type, position FROM s WHERE next_step < step AND event_type <> 'view' AND next_type <> 'view'")
def sequence_violations(spark, d):
    return sequences.violations(sequenced(spark, d), STEPS, ("view",))


@query(
    "WITH "
    + LOG
    + f""", t AS (SELECT DISTINCT timeline_id FROM seq), r AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(STEPS))}) v(i,
  expected_type)),
p AS (SELECT timeline_id, {_STEP} AS i, min(position) AS p FROM seq WHERE {_STEP} IS NOT NULL GROUP BY 1, 2)
SELECT t.timeline_id, r.expected_type, (SELECT min(p.p) FROM p WHERE p.timeline_id = t.timeline_id AND p.i > r.i) AS before_position
FROM t, r WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.timeline_id = t.timeline_id AND p.i = r.i)"""
)
def timeline_gaps(spark, d):
    return sequences.gaps(sequenced(spark, d), STEPS)


@query("WITH " + LOG + f"SELECT timeline_id, count(DISTINCT event_type) FILTER (event_type IN {STEPS}) AS matched, 4::BIGINT AS required, count(DISTINCT event_type) FILTER (event_type IN {STEPS}) / 4 AS score FROM seq GROUP BY 1")
def conformance(spark, d):
    return sequences.conformance(sequenced(spark, d), STEPS)


@query(_REPLAY + "SELECT timeline_id, event_id, event_type, position, was AS from_state, nullif(state, '!') AS to_state, state = '!' AS illegal FROM m")
def state_replay(spark, d):
    return sequences.replay(sequenced(spark, d), MACHINE).drop("entered")


@query(_REPLAY + "SELECT timeline_id, state, ts AS entered, lead(ts) OVER (PARTITION BY timeline_id ORDER BY position) AS left FROM m WHERE state <> '!'")
def state_intervals(spark, d):
    return sequences.state_intervals(sequences.replay(sequenced(spark, d), MACHINE))


@query(_REPLAY + """, h AS (SELECT timeline_id, state, ts AS entered, lead(ts) OVER (PARTITION BY timeline_id ORDER BY position) AS l FROM m
  WHERE state <> '!')
SELECT state, count(*) AS timelines FROM h WHERE entered <= TIMESTAMP '2024-01-15 12:00:00' AND (l IS NULL OR TIMESTAMP '2024-01-15 12:00:00' < l)
  GROUP BY 1""")
def state_as_of(spark, d):
    """How many timelines are in each state at an instant."""
    held = sequences.holding_at(sequences.state_intervals(sequences.replay(sequenced(spark, d), MACHINE)), F.lit("2024-01-15 12:00:00").cast("timestamp_ntz"))
    return held.groupBy("state").agg(F.count("*").alias("timelines"))


@query("WITH " + LOG + ", b AS (SELECT timeline_id, min(us) FILTER (event_type = 'view') AS a, min(us) FILTER (event_type = 'purchase') AS b FROM seq GROUP BY 1) SELECT count(*) AS n, min(b - a) AS least, max(b - a) AS greatest, round(avg((b - a) / 1000000), 3) AS mean_seconds FROM b WHERE a IS NOT NULL AND b IS NOT NULL")
def duration_stats(spark, d):
    """From a day's first view to its first purchase."""
    us = F.col("micros")
    return sequences.durations(sequenced(spark, d), "view", "purchase").agg(F.count("*").alias("n"), F.min(us).alias("least"), F.max(us).alias("greatest"), F.round(F.avg(us / 1000000), 3).alias("mean_seconds"))


@query("WITH " + LOG + "SELECT timeline_id, user_id, event_id AS source, lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS target FROM log QUALIFY target IS NOT NULL")
def precedes_edges(spark, d):
    """Consecutive events of every user."""
    e = stitched(tables.log_events(spark, d).select("timeline_id", "user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], bucket_of(F.col("ts")), after={"target": "event_id"})
    return e.where("target is not null").select("timeline_id", "user_id", F.col("event_id").alias("source"), "target")


@query("SELECT date_trunc('hour', ts) AS bucket, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")
def time_buckets(spark, d):
    e = tables.table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("bucket"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("value"))


@query("""WITH e AS (SELECT o_orderkey AS entity_id, 'ORDER_PLACED' AS event_type, strftime(o_orderdate, '%Y-%m-%d') AS day, 'DAY' AS precision
  FROM orders
  UNION ALL SELECT l_orderkey, 'LINE_SHIPPED', strftime(l_shipdate, '%Y-%m-%d'), 'DAY' FROM lineitem
  UNION ALL SELECT l_orderkey, 'LINE_RETURNED', NULL, 'UNKNOWN' FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT o_orderkey, 'ORDER_FULFILLED', NULL, 'UNKNOWN' FROM orders WHERE o_orderstatus = 'F')
SELECT entity_id, event_type, day, precision, count(*) AS witnesses FROM e GROUP BY ALL""")
def occurrence_dedup(spark, d):
    """One occurrence per order, type and interval, with how many rows witness it."""
    e = tables.order_events(spark, d)
    day = F.date_format("at.t_earliest", "yyyy-MM-dd")
    return e.groupBy("entity_id", "event_type", day.alias("day"), F.col("at.precision").alias("precision")).agg(F.count("*").alias("witnesses"))


@query("""SELECT event_type, precision, provenance, count(*) AS n FROM (SELECT 'ORDER_PLACED' AS event_type, 'DAY' AS precision,
  'OBSERVED' AS provenance FROM orders
  UNION ALL SELECT 'LINE_SHIPPED', 'DAY', 'OBSERVED' FROM lineitem UNION ALL SELECT 'LINE_RETURNED', 'UNKNOWN', 'ASSUMED' FROM lineitem
  WHERE l_returnflag = 'R'
  UNION ALL SELECT 'ORDER_FULFILLED', 'UNKNOWN', 'ASSUMED' FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def event_tallies(spark, d):
    e = tables.order_events(spark, d)
    return e.groupBy("event_type", F.col("at.precision").alias("precision"), F.col("at.provenance").alias("provenance")).agg(F.count("*").alias("n"))


@query("""WITH e AS (SELECT o_orderkey AS id, 'ORDER_PLACED' AS t FROM orders UNION SELECT l_orderkey, 'LINE_SHIPPED' FROM lineitem UNION
  SELECT o_orderkey, 'ORDER_FULFILLED' FROM orders WHERE o_orderstatus = 'F'),
n AS (SELECT id, count(*) AS k FROM e GROUP BY 1) SELECT t AS step, count(*) AS present, (SELECT count(*) FROM orders) - count(*) AS missing FROM e
  WHERE id IN (SELECT o_orderkey FROM orders) GROUP BY 1""")
def process_coverage(spark, d):
    """Of each step of an order's process how many orders show it."""
    e = tables.order_events(spark, d).where("event_type <> 'LINE_RETURNED'").select("entity_id", "event_type").distinct()
    o = tables.table(spark, d, "orders")
    seen = e.join(o, F.col("entity_id") == F.col("o_orderkey"), "left_semi").groupBy(F.col("event_type").alias("step")).agg(F.count("*").alias("present"))
    return seen.crossJoin(F.broadcast(o.agg(F.count("*").alias("total")))).select("step", "present", (F.col("total") - F.col("present")).alias("missing"))


@query("""WITH j AS (SELECT o_orderstatus, epoch_us(date_trunc('day', o_orderdate)) AS a, epoch_us(date_trunc('day', l_shipdate)) AS b FROM orders
  JOIN lineitem ON o_orderkey = l_orderkey),
s AS (SELECT *, greatest(b - (a + 86399999999), 0) AS low, greatest(b + 86399999999 - a, 0) AS high, b - (a + 86399999999) AS raw FROM j)
SELECT o_orderstatus, count(*) AS pairs, count(*) FILTER (raw < 0) AS clipped,
  count(*) FILTER (high >= 86400000000 AND low <= 30 * 86400000000) AS in_window, min(raw) AS least, max(high) AS greatest FROM s GROUP BY 1""")
def separation_window(spark, d):
    """Separations of order and shipment, clipped and not, within a month or not."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    j = o.select("o_orderkey", "o_orderstatus", temporal.interval(F.col("o_orderdate"), "DAY").alias("a")).join(line.select("l_orderkey", temporal.interval(F.col("l_shipdate"), "DAY").alias("b")), F.col("o_orderkey") == F.col("l_orderkey"))
    low, high = temporal.separation("a", "b", clipped=True)
    raw, _ = temporal.separation("a", "b", clipped=False)
    fits = temporal.in_window(low, high, temporal.DAY_US, 30 * temporal.DAY_US, unknown_fits=False)
    return j.groupBy("o_orderstatus").agg(F.count("*").alias("pairs"), F.count_if(raw < 0).alias("clipped"), F.count_if(fits).alias("in_window"), F.min(raw).alias("least"), F.max(high).alias("greatest"))


@query("""WITH v AS (SELECT o_orderkey, CASE WHEN o_orderdate::DATE >= l_shipdate::DATE + 1 OR o_orderdate::DATE > l_shipdate::DATE THEN 'VIOLATION'
  WHEN o_orderdate::DATE < l_shipdate::DATE THEN 'CERTAIN' ELSE 'UNDETERMINED' END AS verdict,
  l_returnflag FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT verdict, l_returnflag, count(*) AS n FROM v GROUP BY 1, 2""")
def temporal_verdict(spark, d):
    """May the order have caused the shipment, at a day's precision?"""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    j = o.select("o_orderkey", temporal.interval(F.col("o_orderdate"), "DAY").alias("a")).join(line.select("l_orderkey", "l_returnflag", temporal.interval(F.col("l_shipdate"), "DAY").alias("b")), F.col("o_orderkey") == F.col("l_orderkey"))
    return j.groupBy(temporal.verdict("a", "b").alias("verdict"), "l_returnflag").agg(F.count("*").alias("n"))

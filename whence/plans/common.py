"""What the plans of this library share."""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from ..operators import candidates, sequences
from ..shared import one_graph
from ..sources import tables

#: (name -> plan) and (name -> SQL), filled by query().
QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Windows in which one type of event may follow another, in microseconds.
HOUR = 3_600_000_000
WINDOWS = {
    ("view", "click"): (0, 6 * HOUR),
    ("click", "purchase"): (0, 12 * HOUR),
    ("view", "purchase"): (HOUR, 24 * HOUR),
    ("error", "error"): (0, 8 * HOUR),
    ("signup", "view"): (0, 24 * HOUR),
}
STEPS = ("signup", "view", "click", "purchase")

#: The log in SQL: events in order within a user's day, and the interval [lo, hi] in which each is known to lie.
LOG = """
log AS (
  SELECT event_id, user_id || '@' || strftime(ts, '%Y-%m-%d') AS timeline_id, user_id, event_type, ts, epoch_us(ts) AS us, value,
    TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE event_type WHEN 'signup' THEN epoch_us(date_trunc('hour', ts)) WHEN 'error' THEN epoch_us(date_trunc('minute',
  ts)) ELSE epoch_us(ts) END AS lo,
    CASE event_type WHEN 'signup' THEN epoch_us(date_trunc('hour', ts)) + 3599999999 WHEN 'error' THEN epoch_us(date_trunc('minute', ts)) + 59999999
      ELSE epoch_us(ts) END AS hi FROM events
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY timeline_id ORDER BY ts, event_id) - 1 AS position FROM log
), pairs AS (
  SELECT a.timeline_id, a.event_id AS source, b.event_id AS target, a.event_type AS source_type, b.event_type AS target_type,
    a.us AS a_us, b.us AS b_us, a.k AS a_k, b.k AS b_k, a.value AS a_value, b.value AS b_value,
    CASE WHEN a.lo >= b.hi THEN 'VIOLATION' WHEN a.hi < b.lo THEN 'CERTAIN' ELSE 'UNDETERMINED' END AS verdict
  FROM seq a JOIN seq b ON a.timeline_id = b.timeline_id AND a.position < b.position
)
"""


def query(sql: str | None = None):
    def add(plan):
        @wraps(plan)
        def run(spark: SparkSession, d: str) -> DataFrame:
            with one_graph():
                return plan(spark, d)

        QUERIES[plan.__name__] = run
        if sql:
            SQL[plan.__name__] = sql
        return run

    return add


def sequenced(spark: SparkSession, d: str) -> DataFrame:
    return sequences.sequence(tables.log_events(spark, d))


def pairs(spark: SparkSession, d: str) -> DataFrame:
    return candidates.ordered_pairs(sequenced(spark, d))

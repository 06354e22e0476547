"""Queries on rules over events that are known to an hour, a minute or a day, or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.temporal import DAY_US
from ..operators import interval_rules, sequences
from ..shared import written
from ..sources import tables
from .common import HOUR, LOG, query, sequenced
from .timelines import _REPLAY, MACHINE

#: This library's own rules over the log; signups are known to the hour, errors to the minute.
RULES = (
    interval_rules.IntervalRule("VIEW_FROM_SIGNUP", "signup", "view", 0, 6 * HOUR, 0.5),
    interval_rules.IntervalRule("SIGNUP_FROM_VIEW", "view", "signup", 0, 3 * HOUR, 0.4, least_in=False),
    interval_rules.IntervalRule("ERROR_FROM_ERROR", "error", "error", 0, 8 * HOUR, 0.6, most_in=False),
    interval_rules.IntervalRule("ERROR_FROM_SIGNUP", "signup", "error", HOUR, 12 * HOUR, 0.3),
    interval_rules.IntervalRule("BUY_FROM_CLICK", "click", "purchase", 0, 12 * HOUR, 0.8, condition=("effect.value", ">", 20)),
)
CONSTRAINTS = (interval_rules.Constraint("bought", "error"),)
MODIFIERS = (interval_rules.Modifier("error", "BUY_FROM_CLICK", 0.5), interval_rules.Modifier("signup", "VIEW_FROM_SIGNUP", 1.5))
#: Over orders: placed and shipped on a day, returned and fulfilled at an unknown time.
ORDER_RULES = (
    interval_rules.IntervalRule("SHIPPED_FROM_PLACED", "ORDER_PLACED", "LINE_SHIPPED", 0, 30 * DAY_US, 0.9),
    interval_rules.IntervalRule("SHIPPED_LATE", "ORDER_PLACED", "LINE_SHIPPED", 60 * DAY_US, 200 * DAY_US, 0.4, least_in=False, most_in=False),
    interval_rules.IntervalRule("RETURNED_FROM_SHIPPED", "LINE_SHIPPED", "LINE_RETURNED", 0, 20 * DAY_US, 0.7),
    interval_rules.IntervalRule("FULFILLED_FROM_SHIPPED", "LINE_SHIPPED", "ORDER_FULFILLED", 0, 20 * DAY_US, 0.7),
)


def _fired_sql(rules: tuple[interval_rules.IntervalRule, ...], conditions: dict[str, str], unknown: str = "false") -> str:
    """fired, and refused pairs, of events(entity, event_id, event_type, lo, hi) by a join of all with all of an entity."""
    parts = []
    for r in rules:
        early = f"b.hi - a.lo {'>=' if r.least_in else '>'} {r.least_us}"
        late = f"b.lo - a.hi {'<=' if r.most_in else '<'} {r.most_us}"
        parts.append(f"""SELECT '{r.rule_id}' AS rule_id, a.entity, a.event_id AS source, b.event_id AS target, CASE WHEN NOT {unknown} THEN b.lo - a.hi END AS low,
    CASE WHEN NOT {unknown} THEN b.hi - a.lo END AS high, CASE WHEN {unknown} THEN 'UNDETERMINED' WHEN a.lo >= b.hi THEN 'VIOLATION' WHEN a.hi < b.lo
    THEN 'CERTAIN' ELSE 'UNDETERMINED' END AS verdict, {unknown} AS unverifiable, {r.strength}::DOUBLE AS strength,
    {unknown} OR ({early} AND {late}) AS inside FROM ev a JOIN ev b ON a.entity = b.entity WHERE a.event_type = '{r.cause_type}'
    AND b.event_type = '{r.effect_type}' AND a.event_id <> b.event_id{conditions.get(r.rule_id, '')}""")
    return "met AS (" + "\n  UNION ALL ".join(parts) + "),\nfired AS (SELECT * EXCLUDE inside FROM met WHERE verdict <> 'VIOLATION' AND inside)"


_EV = LOG + ", ev AS (SELECT user_id AS entity, event_id, event_type, lo, hi, value FROM log), "
_CONDITIONS = {"BUY_FROM_CLICK": " AND b.value > 20"}


@query("WITH " + _EV + _fired_sql(RULES, _CONDITIONS) + " SELECT rule_id, source, target, low, high, verdict FROM fired")
def rule_interval_firings(spark, d):
    """Every pair of a user's events whose possible separations overlap a rule's window."""
    e = tables.log_events(spark, d)
    return interval_rules.firings(e, RULES, "user_id").select("rule_id", "source", "target", "low", "high", "verdict")


def _stats_sql() -> str:
    bare = _fired_sql(RULES, {}).replace("met AS", "all_met AS").replace("fired AS", "all_fired AS").replace("FROM met WHERE", "FROM all_met WHERE")
    return (
        _REPLAY
        + ", ev AS (SELECT user_id AS entity, event_id, event_type, lo, hi, value FROM log), "
        + _fired_sql(RULES, _CONDITIONS)
        + ", "
        + bare
        + """, states AS (SELECT DISTINCT split_part(timeline_id, '@', 1)::BIGINT AS entity, state FROM m WHERE state <> '!'),
j AS (SELECT f.*, rule_id IN ('ERROR_FROM_ERROR', 'ERROR_FROM_SIGNUP') AND EXISTS (SELECT 1 FROM states s WHERE s.entity = f.entity AND state = 'bought')
  AS prohibited, (rule_id = 'BUY_FROM_CLICK' AND EXISTS (SELECT 1 FROM ev x WHERE x.entity = f.entity AND x.event_type = 'error')) OR
  rule_id = 'VIEW_FROM_SIGNUP' AS modified FROM fired f),
s AS (SELECT rule_id, count(*) AS firings, count(*) FILTER (verdict = 'CERTAIN') AS certain, count(*) FILTER (unverifiable) AS unverifiable,
  count(*) FILTER (prohibited) AS prohibited, count(*) FILTER (modified) AS modified FROM j GROUP BY 1),
r AS (SELECT rule_id, count(*) FILTER (verdict = 'VIOLATION') AS refused FROM all_met GROUP BY 1)
SELECT rule_id, coalesce(firings, 0) AS firings, coalesce(certain, 0) AS certain, coalesce(unverifiable, 0) AS unverifiable,
  coalesce(prohibited, 0) AS prohibited, coalesce(modified, 0) AS modified, refused FROM r LEFT JOIN s USING (rule_id)"""
    )


@query(_stats_sql())
def rule_interval_statistics(spark, d):
    """Of each rule: firings, certain ones, those that a state prohibits or another
    event modifies, and pairs whose order can't be."""
    e = written(tables.log_events(spark, d), "log")
    taken = sequences.replay(sequenced(spark, d), MACHINE).where("to_state is not null")
    states = taken.select(F.split_part("timeline_id", F.lit("@"), F.lit(1)).cast("long").alias("entity"), F.col("to_state").alias("state"))
    fired = interval_rules.firings(e, RULES, "user_id")
    return interval_rules.statistics(interval_rules.judged(fired, e, RULES, states, CONSTRAINTS, MODIFIERS, "user_id"), interval_rules.refused(e, RULES, "user_id"))


def _order_occurrences(spark, d) -> DataFrame:
    """What happened to an order, each occurrence once, however many rows witness it."""
    e = tables.order_events(spark, d)
    day = F.date_format("at.t_earliest", "yyyy-MM-dd")
    once = e.groupBy("entity_id", "event_type", day.alias("day")).agg(F.any_value("at").alias("known"))
    return once.select("entity_id", "event_type", F.concat_ws("|", "event_type", F.coalesce("day", F.lit("?"))).alias("event_id"), "known")


_ORDER_EV = """ev AS MATERIALIZED (SELECT DISTINCT entity, event_type, event_type || '|' || coalesce(strftime(day, '%Y-%m-%d'), '?') AS event_id,
  epoch_us(day::TIMESTAMP) AS lo, epoch_us(day::TIMESTAMP) + 86399999999 AS hi FROM (
  SELECT o_orderkey AS entity, 'ORDER_PLACED' AS event_type, o_orderdate::DATE AS day FROM orders UNION ALL SELECT l_orderkey, 'LINE_SHIPPED',
  l_shipdate::DATE FROM lineitem UNION ALL SELECT l_orderkey, 'LINE_RETURNED', NULL FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT o_orderkey, 'ORDER_FULFILLED', NULL FROM orders WHERE o_orderstatus = 'F')), """


@query(
    "WITH "
    + _ORDER_EV
    + _fired_sql(ORDER_RULES, {}, "(a.lo IS NULL OR b.lo IS NULL)")
    + """, s AS (SELECT rule_id, verdict, unverifiable, count(*) AS n, count(DISTINCT entity) AS orders, min(low) AS least, max(high) AS greatest FROM fired
  GROUP BY ALL) SELECT * FROM s"""
)
def order_interval_rules(spark, d):
    """Rules over what is known to a day or not at all: an unknown time fits every window, and is marked so."""
    fired = interval_rules.firings(_order_occurrences(spark, d), ORDER_RULES, "entity_id")
    return fired.groupBy("rule_id", "verdict", "unverifiable").agg(F.count("*").alias("n"), F.count_distinct("entity").alias("orders"), F.min("low").alias("least"), F.max("high").alias("greatest"))

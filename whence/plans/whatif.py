"""Queries on worlds in which something else is done: other times, fewest acts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import admission, cuts, retiming, rules, sequences, validity
from ..shared import written
from ..sources import tables
from .causes import _DECIDED, promoted
from .claims import RULES, narrow
from .common import HOUR, LOG, query, sequenced
from .common import STEPS as STEP_TYPES
from .timelines import _REPLAY, MACHINE

#: Declared changes: all events of a type that cause something, by so many microseconds.
SHIFTS = {"view": 2 * HOUR, "signup": -3 * HOUR, "click": HOUR // 2}
#: Promoted edges of a pair of types from which its delays count as measured.
MEASURED = 5
#: Rounds that the SQL writes out, more than these tables' chains have links.
LEVELS = 12


def _measured(spark, d) -> DataFrame:
    """source, target, low, high: promoted edges whose types' delays are measured, with the least and greatest of these."""
    e = promoted(spark, d).select("source", "target", "source_type", "target_type").distinct()
    at = narrow(spark, d).select("event_id", "lo", "hi")
    e = e.join(at.toDF("source", "a_lo", "a_hi"), "source").join(at.toDF("target", "b_lo", "b_hi"), "target")
    e = written(e.select("source", "target", "source_type", "target_type", (F.col("b_lo") - F.col("a_hi")).alias("least"), (F.col("b_hi") - F.col("a_lo")).alias("most")), "separations")
    # As many rows as there are pairs of types.
    delays = e.groupBy("source_type", "target_type").agg(F.count("*").alias("n"), F.min("least").alias("low"), F.max("most").alias("high")).where(F.col("n") >= MEASURED)
    return e.join(F.broadcast(delays), ["source_type", "target_type"]).select("source", "target", "low", "high", "source_type")


def _retiming_sql() -> str:
    sets = ", ".join(f"('{t}', {x})" for t, x in SHIFTS.items())
    out = f""", e AS MATERIALIZED (SELECT DISTINCT source, target, p.source_type, p.target_type, b.lo - a.hi AS least, b.hi - a.lo AS most
  FROM promoted p JOIN log a ON a.event_id = source JOIN log b ON b.event_id = target),
delays AS (SELECT source_type, target_type, min(least) AS low, max(most) AS high FROM e GROUP BY 1, 2 HAVING count(*) >= {MEASURED}),
links AS MATERIALIZED (SELECT source, target, low, high, source_type FROM e JOIN delays USING (source_type, target_type)),
moved AS MATERIALIZED (SELECT DISTINCT set_id, source AS node, shift FROM links JOIN (VALUES {sets}) s(set_id, shift) ON set_id = source_type),
reached AS (SELECT set_id, node FROM moved UNION SELECT set_id, target FROM reached JOIN links ON source = node),
affected AS MATERIALIZED (SELECT * FROM reached ANTI JOIN moved USING (set_id, node)),
into_ AS MATERIALIZED (SELECT a.set_id, target, source, low, high, o.node IS NOT NULL AS live, g.lo + coalesce(shift, 0) AS lo, g.hi + coalesce(shift,
  0) AS hi FROM affected a JOIN links ON target = a.node JOIN log g ON g.event_id = source
  LEFT JOIN affected o ON o.set_id = a.set_id AND o.node = source LEFT JOIN moved m ON m.set_id = a.set_id AND m.node = source),
time0 AS (SELECT set_id, node, NULL::BIGINT AS lo, NULL::BIGINT AS hi FROM affected)"""
    for k in range(1, LEVELS + 1):
        out += f""", time{k} AS MATERIALIZED (SELECT i.set_id, target AS node, max(CASE WHEN live THEN t.lo ELSE i.lo END + low) AS lo,
  min(CASE WHEN live THEN t.hi ELSE i.hi END + high) AS hi
  FROM into_ i LEFT JOIN time{k - 1} t ON t.set_id = i.set_id AND t.node = source GROUP BY 1, 2)"""
    return "WITH RECURSIVE " + _DECIDED + out + f"""
SELECT t.set_id, node, g.lo AS before_lo, g.hi AS before_hi, t.lo AS after_lo, t.hi AS after_hi, CASE WHEN t.lo IS NULL OR t.hi IS NULL THEN 'UNBOUNDED'
  WHEN t.lo > t.hi THEN 'CONFLICT' WHEN t.lo > g.hi THEN 'LATER' WHEN t.hi < g.lo THEN 'EARLIER' WHEN t.lo <= g.lo AND t.hi >= g.hi THEN 'HOLDS'
  ELSE 'NARROWED' END AS status FROM time{LEVELS} t JOIN log g ON g.event_id = node
UNION ALL SELECT set_id, node, lo, hi, lo + shift, hi + shift, 'SHIFTED' FROM moved JOIN log ON event_id = node"""


@query(_retiming_sql())
def simulate_retiming(spark, d):
    """When everything would happen if all views came two hours later, all signups
    three hours earlier, or all clicks half an hour later: moved along measured
    delays only."""
    return _retimed(spark, d, written(_measured(spark, d), "measured"))


def _retimed(spark, d, links: DataFrame) -> DataFrame:
    shift = F.create_map(*[F.lit(x) for kv in SHIFTS.items() for x in kv])
    moved = links.where(F.col("source_type").isin(*SHIFTS)).select(F.col("source_type").alias("set_id"), F.col("source").alias("node"), F.element_at(shift, F.col("source_type")).cast("long").alias("shift")).distinct()
    at = narrow(spark, d).select(F.col("event_id").alias("node"), "lo", "hi")
    return retiming.retimed(links.drop("source_type"), at, moved)


#: Largest set that one recommendation may ask for, and candidates up to which all sets are tried.
CAP, CEILING, STEPS = 3, 12, 3

_CUTS = """, e AS MATERIALIZED (SELECT DISTINCT source, target, source_type, target_type FROM promoted),
vocabulary AS (SELECT list(DISTINCT source_type ORDER BY source_type) AS names FROM e),
joint AS (SELECT count(*) > 0 AS found FROM (SELECT target FROM fired WHERE rule_id IN ('BUY_FROM_CLICK', 'BUY_FROM_VIEW') GROUP BY 1
  HAVING count(DISTINCT rule_id) = 2)),
picked AS (SELECT list_filter(names, lambda x, i: (m >> (i - 1)) & 1 = 1) AS raw FROM vocabulary, range(1, (1 << len(names))::BIGINT) r(m)),
sets AS MATERIALIZED (SELECT DISTINCT CASE WHEN found AND list_has_any(raw, ['click', 'view']) THEN list_sort(list_distinct(raw || ['click',
  'view'])) ELSE raw END AS members FROM picked, joint WHERE len(raw) <= {cap}),
seeds AS (SELECT DISTINCT source AS seed FROM e WHERE source_type IN ('signup', 'view')),
tries AS (SELECT []::VARCHAR[] AS members UNION ALL SELECT members FROM sets WHERE len(members) <= {cap}),
r AS (SELECT members, seed, seed AS node, 0 AS n FROM tries, seeds
  UNION SELECT members, r.seed, e.target, n + 1 FROM r JOIN e ON r.node = e.source AND NOT list_contains(members, e.source_type) WHERE n < {steps}),
x AS MATERIALIZED (SELECT DISTINCT members, seed, node FROM r JOIN log ON event_id = node WHERE event_type = 'purchase' AND n > 0 AND seed <> node),
whole AS (SELECT count(*) AS considered FROM x WHERE len(members) = 0), left_ AS (SELECT members, count(*) AS l FROM x GROUP BY 1),
worth AS (SELECT s.members, CASE WHEN len(s.members) <= {cap} THEN considered - coalesce(l, 0) END AS broken, considered FROM sets s CROSS JOIN whole LEFT
  JOIN left_ USING (members))
SELECT array_to_string(members, ',') AS members, len(members)::INTEGER AS size, broken, considered, CASE WHEN broken IS NULL THEN 'OVERSIZED'
  ELSE 'EXACT' END AS regime, CASE WHEN broken IS NOT NULL THEN NOT EXISTS (SELECT 1 FROM worth o WHERE o.broken >= w.broken AND len(o.members)
  < len(w.members) AND list_has_all(w.members, o.members)) END AS minimal FROM worth w"""


@query("WITH RECURSIVE " + _DECIDED + _CUTS.format(cap=CAP, steps=STEPS))
def minimum_cut_sets(spark, d):
    """Which types of events, taken together, cut purchases off from the views and
    signups that lead to them in three steps; what a joint rule needs together counts together."""
    e = written(promoted(spark, d).select("source", "target", "source_type").distinct(), "links")
    bits = cuts.numbered(e.select(F.col("source_type").alias("event_type")))
    seeds = e.where(F.col("source_type").isin("signup", "view")).select(F.col("source").alias("node")).distinct()
    bought = tables.table(spark, d, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("node"))
    routes = cuts.route_masks(e, seeds, bits, STEPS, bought)
    # A target of both rules: whether there is one needs neither the sources nor their order.
    joint = [r for r in RULES if r.rule_id in ("BUY_FROM_CLICK", "BUY_FROM_VIEW")]
    both = rules.firings(tables.log_events(spark, d), joint, "user_id").groupBy("target").agg(F.min("rule_id").alias("a"), F.max("rule_id").alias("b")).where("a <> b")
    groups = [] if both.isEmpty() else [[r.cause_type for r in joint]]
    return cuts.minimum_cut_sets(routes, bits, groups, CAP, CEILING)


#: Beyond what was seen by up to this share of its range, a gap is at its edge.
TOLERANCE = 0.1


def _validity_sql() -> str:
    moved_from = _retiming_sql().index(f"\nSELECT t.set_id, node, g.lo AS before_lo")
    return _retiming_sql()[:moved_from] + f""",
after AS MATERIALIZED (SELECT set_id, node, lo FROM time{LEVELS} UNION ALL SELECT set_id, node, lo + shift FROM moved JOIN log ON event_id = node),
gaps AS (SELECT p.source, p.target, p.source_type, p.target_type, max(p.scalar) AS belief, any_value(a.lo) AS a_lo, any_value(b.lo) AS b_lo FROM promoted p
  JOIN log a ON a.event_id = source JOIN log b ON b.event_id = target GROUP BY 1, 2, 3, 4),
seen AS (SELECT source_type, target_type, min(b_lo - a_lo) AS low, max(b_lo - a_lo) AS high, count(*) AS n FROM gaps GROUP BY 1, 2),
asked AS MATERIALIZED (SELECT k.set_id, g.source, g.target, belief, low, high, n, a.node IS NOT NULL AS from_moved, b.node IS NOT NULL AS into_moved,
  CASE WHEN b.node IS NULL THEN b_lo ELSE b.lo END - CASE WHEN a.node IS NULL THEN a_lo ELSE a.lo END AS gap
  FROM (SELECT DISTINCT set_id FROM moved) k CROSS JOIN gaps g JOIN seen USING (source_type, target_type)
  LEFT JOIN after a ON a.set_id = k.set_id AND a.node = source LEFT JOIN after b ON b.set_id = k.set_id AND b.node = target
  WHERE a.node IS NOT NULL OR b.node IS NOT NULL),
links2 AS MATERIALIZED (SELECT *, CASE WHEN n < {MEASURED} OR gap IS NULL THEN 3 WHEN greatest(low - gap, gap - high) <= 0 THEN 0
  WHEN greatest(low - gap, gap - high) <= {TOLERANCE} * (high - low) THEN 1 ELSE 2 END AS v FROM asked),
starts AS (SELECT set_id, node FROM after),
walked AS (SELECT set_id, node, 0 AS v, 1.0::DOUBLE AS p FROM starts UNION SELECT set_id, target, v, belief FROM links2 WHERE into_moved
  UNION SELECT w.set_id, l.target, greatest(w.v, l.v), least(w.p, l.belief) FROM walked w JOIN links2 l ON l.set_id = w.set_id AND l.source = w.node)
SELECT set_id, node, list_extract(['WITHIN', 'AT_EDGE', 'EXTRAPOLATION', 'NOT_ASSESSABLE'], max(v) + 1) AS verdict, round(min(p), 6) AS belief
  FROM walked GROUP BY 1, 2"""


@query(_validity_sql())
def world_validity(spark, d):
    """The retimed worlds beside what the data have shown: of every event that is
    moved or touched the weakest verdict on the gaps that led to it, and the least
    confidence on the way."""
    measured = written(_measured(spark, d), "measured")
    world = written(_retimed(spark, d, measured).select("set_id", "node", F.col("after_lo").alias("lo")), "world")
    base = tables.log_events(spark, d).select("event_id", F.unix_micros(F.col("known.t_earliest").cast("timestamp")).alias("lo"))
    e = promoted(spark, d).groupBy("source", "target", "source_type", "target_type").agg(F.max("scalar").alias("belief"))
    e = e.join(base.toDF("source", "a_lo"), "source").join(base.toDF("target", "b_lo"), "target")
    e = written(e.withColumn("was", F.col("b_lo") - F.col("a_lo")), "gaps")
    seen = e.groupBy("source_type", "target_type").agg(F.min("was").alias("low"), F.max("was").alias("high"), F.count("*").alias("seen"))
    e = e.join(F.broadcast(seen), ["source_type", "target_type"])
    # A link changes if either end does: from the side of its source, then from that of its target.
    at = world.select("set_id", "node", "lo", F.lit(True).alias("moved"))
    out = e.join(at.toDF("set_id", "source", "a_new", "a_moved"), "source").select("set_id", "source", "target")
    into = e.join(at.toDF("set_id", "target", "b_new", "b_moved"), "target").select("set_id", "source", "target")
    changed = out.union(into).distinct().join(e, ["source", "target"])
    changed = changed.join(at.toDF("set_id", "source", "a_new", "a_moved"), ["set_id", "source"], "left").join(at.toDF("set_id", "target", "b_new", "b_moved"), ["set_id", "target"], "left")
    gap = F.when(F.col("b_moved").isNull(), F.col("b_lo")).otherwise(F.col("b_new")) - F.when(F.col("a_moved").isNull(), F.col("a_lo")).otherwise(F.col("a_new"))
    links = changed.withColumn("verdict", validity.verdict(gap, F.col("low"), F.col("high"), F.col("seen"), MEASURED, TOLERANCE))
    return validity.carried(links, world).withColumn("belief", F.round("belief", 6))


#: Attributes that this library's own pack declares changeable.
CHANGEABLE = (admission.Changeable("purchase", "value", 0.0, 90.0), admission.Changeable("view", "k", 0.0, 99.0))
_LEGAL = ", ".join(f"('{a}', '{b}')" for a, b in sorted({(s, to) for (s, _), to in MACHINE.items()}))
_STEP_LIST = ", ".join(f"'{s}'" for s in STEP_TYPES)


@query(
    _REPLAY
    + ", "
    + _DECIDED.split(LOG, 1)[1].lstrip().lstrip(",")
    + f""", pe AS (SELECT DISTINCT source, target FROM promoted),
late AS (SELECT p.source AS target, bool_or(c.lo >= e.hi + {3 * HOUR}) OR bool_or(e.lo + {3 * HOUR} >= f.hi) AS late FROM pe p JOIN log e ON e.event_id = p.source
  LEFT JOIN (SELECT target, max(lo) AS lo FROM pe JOIN log ON event_id = source GROUP BY 1) c ON c.target = p.source
  LEFT JOIN (SELECT source, min(hi) AS hi FROM pe JOIN log ON event_id = target GROUP BY 1) f ON f.source = p.source GROUP BY 1),
t AS (SELECT DISTINCT timeline_id FROM seq), had AS (SELECT DISTINCT timeline_id, event_type FROM seq),
given AS (
  SELECT 'SHIFT_TIMING' AS kind, CASE WHEN coalesce(late, false) THEN 'WOULD_VIOLATE_LAW_TIME' END AS reason FROM late
  UNION ALL SELECT 'REMOVE_EVENT', CASE WHEN x.event_id IS NULL THEN 'UNKNOWN_TARGET' END FROM log a LEFT JOIN log x ON x.event_id = a.k * 150
  UNION ALL SELECT 'INSERT_EVENT', NULL FROM t, (SELECT unnest([{_STEP_LIST}]) AS s) WHERE NOT EXISTS (SELECT 1 FROM had h
    WHERE h.timeline_id = t.timeline_id AND h.event_type = s)
  UNION ALL SELECT 'INSERT_EVENT', 'STEP_NOT_ADMITTED_BY_PROCESS' FROM log WHERE event_type = 'error'
  UNION ALL SELECT 'CHANGE_ATTRIBUTE', CASE WHEN event_type = 'view' THEN 'ATTRIBUTE_NOT_DECLARED_CHANGEABLE' WHEN event_type <> 'purchase'
    THEN 'DECLARATION_ABSENT' WHEN value = ceil(value / 10) * 10 THEN 'CHANGES_NOTHING' WHEN ceil(value / 10) * 10 BETWEEN 0 AND 90 THEN NULL
    ELSE 'VALUE_OUTSIDE_DECLARED_BOUND' END FROM log
  UNION ALL SELECT 'CHANGE_ENTITY_STATE', CASE WHEN c_custkey IS NULL THEN 'UNKNOWN_TARGET' WHEN (state, 'bought') NOT IN ({_LEGAL})
    THEN 'TRANSITION_NOT_DECLARED' END FROM m LEFT JOIN customer ON c_custkey = split_part(timeline_id, '@', 1)::BIGINT WHERE state <> '!')
SELECT kind, coalesce(reason, 'ADMITTED') AS reason, count(*) AS n FROM given GROUP BY 1, 2"""
)
def change_admission(spark, d):
    """Five kinds of proposed changes, admitted or refused: causes moved by three hours,
    events named in other events' properties removed, missing steps inserted,
    values rounded up to tens, states turned into the last one."""
    log = written(tables.log_events(spark, d).withColumns({"lo": F.unix_micros(F.col("known.t_earliest").cast("timestamp")), "hi": F.unix_micros(F.col("known.t_latest").cast("timestamp"))}), "log")
    links = written(promoted(spark, d).select("source", "target").distinct(), "links")
    made = admission.proposal
    days = sequenced(spark, d)
    rounded = (F.ceil(F.col("value") / 10) * 10).cast("bigint").cast("string")
    taken = sequences.replay(days, MACHINE).where("not illegal")
    every = [
        made(links.select("source").distinct(), "SHIFT_TIMING", target=F.col("source"), shift=F.lit(3 * HOUR)),
        made(log, "REMOVE_EVENT", target=F.col("k") * 150),
        made(sequences.gaps(days, STEP_TYPES), "INSERT_EVENT", new_type=F.col("expected_type")),
        made(log.where("event_type = 'error'"), "INSERT_EVENT", target=F.col("event_id"), new_type=F.lit("error")),
        made(log, "CHANGE_ATTRIBUTE", target=F.col("event_id"), attribute=F.lit("value"), new_value=rounded),
        made(taken, "CHANGE_ENTITY_STATE", entity=F.split_part("timeline_id", F.lit("@"), F.lit(1)), from_state=F.col("to_state"), to_state=F.lit("bought")),
    ]
    customers = tables.table(spark, d, "customer").select(F.col("c_custkey").alias("entity"))
    turns = sorted({(s, to) for (s, _), to in MACHINE.items()})
    out = admission.admit(reduce(DataFrame.unionByName, every), log, links, customers, CHANGEABLE, STEP_TYPES, turns)
    return out.groupBy("kind", F.coalesce("reason", F.lit("ADMITTED")).alias("reason")).agg(F.count("*").alias("n"))

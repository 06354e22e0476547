"""Queries on how figures are put together: aggregators, magnitudes, floors of evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import perturbation, scoring
from ..operators import causal_graph, sequences, simulation
from ..sources import tables
from .causes import _SCORES, BANDS, FLOORS, scored
from .common import query
from .timelines import MACHINE, _REPLAY
from .worlds import _BENEFIT, _PAIRS, _WHOLE_TYPES, _type_sets, _values, gone_sql, pairs_of

#: Components other than zero that a candidate needs to be judged at all.
LEAST_COMPONENTS = 5
_OWN = {k: f"nullif({k}, 0)" if k == "rule" else k for k in scoring.MEAN_WEIGHTS}
_MEAN = " + ".join(f"coalesce({c}, 0) * {scoring.MEAN_WEIGHTS[k]}" for k, c in _OWN.items())
_TOTAL = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {scoring.MEAN_WEIGHTS[k]} END" for k, c in _OWN.items())


def _components() -> dict:
    return {k: F.nullif(F.col(k), F.lit(0.0)) if k == "rule" else F.col(k) for k in scoring.MEAN_WEIGHTS}


@query(
    "WITH "
    + _SCORES
    + f""", a AS (SELECT kind, round(({_MEAN}) / ({_TOTAL}), 6) AS mean, round(least({", ".join(_OWN.values())}), 6) AS lowest, round(scalar, 6) AS gated FROM graded)
SELECT kind, count(*) AS n, round(avg(mean), 4) AS weighted_mean, round(avg(lowest), 4) AS minimum, round(avg(gated), 4) AS gated,
  count(*) FILTER (gated > mean) AS above_mean, count(*) FILTER (gated < lowest) AS below_minimum FROM a GROUP BY 1"""
)
def aggregators(spark, d):
    """Three ways to put a candidate's components into one figure, side by side: a missing
    component abstains from the plain mean, and scores zero in the gated one."""
    own = _components()
    a = scored(spark, d).select("kind", F.round(scoring.weighted_mean(own), 6).alias("mean"), F.round(scoring.minimum(own), 6).alias("lowest"), F.round("scalar", 6).alias("gated"))
    means = [F.round(F.avg(c), 4).alias(n) for c, n in (("mean", "weighted_mean"), ("lowest", "minimum"), ("gated", "gated"))]
    return a.groupBy("kind").agg(F.count("*").alias("n"), *means, F.count_if(F.col("gated") > F.col("mean")).alias("above_mean"), F.count_if(F.col("gated") < F.col("lowest")).alias("below_minimum"))


@query(
    "WITH "
    + _PAIRS
    + _WHOLE_TYPES
    + gone_sql("removed")
    + _BENEFIT
    + """, m AS (SELECT set_id, round(value * (1 - kept), 6) AS lost FROM kept JOIN log ON event_id = node WHERE event_type = 'purchase')
SELECT set_id, count(*) AS consequences, round(sum(lost), 4) AS "sum", round(min(lost), 4) AS minimum, round(max(lost), 4) AS maximum FROM m GROUP BY 1"""
)
def prevented_magnitudes(spark, d):
    """What goes without each set of levers, one reading of each consequence, combined three ways."""
    e = pairs_of(spark, d)
    k = simulation.simulated(e.select("source", "target", "weight"), _type_sets(spark, e)).join(_values(spark, d), "node").where("event_type = 'purchase'")
    m = k.withColumn("lost", F.round(F.col("value") * (1 - F.col("kept")), 6))
    named = (("SUM", "sum"), ("MINIMUM", "minimum"), ("MAXIMUM", "maximum"))
    return m.groupBy("set_id").agg(F.count("*").alias("consequences"), *[F.round(perturbation.combined(F.col("lost"), o), 4).alias(n) for o, n in named])


@query(
    "WITH "
    + _SCORES
    + f""", g AS (SELECT *, (rule > 0)::INT + coalesce(historical > 0, false)::INT + coalesce(statistical > 0, false)::INT + (diversity > 0)::INT
  + (evidence > 0)::INT + (connectivity > 0)::INT AS held, round(scalar, 6) AS s FROM graded),
j AS (SELECT kind, s, held, CASE WHEN kind NOT IN ('DIRECT', 'CONDITIONAL') THEN 'NO_THRESHOLD' WHEN held < {LEAST_COMPONENTS} THEN 'INSUFFICIENT_EVIDENCE'
  WHEN verdict = 'VIOLATION' THEN 'TEMPORAL_MISMATCH' WHEN verdict <> 'CERTAIN' THEN 'NOT_CERTAIN'
  WHEN s < CASE kind WHEN 'DIRECT' THEN 0.142 ELSE 0.25 END THEN 'BELOW_THRESHOLD' ELSE 'PROMOTED' END AS decision FROM g)
SELECT kind, decision, CASE WHEN held < {LEAST_COMPONENTS} THEN NULL WHEN s >= 0.45 THEN 'STRONG' WHEN s >= 0.22 THEN 'SUGGESTIVE' ELSE 'WEAK' END AS band,
  count(*) AS n FROM j GROUP BY ALL"""
)
def promotion_with_floor(spark, d):
    """Decisions where a candidate needs five components other than zero: with fewer it has no band and isn't promoted."""
    parts = ("rule", "historical", "statistical", "diversity", "evidence", "connectivity")
    held = sum((F.coalesce(F.col(c) > 0, F.lit(False)).cast("int") for c in parts), F.lit(0))
    rows = scored(spark, d).withColumns({"n_generators": held, "scalar": F.round("scalar", 6)})
    out = causal_graph.promotion(rows, FLOORS, LEAST_COMPONENTS)
    band = F.when(F.col("n_generators") >= LEAST_COMPONENTS, scoring.band(F.col("scalar"), BANDS))
    return out.groupBy("kind", "decision", band.alias("band")).agg(F.count("*").alias("n"))


@query(
    """WITH l AS (SELECT l_returnflag, l_quantity AS reading, 1 - l_discount AS kept, l_discount * 10 AS factor, o_orderdate FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey)
SELECT l_returnflag, count(*) AS n, round(sum(reading * kept), 2) AS scaled, round(sum(CASE WHEN factor > 0 THEN reading / factor END), 2) AS unscaled,
  count(*) FILTER (factor <= 0) AS lost, round(sum(reading * greatest(1 - ((1 - kept) + 0.25), 0)), 2) AS transmitted,
  min(date_trunc('day', o_orderdate) + INTERVAL 90 MINUTE) AS earliest FROM l GROUP BY 1"""
)
def perturbed_lines(spark, d):
    """Quantities scaled by what a discount leaves, a scaling undone where it can be,
    the share that survives without two causes, and order days moved by ninety minutes."""
    from ..functions.temporal import interval

    line, o = tables.table(spark, d, "lineitem"), tables.table(spark, d, "orders")
    j = line.join(o.select(F.col("o_orderkey").alias("l_orderkey"), interval(F.col("o_orderdate"), "DAY").alias("at")), "l_orderkey")
    q, factor = F.col("l_quantity"), F.col("l_discount") * 10
    sums = {"scaled": perturbation.scaled(q, 1 - F.col("l_discount")), "unscaled": perturbation.unscaled(q, factor), "transmitted": perturbation.transmitted(q, F.array(F.col("l_discount"), F.lit(0.25)), F.lit(False))}
    moved = perturbation.shifted("at", F.lit(90 * 60_000_000))
    return j.groupBy("l_returnflag").agg(F.count("*").alias("n"), *[F.round(F.sum(c), 2).alias(n) for n, c in sums.items()], F.count_if(factor <= 0).alias("lost"), F.min(moved["t_earliest"]).alias("earliest"))


@query(
    _REPLAY
    + """, k AS (SELECT event_id, coalesce(lag(hi) OVER w >= lo, false) AS assumed FROM log WINDOW w AS (PARTITION BY timeline_id ORDER BY lo, hi, event_id)),
h AS (SELECT timeline_id, state, event_id, lead(event_id) OVER (PARTITION BY timeline_id ORDER BY position) AS next FROM m WHERE state <> '!')
SELECT state, count(*) AS intervals, count(*) FILTER (next IS NULL) AS open, count(*) FILTER (a.assumed OR coalesce(b.assumed, false)) AS uncertain
  FROM h JOIN k a USING (event_id) LEFT JOIN k b ON b.event_id = next GROUP BY 1"""
)
def uncertain_intervals(spark, d):
    """Of each state how many intervals begin or end with an event whose place in its day is assumed."""
    from ..operators.stitched import stitched
    from .common import sequenced

    taken = sequences.replay(sequenced(spark, d), MACHINE).where("not illegal")
    ends = stitched(taken, "timeline_id", ["position"], F.floor(F.col("position") / sequences.PLACED), after={"next": "event_id"})
    assumed = sequences.sequence(tables.log_events(spark, d), at="known").select("event_id", (F.col("provenance") == "ASSUMED").alias("assumed"))
    both = ends.select("event_id", "next", F.col("to_state").alias("state")).join(assumed, "event_id").join(assumed.toDF("next", "next_assumed"), "next", "left")
    return both.groupBy("state").agg(F.count("*").alias("intervals"), F.count_if(F.col("next").isNull()).alias("open"), F.count_if(F.col("assumed") | F.coalesce("next_assumed", F.lit(False))).alias("uncertain"))

"""Queries on causes: scores, the graph, what follows from it."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import causal_graph, order_statistics
from ..operators.candidates import Generator
from ..shared import kept
from ..sources import tables
from .claims import EDGES, LIFT, SHRINK, SQUASH, certain, gated
from .common import HOUR, LOG, pairs, query

#: Fixed value: generators at which a candidate's evidence counts for a half.
SATURATION = 3
#: Declared parameters of scoring and promotion, this library's own.
GENERATORS, WIDE_US = 7, 6 * HOUR
FLOORS = {"DIRECT": 0.142, "CONDITIONAL": 0.25}
BANDS = (("STRONG", 0.45), ("SUGGESTIVE", 0.22), ("WEAK", 0.0))
#: How much a contradiction of each kind takes from the freedom of contradictions.
REVERSED, BARRED = 0.5, 0.3


# -- scores ---------------------------------------------------------------

_SCORES = (
    EDGES
    + f""", l AS (SELECT cause_type, effect_type, {SHRINK} AS sh, {SQUASH} AS sq FROM rates), wl AS (SELECT cause_type, effect_type, {SHRINK} AS sh,
  {SQUASH} AS sq FROM weekly),
scored AS (
  SELECT m.*, CASE WHEN l.sq <= 0 THEN 0 ELSE pow(l.sh, 2.0/3) * pow(l.sq, 1.0/3) END AS historical, CASE WHEN wl.sq <= 0 THEN 0 ELSE pow(wl.sh,
  1.0/3) * pow(wl.sq, 2.0/3) END AS statistical,
    (n_generators - 1) / {GENERATORS - 1}.0 AS diversity, n_generators / (n_generators + {SATURATION}.0) AS evidence, pow(2.0, -hops) AS connectivity,
    CASE verdict WHEN 'CERTAIN' THEN 1 / (1 + (a.hi - a.lo + b.hi - b.lo) / {WIDE_US}.0) WHEN 'UNDETERMINED' THEN 0.15 ELSE 0.0 END AS temporal,
    1 / (1 + CASE WHEN o.source IS NULL THEN 0 ELSE {REVERSED} END + CASE WHEN barred.n IS NULL THEN 0 ELSE {BARRED} END) AS freedom
  FROM (SELECT * FROM merged WHERE reason IS NULL) m JOIN log a ON a.event_id = m.source JOIN log b ON b.event_id = m.target
    LEFT JOIN l ON source_type = l.cause_type AND target_type = l.effect_type LEFT
  JOIN wl ON source_type = wl.cause_type AND target_type = wl.effect_type
    LEFT JOIN (SELECT DISTINCT source, target FROM merged WHERE reason IS NULL) o ON o.source = m.target AND o.target = m.source
    LEFT JOIN (SELECT target, count(*) AS n FROM merged WHERE reason = 'CONSTRAINT_SUPPRESSED' GROUP BY 1) barred ON barred.target = m.target
), graded AS (
  SELECT *, least((0.28 * rule + 0.17 * coalesce(historical, 0) + 0.17 * coalesce(statistical,
  0) + 0.16 * diversity + 0.12 * evidence + 0.10 * connectivity) / 1.0,
    CASE WHEN temporal <= 0.3 THEN 0.25 + temporal / 0.3 * 0.3
  WHEN temporal <= 0.6 THEN 0.55 + (temporal - 0.3) / 0.3 * 0.25 ELSE 0.8 + (temporal - 0.6) / 0.4 * 0.2 END,
    CASE WHEN freedom <= 0.5 THEN 0.1 + freedom / 0.5 * 0.5 ELSE 0.6 + (freedom - 0.5) / 0.5 * 0.4 END) AS scalar FROM scored)"""
)


def scored(spark, d) -> DataFrame:
    """_scored(), written."""
    return kept("scored", d, lambda: _scored(spark, d))


def _scored(spark, d) -> DataFrame:
    """Candidates that passed the gate, with their components and the gated mean.

    Contradictions: the reverse is a candidate too, or the effect has a cause that
    a constraint bars."""
    every = gated(spark, d)
    m = every.where("reason is null")
    reverse = m.where("verdict = 'UNDETERMINED'")  # what is certain one way can't be the other way
    reverse = reverse.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit(REVERSED).alias("reversed")).distinct()
    barred = every.where("reason = 'CONSTRAINT_SUPPRESSED'").select("target", F.lit(BARRED).alias("barred")).distinct()
    return _graded(m.join(reverse, ["source", "target"], "left").join(barred, "target", "left"))


def promotable(spark, d) -> DataFrame:
    """The rows of scored() that can be promoted: of kinds that have a floor, in a
    certain order.  Such a pair's reverse is a violation, so it is no contradiction."""

    def build() -> DataFrame:
        cap = scoring.height(1 / (1 + BARRED), scoring.CONTRADICTION_CEILING)
        # A bar caps the confidence; where no candidate can reach the cap, whose effects are barred needn't be known.
        m, barred = certain(spark, d, FLOORS, lambda generators: max(_most(k, generators) for k in FLOORS) >= cap)
        if barred is None:
            m = m.withColumn("barred", F.lit(None).cast("double"))
        else:
            m = m.join(barred.withColumn("barred", F.lit(BARRED)), "target", "left")
        return _graded(m.withColumn("reversed", F.lit(None).cast("double")))

    return kept("promotable", d, build)


def _most(kind: str, generators: Sequence[Generator]) -> float:
    """No candidate of a kind has a higher mean: all its generators propose it and its types' rates score 1."""
    own = [g for g in generators if g.kind == kind]
    n = len({g.name for g in own})
    rule = 1 - math.prod(1 - g.strength for g in own if g.name == "rule_based")
    top = {"rule": rule, "historical": 1, "statistical": 1, "diversity": (n - 1) / (GENERATORS - 1), "evidence": n / (n + SATURATION), "connectivity": 1}
    return sum(top[k] * w for k, w in scoring.WEIGHTS.items()) / sum(scoring.WEIGHTS.values())


def _graded(rows: DataFrame) -> DataFrame:
    """Candidates with reversed and barred, graded."""
    sure = 1 / (1 + F.col("width") / float(WIDE_US))
    zero = F.lit(0.0)
    rows = rows.withColumns(
        {
            "diversity": (F.col("n_generators") - 1) / (GENERATORS - 1),
            "evidence": F.col("n_generators") / (F.col("n_generators") + SATURATION),
            "connectivity": F.pow(F.lit(2.0), -F.col("hops")),
            "temporal": F.when(F.col("verdict") == "CERTAIN", sure).when(F.col("verdict") == "UNDETERMINED", 0.15).otherwise(0.0),
            "freedom": 1 / (1 + F.coalesce("reversed", zero) + F.coalesce("barred", zero)),
        }
    )
    parts: dict[str, Column] = {k: F.col(k) for k in ("rule", "historical", "statistical", "diversity", "evidence", "connectivity")}
    rows = rows.withColumn("scalar", scoring.gated_mean(parts, F.col("temporal"), F.col("freedom")))
    return rows.drop("reversed", "barred", "width")


@query("WITH " + _SCORES + "SELECT source, target, kind, round(rule, 6) AS rule, round(coalesce(historical, 0), 6) AS historical, round(coalesce(statistical, 0), 6) AS statistical, round(diversity, 6) AS diversity, round(evidence, 6) AS evidence, round(connectivity, 6) AS connectivity, round(temporal, 6) AS temporal, round(freedom, 6) AS freedom, round(scalar, 6) AS scalar FROM graded")
def gated_confidence(spark, d):
    """Every candidate's components and gated confidence."""
    s = scored(spark, d)
    return s.select("source", "target", "kind", *[F.round(F.coalesce(c, F.lit(0.0)), 6).alias(c) for c in ("rule", "historical", "statistical", "diversity", "evidence", "connectivity", "temporal", "freedom", "scalar")])


_BAND = "CASE WHEN round(scalar, 6) >= 0.45 THEN 'STRONG' WHEN round(scalar, 6) >= 0.22 THEN 'SUGGESTIVE' ELSE 'WEAK' END"


@query("WITH " + _SCORES + f"SELECT {_BAND} AS band, kind, count(*) AS n, round(min(scalar), 6) AS least, round(max(scalar), 6) AS greatest FROM graded GROUP BY 1, 2")
def confidence_bands(spark, d):
    s = scored(spark, d)
    return s.groupBy(scoring.band(F.round("scalar", 6), BANDS).alias("band"), "kind").agg(F.count("*").alias("n"), F.round(F.min("scalar"), 6).alias("least"), F.round(F.max("scalar"), 6).alias("greatest"))


COMPONENTS = ("rule", "historical", "statistical", "diversity", "evidence", "connectivity", "temporal", "freedom")
_BINS = " || ',' || ".join(f"count(*) FILTER (value IS NOT NULL AND least(9, floor(value * 10)) = {i})" for i in range(10))


@query(
    "WITH "
    + _SCORES
    + f""", long AS (SELECT component, value FROM (SELECT {", ".join(f"round({c}::DOUBLE, 6) AS {c}" for c in COMPONENTS)} FROM graded)
  UNPIVOT INCLUDE NULLS (value FOR component IN ({", ".join(COMPONENTS)}))),
ordered AS (SELECT *, row_number() OVER (PARTITION BY component ORDER BY value) AS r, count(value) OVER (PARTITION BY component) AS known FROM long)
SELECT component, count(*) AS n, round(count(*) FILTER (value IS NULL) / count(*), 9) AS missing, min(value) AS least,
  avg(value) FILTER (r IN ((known + 1) // 2, known // 2 + 1)) AS median, max(value) AS greatest, round(avg(value), 5) AS mean,
  count(*) FILTER (value = 0) AS inert, {_BINS} AS bins FROM ordered GROUP BY 1"""
)
def component_tallies(spark, d):
    """Of each of the eight components: missing share, least, median, greatest, mean, how many are zero, and ten bins."""
    s = scored(spark, d).select(*[F.round(F.col(c).cast("double"), 6).alias(c) for c in COMPONENTS])
    told = order_statistics.summary(s.unpivot([], list(COMPONENTS), "group", "value"))
    return told.select(F.col("group").alias("component"), "n", F.round("missing", 9).alias("missing"), "least", "median", "greatest", F.round("mean", 5).alias("mean"), F.col("zeros").alias("inert"), "bins")


# -- the graph ------------------------------------------------------------

_DECIDED = _SCORES + """, decided AS (SELECT *, CASE WHEN kind NOT IN ('DIRECT', 'CONDITIONAL') THEN 'NO_THRESHOLD'
  WHEN n_generators < 1 THEN 'INSUFFICIENT_EVIDENCE' WHEN verdict = 'VIOLATION' THEN 'TEMPORAL_MISMATCH'
  WHEN verdict <> 'CERTAIN' THEN 'NOT_CERTAIN' WHEN round(scalar, 6) < CASE kind
  WHEN 'DIRECT' THEN 0.142 ELSE 0.25 END THEN 'BELOW_THRESHOLD' ELSE 'PROMOTED' END AS decision FROM graded),
promoted AS (SELECT source, target, source_type, target_type, timeline_id, kind, round(scalar, 6) AS scalar FROM decided JOIN log ON event_id = source
  WHERE decision = 'PROMOTED')"""


def decided(spark, d) -> DataFrame:
    return causal_graph.promotion(scored(spark, d).withColumn("scalar", F.round("scalar", 6)), FLOORS, 1)


def promoted(spark, d) -> DataFrame:
    """The promoted rows of decided(), of which nothing else is built."""
    return causal_graph.promotion(promotable(spark, d).withColumn("scalar", F.round("scalar", 6)), FLOORS, 1).where("decision = 'PROMOTED'")


@query("WITH " + _DECIDED + "SELECT decision, kind, count(*) AS n FROM decided GROUP BY 1, 2")
def promotion_ledger(spark, d):
    """Every candidate's decision; refused ones stay with their reason."""
    return decided(spark, d).groupBy("decision", "kind").agg(F.count("*").alias("n"))


@query("WITH " + _DECIDED + "SELECT source, target, kind, round(CASE WHEN sum(scalar) OVER w > 0 THEN scalar / sum(scalar) OVER w ELSE 1 / count(*) OVER w END, 6) AS weight FROM promoted WINDOW w AS (PARTITION BY target)")
def propagation_weights(spark, d):
    return causal_graph.share_of_incoming(promoted(spark, d)).select("source", "target", "kind", F.round("weight", 6).alias("weight"))


@query("WITH " + _DECIDED + ", r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY scalar DESC, source, kind) AS r FROM promoted) SELECT source, target, kind, scalar FROM r WHERE r <= 1")
def retain_top(spark, d):
    """Each effect's best edge."""
    return causal_graph.top_per_effect(promoted(spark, d), 1).select("source", "target", "kind", "scalar")


@query("WITH " + _DECIDED + "SELECT source_type, target_type, count(*) AS edges, round(avg(scalar) + 1e-9, 5) AS mean_scalar FROM promoted GROUP BY 1, 2")
def type_projection(spark, d):
    return causal_graph.type_projection(promoted(spark, d)).withColumn("mean_scalar", F.round(F.col("mean_scalar") + 1e-9, 5))


@query("WITH RECURSIVE " + _DECIDED + """, e AS (SELECT DISTINCT source_type AS s, target_type AS t FROM promoted), p AS (SELECT [s, t] AS path FROM e
  WHERE s < t
  UNION ALL SELECT list_append(path, t) FROM p JOIN e ON path[-1] = s WHERE t > path[1] AND NOT list_contains(path, t) AND len(path) < 4)
SELECT array_to_string(path, '>') AS circuit FROM p JOIN e ON path[-1] = s AND t = path[1] UNION ALL SELECT s FROM e WHERE s = t""")
def feedback_loops(spark, d):
    """Circuits of up to four event types."""
    t = causal_graph.type_projection(promoted(spark, d))
    return causal_graph.circuits(t, 4).select(F.array_join("path", ">").alias("circuit"))


@query("WITH " + _DECIDED + ", i AS (SELECT target, count(*) AS degree FROM promoted GROUP BY 1) SELECT degree, count(*) AS effects FROM i GROUP BY 1")
def degree_histograms(spark, d):
    return promoted(spark, d).groupBy("target").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("effects"))


@query("WITH " + _DECIDED + "SELECT event_type, count(*) AS orphans FROM log WHERE event_id NOT IN (SELECT target FROM promoted) GROUP BY 1")
def orphan_effects(spark, d):
    """Events that nothing promoted explains."""
    p = promoted(spark, d).select(F.col("target").alias("event_id")).distinct()
    return tables.log_events(spark, d).join(p, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("orphans"))


@query("WITH " + _DECIDED + "SELECT source_type, target_type, count(*) AS occurrences, count(DISTINCT timeline_id) AS timelines FROM promoted GROUP BY 1, 2 HAVING count(DISTINCT timeline_id) >= 3")
def motifs(spark, d):
    """Type pairs that recur in three user-days or more."""
    where = tables.log_events(spark, d).select(F.col("event_id").alias("source"), "timeline_id")
    return causal_graph.motifs(promoted(spark, d).join(where, "source"), 3)


@query("WITH " + _DECIDED + """, t AS (SELECT source_type, target_type, count(*) AS edges FROM promoted GROUP BY 1, 2),
  i AS (SELECT target_type AS event_type, count(DISTINCT source_type) AS before, sum(edges) AS edges_in FROM t GROUP BY 1),
  outgoing AS (SELECT source_type AS event_type, count(DISTINCT target_type) AS after, sum(edges) AS edges_out FROM t GROUP BY 1)
SELECT event_type, coalesce(before, 0)::BIGINT AS before, coalesce(edges_in, 0)::BIGINT AS edges_in, coalesce(after, 0)::BIGINT AS after,
  coalesce(edges_out, 0)::BIGINT AS edges_out FROM i FULL JOIN outgoing USING (event_type)""")
def bottlenecks(spark, d):
    return causal_graph.bottlenecks(causal_graph.type_projection(promoted(spark, d)))


_SEEDS = ", seeds AS (SELECT DISTINCT source AS seed FROM promoted WHERE source_type = 'signup' OR source_type = 'view')"


def _seeds(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("source_type").isin("signup", "view")).select(F.lit("all").alias("set_id"), F.col("source").alias("node")).distinct()


def _edges(spark, d) -> DataFrame:
    return kept("edges", d, lambda: promoted(spark, d).select("source", "target", "source_type", "target_type", "kind", "scalar"))


@query("WITH RECURSIVE " + _DECIDED + _SEEDS + """, e AS (SELECT DISTINCT source, target FROM promoted), r AS (SELECT seed, seed AS node,
  0 AS distance FROM seeds UNION SELECT r.seed, e.target, distance + 1 FROM r JOIN e ON r.node = e.source WHERE distance < 4)
SELECT seed, node, min(distance) AS distance FROM r WHERE distance > 0 AND seed <> node GROUP BY 1, 2""")
def reachability(spark, d):
    """What views and signups lead to in up to four steps."""
    e = _edges(spark, d)
    return causal_graph.reach(e, _seeds(e), 4).where("seed <> node").select("seed", "node", "distance")


@query("WITH RECURSIVE " + _DECIDED + _SEEDS + """, e AS (SELECT DISTINCT source, target FROM promoted WHERE target_type <> 'click'),
  r AS (SELECT seed, seed AS node, 0 AS distance FROM seeds UNION SELECT r.seed, e.target, distance + 1 FROM r JOIN e ON r.node = e.source
  WHERE distance < 4)
SELECT seed, node, min(distance) AS distance FROM r WHERE distance > 0 AND seed <> node GROUP BY 1, 2""")
def reachability_excluding(spark, d):
    """The same with every click taken out of the graph."""
    e = _edges(spark, d)
    clicks = e.where("target_type = 'click'").select(F.lit("all").alias("set_id"), F.col("target").alias("node")).distinct()
    return causal_graph.reach(e, _seeds(e), 4, clicks).where("seed <> node").select("seed", "node", "distance")


@query("WITH RECURSIVE " + _DECIDED + """, outcomes AS (SELECT DISTINCT target AS outcome FROM promoted WHERE target_type = 'purchase'),
  r AS (SELECT outcome, outcome AS cause, 0 AS distance FROM outcomes UNION SELECT r.outcome, p.source, distance + 1 FROM r
  JOIN promoted p ON r.cause = p.target WHERE distance < 4)
SELECT outcome, cause, min(distance) AS distance, dense_rank() OVER (PARTITION BY outcome ORDER BY min(distance) DESC) AS earliness FROM r
  WHERE distance > 0 GROUP BY 1, 2""")
def ancestors(spark, d):
    """The possible causes of each purchase; the farthest rank first."""
    from pyspark.sql import Window

    e = _edges(spark, d)
    seeds = e.where("target_type = 'purchase'").select(F.lit("all").alias("set_id"), F.col("target").alias("node")).distinct()
    back = causal_graph.reach(e.select(F.col("target").alias("source"), F.col("source").alias("target")), seeds, 4)
    rank = F.dense_rank().over(Window.partitionBy("seed").orderBy(F.col("distance").desc()))
    return back.select(F.col("seed").alias("outcome"), F.col("node").alias("cause"), "distance", rank.alias("earliness"))


_WALK = """, e AS (SELECT source, target, max(scalar) AS scalar FROM promoted GROUP BY 1, 2), r AS (SELECT seed, seed AS node, [seed] AS path,
  1.0::DOUBLE AS weak FROM seeds UNION ALL SELECT r.seed, e.target, list_append(path, e.target), least(weak, scalar) FROM r
  JOIN e ON r.node = e.source WHERE e.target <> seed AND len(path) <= 3)"""


def _walk(spark, d) -> DataFrame:
    e = _edges(spark, d)
    strongest = e.groupBy("source", "target").agg(F.max("scalar").alias("scalar"))
    return causal_graph.walk(strongest, _seeds(e).select("node"), 3)


@query("WITH RECURSIVE " + _DECIDED + _SEEDS + _WALK + "SELECT seed, node, min(len(path) - 1)::INTEGER AS distance, count(*) AS routes, max(weak) AS weight FROM r WHERE len(path) > 1 GROUP BY 1, 2")
def propagation_walk(spark, d):
    """Routes of up to three steps from views and signups, and the strongest one's weakest link."""
    return _walk(spark, d)


@query("WITH " + LOG + """, g AS (SELECT source_type, target_type, count(*) AS witnesses, min(b_us - a_us) AS low, max(b_us - a_us) AS high FROM pairs
  GROUP BY 1, 2)
SELECT source_type, target_type, witnesses, low, high, CASE WHEN 43200000000 BETWEEN low AND high THEN 'WITHIN' WHEN greatest(low - 43200000000,
  43200000000 - high) <= 0.1 * (high - low) THEN 'AT_EDGE' ELSE 'EXTRAPOLATION' END AS verdict FROM g""")
def support_envelopes(spark, d):
    """Have gaps of twelve hours been seen between two types?"""
    gap = F.unix_micros(F.col("effect.ts").cast("timestamp")) - F.unix_micros(F.col("cause.ts").cast("timestamp"))
    g = pairs(spark, d).groupBy(F.col("cause.event_type").alias("source_type"), F.col("effect.event_type").alias("target_type")).agg(F.count("*").alias("witnesses"), F.min(gap).alias("low"), F.max(gap).alias("high"))
    at = 12 * HOUR
    beyond = F.greatest(F.col("low") - at, at - F.col("high"))
    return g.withColumn("verdict", F.when(beyond <= 0, "WITHIN").when(beyond <= 0.1 * (F.col("high") - F.col("low")), "AT_EDGE").otherwise("EXTRAPOLATION"))


_DESIRE = """, c AS (SELECT source_type AS lever, count(DISTINCT target) AS reached, avg(scalar) AS belief FROM promoted GROUP BY 1), k AS (SELECT *,
  CASE lever WHEN 'signup' THEN 0.75 WHEN 'view' THEN 0.25 WHEN 'click' THEN 0.5 WHEN 'purchase' THEN 1.0 END AS cost, CASE lever
  WHEN 'error' THEN 0.0 WHEN 'view' THEN 0.5 END AS risk FROM c),
m AS (SELECT max(reached) AS most FROM c), des AS (SELECT lever, reached, round(belief, 5) AS belief, cost,
  round((0.40 * reached / most + 0.25 * (1 - coalesce(cost, 1)) + 0.20 * belief + 0.15 * (1 - coalesce(risk, 1))) / 1.0, 5) AS desirability FROM k,
  m)"""


#: Weights of a lever's benefit, cost, belief and risk.
BENEFIT, COST, BELIEF, RISK = 0.40, 0.25, 0.20, 0.15


def _levers(spark, d) -> DataFrame:
    cost = F.create_map(*[F.lit(x) for kv in (("signup", 0.75), ("view", 0.25), ("click", 0.5), ("purchase", 1.0)) for x in kv])
    risk = F.create_map(*[F.lit(x) for kv in (("error", 0.0), ("view", 0.5)) for x in kv])
    c = promoted(spark, d).groupBy(F.col("source_type").alias("lever")).agg(F.count_distinct("target").alias("reached"), F.avg("scalar").alias("belief"))
    c = c.withColumn("cost", F.try_element_at(cost, F.col("lever"))).withColumn("risk", F.try_element_at(risk, F.col("lever"))).crossJoin(F.broadcast(c.agg(F.max("reached").alias("most"))))
    worst = lambda n: 1 - F.coalesce(n, F.lit(1.0))
    score = BENEFIT * F.col("reached") / F.col("most") + COST * worst("cost") + BELIEF * F.col("belief") + RISK * worst("risk")
    return c.select("lever", "reached", F.round("belief", 5).alias("belief"), "cost", F.round(score, 5).alias("desirability"))


@query("WITH " + _DECIDED + _DESIRE + "SELECT * FROM des")
def desirability(spark, d):
    """Types of event as levers: reach, belief, declared cost and risk; undeclared counts as worst."""
    return _levers(spark, d)


@query("WITH " + _DECIDED + _DESIRE + "SELECT lever, reached, belief, cost FROM des a WHERE cost IS NOT NULL AND NOT EXISTS (SELECT 1 FROM des b WHERE b.cost IS NOT NULL AND b.reached >= a.reached AND b.belief >= a.belief AND b.cost <= a.cost AND (b.reached > a.reached OR b.belief > a.belief OR b.cost < a.cost))")
def pareto_front(spark, d):
    return causal_graph.pareto_front(_levers(spark, d), "lever", ["reached", "belief"], ["cost"])


@query("WITH RECURSIVE " + _DECIDED + """, s AS (SELECT * FROM (VALUES ('click', ['click']), ('error', ['error']), ('view', ['view']), ('click,error',
  ['click','error']), ('click,view', ['click','view']), ('error,view', ['error','view'])) v(members, m)),
seeds AS (SELECT DISTINCT source AS seed FROM promoted WHERE source_type = 'signup' OR source_type = 'view'), e AS (SELECT DISTINCT source, target,
  target_type FROM promoted),
b AS (SELECT seed, seed AS node, 0 AS n FROM seeds UNION SELECT b.seed, e.target, n + 1 FROM b JOIN e ON b.node = e.source WHERE n < 3),
  base AS (SELECT DISTINCT seed, node FROM b WHERE n > 0 AND seed <> node),
r AS (SELECT members, m, seed, seed AS node, 0 AS n FROM s, seeds UNION SELECT members, m, r.seed, e.target, n + 1 FROM r
  JOIN e ON r.node = e.source AND NOT list_contains(m, e.target_type) WHERE n < 3), left_ AS (SELECT members, count(*) AS l
  FROM (SELECT DISTINCT members, seed, node FROM r WHERE n > 0 AND seed <> node) GROUP BY 1)
SELECT s.members, (SELECT count(*) FROM base) - coalesce(l, 0) AS broken FROM s LEFT JOIN left_ USING (members)""")
def cut_sets(spark, d):
    """Which connections break without one or two types of event, all sets in one walk."""
    e = _edges(spark, d)
    members = ["click", "error", "view"]
    names = [("click",), ("error",), ("view",), ("click", "error"), ("click", "view"), ("error", "view")]
    sets = F.broadcast(spark.createDataFrame([(",".join(n), t) for n in names for t in n], "set_id string, target_type string"))
    without = e.select("target", "target_type").distinct().join(sets, "target_type").select("set_id", F.col("target").alias("node"))
    seeds = _seeds(e)
    base = causal_graph.reach(e, seeds, 3).where("seed <> node")
    every = seeds.select("node").crossJoin(F.broadcast(sets.select("set_id").distinct()))
    return causal_graph.cut_sets(causal_graph.reach(e, every, 3, without).where("seed <> node"), base, members, 2)

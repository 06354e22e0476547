"""Queries on graphs without some of their events: removal, benefit, portfolios, chains, loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import causal_graph, simulation
from ..shared import kept, written
from ..sources import tables
from .causes import _DECIDED, _SCORES, FLOORS, _edges, decided, promotable, promoted
from .claims import _fired
from .common import LOG, query

#: Rounds that the SQL writes out, more than these tables' graphs take; the plans go on until nothing more goes.
ROUNDS = 14
#: Worlds in which all confidences are a tenth lower or higher: some edges are no longer promoted, others are.
WORLDS = (0.9, 1.0, 1.1)
LEVERS = ("view", "click", "signup")
#: Declared actionability: types that can be acted on, with their cost.
COSTS = {"view": 0.25, "click": 0.5, "signup": 0.75}


def gone_sql(removed: str, edges: str = "e", world: str = "") -> str:
    """The rounds of eliminated() in SQL, over removed(set_id, node) and edges."""
    w = f"{world}, " if world else ""
    same = f" AND g.{world} = x.{world}" if world else ""
    out = f", links AS (SELECT {w}target, count(*) AS links FROM {edges} GROUP BY ALL), gone0 AS (SELECT DISTINCT {w}set_id, node FROM {removed})"
    for r in range(1, ROUNDS + 1):
        out += f""", stop{r} AS MATERIALIZED (SELECT g.set_id, {f"x.{world}, " if world else ""}x.target, count(*) AS stopped FROM gone{r - 1} g
  JOIN {edges} x ON x.source = g.node{same} GROUP BY ALL),
gone{r} AS MATERIALIZED (SELECT {w}set_id, node FROM gone{r - 1} UNION SELECT {w}set_id, target FROM stop{r} JOIN links USING ({w}target) WHERE stopped = links)"""
    return out + f", gone AS (SELECT * FROM gone{ROUNDS})"


_PAIRS = _DECIDED + """, e AS (SELECT source, target, max(scalar) AS scalar, any_value(source_type) AS source_type,
  any_value(target_type) AS target_type FROM promoted GROUP BY 1, 2),
we AS (SELECT *, CASE WHEN sum(scalar) OVER t > 0 THEN scalar / sum(scalar) OVER t ELSE 1 / count(*) OVER t END AS weight
  FROM e WINDOW t AS (PARTITION BY target))"""


def pairs_of(spark, d) -> DataFrame:
    """Promoted edges, one for each pair of events, with their shares of their effects."""
    e = promoted(spark, d).groupBy("source", "target", "source_type", "target_type").agg(F.max("scalar").alias("scalar"))
    return kept("pairs", d, lambda: causal_graph.share_of_incoming(e))


def _values(spark, d) -> DataFrame:
    return tables.log_events(spark, d).select(F.col("event_id").alias("node"), "event_type", "value")


_CAUSES = ", causes AS (SELECT DISTINCT source AS set_id, source AS node FROM e WHERE source_type IN ('view', 'signup'))"
_PREVENTED = _PAIRS + _CAUSES + gone_sql("causes") + """, prevented AS (SELECT set_id AS cause, count(*) AS outcomes, sum(value) AS prevented
  FROM gone JOIN log ON event_id = node
  WHERE event_type = 'purchase' AND node <> set_id GROUP BY 1)"""


def _causes(e: DataFrame) -> DataFrame:
    return e.where(F.col("source_type").isin("view", "signup")).select(F.col("source").alias("set_id"), F.col("source").alias("node")).distinct()


def prevented(spark, d, e: DataFrame) -> DataFrame:
    """cause, outcomes, prevented: purchases, and their value, that go with each view and signup."""
    gone = simulation.eliminated(e, _causes(e)).where("node <> set_id").join(_values(spark, d).where("event_type = 'purchase'").hint("merge"), "node")
    return gone.groupBy(F.col("set_id").alias("cause")).agg(F.count("*").alias("outcomes"), F.sum("value").alias("prevented"))


@query("WITH " + _PREVENTED + """SELECT cause, outcomes, round(prevented, 4) AS prevented, round(prevented / (SELECT sum(value) FROM log
  WHERE event_type = 'purchase'), 9) AS share FROM prevented""")
def prevented_by_removal(spark, d):
    """What goes with each view and signup, effects of effects too: an outcome that keeps another cause stays."""
    whole = _values(spark, d).where("event_type = 'purchase'").agg(F.sum("value").alias("whole"))
    p = prevented(spark, d, pairs_of(spark, d)).crossJoin(F.broadcast(whole))
    return p.select("cause", "outcomes", F.round("prevented", 4).alias("prevented"), F.round(F.col("prevented") / F.col("whole"), 9).alias("share"))


_CHAINS_HEAD = ", chain0 AS (SELECT DISTINCT node AS seed, node, 0 AS distance, NULL::BIGINT AS parent, 1.0::DOUBLE AS confidence FROM causes)"


def chains_sql(depth: int) -> str:
    out = _CHAINS_HEAD
    for n in range(1, depth + 1):
        out += f""", chain{n} AS (SELECT * FROM chain{n - 1} UNION ALL SELECT c.seed, x.target, {n}, arg_max(x.source, (c.confidence * x.scalar,
  -x.source)), max(c.confidence * x.scalar)
  FROM chain{n - 1} c JOIN e x ON x.source = c.node WHERE c.distance = {n - 1} AND NOT EXISTS (SELECT 1 FROM chain{n - 1} k
  WHERE k.seed = c.seed AND k.node = x.target) GROUP BY 1, 2)"""
    return out + f", chains AS (SELECT * FROM chain{depth} WHERE distance > 0)"


@query("WITH " + _PAIRS + _CAUSES + chains_sql(4) + "SELECT seed AS cause, node AS outcome, distance, parent, round(confidence, 6) AS confidence FROM chains JOIN log ON event_id = node WHERE event_type = 'purchase'")
def causal_chains(spark, d):
    """From each view and signup the chain to each purchase that it leads to."""
    e = pairs_of(spark, d)
    c = simulation.chains(e, _causes(e).select("node"), 4).join(_values(spark, d).where("event_type = 'purchase'").select("node"), "node", "left_semi")
    return c.select(F.col("seed").alias("cause"), F.col("node").alias("outcome"), "distance", "parent", F.round("confidence", 6).alias("confidence"))


_RANKED = _PREVENTED + chains_sql(4) + """, ranked AS (SELECT c.seed AS cause, count(*) AS consequences, max(distance) AS farthest,
  max(confidence) AS chain, coalesce(any_value(p.outcomes), 0) AS outcomes,
    coalesce(any_value(p.prevented), 0) AS prevented, any_value(s.event_type) AS cause_type
  FROM chains c JOIN log o ON o.event_id = c.node AND o.event_type = 'purchase' JOIN log s ON s.event_id = c.seed LEFT
  JOIN prevented p ON p.cause = c.seed GROUP BY 1)"""


def _ranked(spark, d) -> DataFrame:
    """Causes of purchases: how many they lead to, how many go without them, and the best chain's confidence."""
    e = pairs_of(spark, d)
    v = _values(spark, d)
    c = simulation.chains(e, _causes(e).select("node"), 4).join(v.where("event_type = 'purchase'").select("node"), "node", "left_semi")
    r = c.groupBy(F.col("seed").alias("cause")).agg(F.count("*").alias("consequences"), F.max("distance").alias("farthest"), F.max("confidence").alias("chain"))
    r = r.join(prevented(spark, d, e), "cause", "left").join(v.select(F.col("node").alias("cause"), F.col("event_type").alias("cause_type")), "cause")
    return r.withColumn("outcomes", F.coalesce("outcomes", F.lit(0))).withColumn("prevented", F.coalesce("prevented", F.lit(0.0)))


@query("WITH " + _RANKED + "SELECT cause, consequences, outcomes, round(prevented, 4) AS prevented, round(chain, 6) AS chain, round(prevented * chain, 4) AS score FROM ranked ORDER BY round(prevented * chain, 4) DESC, cause LIMIT 20")
def root_cause_ranking(spark, d):
    """The twenty views and signups without which most purchase value goes, by how sure their best chain is."""
    score = F.round(F.col("prevented") * F.col("chain"), 4).alias("score")
    r = _ranked(spark, d).select("cause", "consequences", "outcomes", F.round("prevented", 4).alias("prevented"), F.round("chain", 6).alias("chain"), score)
    return r.orderBy(F.col("score").desc(), "cause").limit(20)


_VIEWS = {
    "EARLIEST": ("farthest DESC, cause", ["farthest"]),
    "HIGHEST_CONSEQUENCE": ("prevented DESC, cause", ["prevented"]),
    "MOST_ACTIONABLE": ("cost, cause", ["cost"]),
    "RECOMMENDED": ("prevented * chain / (1 + cost) DESC, cause", ["score"]),
}


@query(
    "WITH "
    + _RANKED
    + ", c AS (SELECT *, CASE cause_type WHEN 'view' THEN 0.25 ELSE 0.75 END AS cost, round(prevented * chain, 6) AS worth FROM ranked), "
    + "t AS (SELECT *, round(worth / (1 + cost), 6) AS score FROM c) "
    + """SELECT 'EARLIEST' AS view, arg_min(cause, (-farthest, cause)) AS cause FROM t UNION ALL SELECT 'HIGHEST_CONSEQUENCE', arg_min(cause,
  (-round(prevented, 6), cause)) FROM t
UNION ALL SELECT 'MOST_ACTIONABLE', arg_min(cause, (cost, cause)) FROM t UNION ALL SELECT 'RECOMMENDED', arg_min(cause, (-score, cause)) FROM t"""
)
def root_cause_views(spark, d):
    """One cause for each of four ways to look: first in its chain, most value, cheapest, and all of it together."""
    cost = F.when(F.col("cause_type") == "view", 0.25).otherwise(0.75)
    t = _ranked(spark, d).withColumn("cost", cost).withColumn("score", F.round(F.round(F.col("prevented") * F.col("chain"), 6) / (1 + F.col("cost")), 6))
    by = {"EARLIEST": -F.col("farthest"), "HIGHEST_CONSEQUENCE": -F.round("prevented", 6), "MOST_ACTIONABLE": F.col("cost"), "RECOMMENDED": -F.col("score")}
    best = t.agg(*[F.min_by("cause", F.struct(c.alias("a"), "cause")).alias(n) for n, c in by.items()])
    return best.unpivot([], list(by), "view", "cause").where("cause is not null")


_WHOLE_TYPES = ", sets AS (SELECT unnest(['view', 'click', 'signup', 'click,view', 'click,signup', 'signup,view']) AS set_id), removed AS (SELECT DISTINCT set_id, source AS node FROM sets, e WHERE list_contains(string_split(set_id, ','), source_type))"
_BENEFIT = """, touched AS (SELECT DISTINCT g.set_id, x.target AS node FROM gone g JOIN we x ON x.source = g.node),
lost AS (SELECT g.set_id, x.target AS node, sum(weight) AS lost FROM gone g JOIN we x ON x.source = g.node GROUP BY 1, 2),
kept AS (SELECT set_id, node, 0.0::DOUBLE AS kept FROM gone UNION ALL SELECT set_id, node, greatest(1 - lost, 0) FROM lost l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.set_id = l.set_id AND g.node = l.node))"""


def _type_sets(spark, e: DataFrame) -> DataFrame:
    names = [(a,) for a in LEVERS] + [(a, b) for a in LEVERS for b in LEVERS if a < b]
    sets = spark.createDataFrame([(",".join(n), t) for n in names for t in n], "set_id string, source_type string")
    return e.select("source", "source_type").distinct().join(F.broadcast(sets), "source_type").select("set_id", F.col("source").alias("node"))


def benefits(spark, d, e: DataFrame) -> DataFrame:
    """set_id, effects, eliminated, benefit: purchase value that goes without each set of levers."""
    k = simulation.simulated(e.select("source", "target", "weight"), _type_sets(spark, e)).join(_values(spark, d), "node").where("event_type = 'purchase'")
    return k.groupBy("set_id").agg(F.count("*").alias("effects"), F.count_if(F.col("kept") == 0).alias("eliminated"), F.sum(F.col("value") * (1 - F.col("kept"))).alias("benefit"))


_SETS = "WITH " + _PAIRS + _WHOLE_TYPES + gone_sql("removed") + _BENEFIT + """, benefits AS (SELECT set_id, count(*) AS effects,
  count(*) FILTER (kept = 0) AS eliminated, sum(value * (1 - kept)) AS benefit
  FROM kept JOIN log ON event_id = node WHERE event_type = 'purchase' GROUP BY 1)"""


@query(_SETS + " SELECT set_id, effects, eliminated, round(benefit, 4) AS benefit FROM benefits")
def simulate_removal(spark, d):
    """Purchases that change without all views, clicks or signups, or two of these."""
    b = benefits(spark, d, pairs_of(spark, d))
    return b.withColumn("benefit", F.round("benefit", 4))


@query(
    _SETS
    + """ SELECT a.set_id AS first, b.set_id AS second, round(a.benefit + b.benefit, 4) AS naive, round(j.benefit, 4) AS joint,
  round(j.benefit - a.benefit - b.benefit, 4) AS interaction
FROM benefits j JOIN benefits a ON a.set_id = split_part(j.set_id, ',', 1) JOIN benefits b ON b.set_id = split_part(j.set_id, ',', 2)
  WHERE contains(j.set_id, ',')"""
)
def portfolio_benefit(spark, d):
    """What two levers prevent together beside the sum of what each does: overlap is lost, joint causes are won."""
    b = written(benefits(spark, d, pairs_of(spark, d)), "benefits")
    one = b.where("not contains(set_id, ',')")
    j = b.where("contains(set_id, ',')").select(F.split_part("set_id", F.lit(","), F.lit(1)).alias("first"), F.split_part("set_id", F.lit(","), F.lit(2)).alias("second"), F.col("benefit").alias("joint"))
    j = j.join(F.broadcast(one.select(F.col("set_id").alias("first"), F.col("benefit").alias("a"))), "first").join(F.broadcast(one.select(F.col("set_id").alias("second"), F.col("benefit").alias("b"))), "second")
    total = F.col("a") + F.col("b")
    return j.select("first", "second", F.round(total, 4).alias("naive"), F.round("joint", 4).alias("joint"), F.round(F.col("joint") - F.col("a") - F.col("b"), 4).alias("interaction"))


_WORLD_EDGES = (
    _SCORES
    + f""", worlds AS (SELECT unnest({list(WORLDS)}::DOUBLE[]) AS world), e AS (
  SELECT world, source, target, max(round(scalar, 6)) AS scalar, any_value(source_type) AS source_type FROM graded, worlds
  WHERE verdict = 'CERTAIN' AND kind IN ('DIRECT', 'CONDITIONAL') AND round(round(scalar, 6) * world, 6) >= CASE kind
  WHEN 'DIRECT' THEN 0.142 ELSE 0.25 END GROUP BY 1, 2, 3),
we AS (SELECT *, scalar / sum(scalar) OVER (PARTITION BY world, target) AS weight FROM e),
removed AS (SELECT DISTINCT world, source_type AS set_id, source AS node FROM e WHERE source_type IN ('view', 'click', 'signup'))"""
)


@query(
    "WITH "
    + _WORLD_EDGES
    + gone_sql("removed", "e", "world")
    + """, lost AS (SELECT g.world, g.set_id, x.target AS node, sum(weight) AS lost FROM gone g JOIN we x ON x.source = g.node AND x.world = g.world
  GROUP BY 1, 2, 3),
kept AS (SELECT world, set_id, node, 0.0::DOUBLE AS kept FROM gone UNION ALL SELECT world, set_id, node, greatest(1 - lost, 0) FROM lost l
  WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.world = l.world AND g.set_id = l.set_id AND g.node = l.node))
SELECT world, set_id AS lever, count(*) AS effects, round(sum(value * (1 - kept)), 4) AS benefit FROM kept JOIN log ON event_id = node
  WHERE event_type = 'purchase' GROUP BY 1, 2"""
)
def sensitivity(spark, d):
    """The benefit of each lever, simulated in graphs whose confidences are a tenth lower and higher."""
    floor = F.when(F.col("kind") == "DIRECT", FLOORS["DIRECT"]).when(F.col("kind") == "CONDITIONAL", FLOORS["CONDITIONAL"])
    s = promotable(spark, d).withColumn("scalar", F.round("scalar", 6))
    w = s.withColumn("world", F.explode(F.array(*[F.lit(x) for x in WORLDS]))).where(F.round(F.col("scalar") * F.col("world"), 6) >= floor)
    w = w.groupBy("world", "source", "target", "source_type").agg(F.max("scalar").alias("scalar"))
    total = w.groupBy("world", "target").agg(F.sum("scalar").alias("total"))
    e = written(w.join(total, ["world", "target"]).withColumn("weight", F.col("scalar") / F.col("total")), "worlds")
    removed = e.where(F.col("source_type").isin(*LEVERS)).select("world", F.col("source_type").alias("set_id"), F.col("source").alias("node")).distinct()
    k = simulation.simulated(e.select("world", "source", "target", "weight"), removed, ("world",)).join(_values(spark, d), "node").where("event_type = 'purchase'")
    return k.groupBy("world", F.col("set_id").alias("lever")).agg(F.count("*").alias("effects"), F.round(F.sum(F.col("value") * (1 - F.col("kept"))), 4).alias("benefit"))


@query(
    "WITH "
    + _PAIRS
    + ", removed AS (SELECT DISTINCT 'view' AS set_id, source AS node FROM e WHERE source_type = 'view')"
    + gone_sql("removed")
    + _BENEFIT
    + """ SELECT node AS target, kept = 0 AS eliminated, round(value * kept, 4) AS reading, round(value, 4) AS before
FROM kept JOIN log ON event_id = node WHERE node NOT IN (SELECT node FROM removed)"""
)
def counterfactual_diff(spark, d):
    """Without any view: what goes, effects of lost effects too, and what the others keep."""
    e = pairs_of(spark, d)
    views = e.where("source_type = 'view'").select(F.lit("view").alias("set_id"), F.col("source").alias("node")).distinct()
    k = simulation.simulated(e.select("source", "target", "weight"), views).join(views.select("node"), "node", "left_anti").join(_values(spark, d), "node")
    return k.select(F.col("node").alias("target"), (F.col("kept") == 0).alias("eliminated"), F.round(F.col("value") * F.col("kept"), 4).alias("reading"), F.round("value", 4).alias("before"))


@query(
    "WITH "
    + _DECIDED
    + """, stood AS (SELECT 'STATED' AS standing, kind, count(*) AS edges, round(sum(weight), 4) AS weight FROM
    (SELECT kind, CASE WHEN sum(scalar) OVER t > 0 THEN scalar / sum(scalar) OVER t ELSE 1 / count(*) OVER t END AS weight
  FROM promoted WINDOW t AS (PARTITION BY target)) GROUP BY 2
  UNION ALL SELECT 'UNPROMOTED_DIAGNOSTIC', kind, count(*), round(sum(weight), 4) FROM (SELECT kind, 1 / count(*) OVER (PARTITION BY target) AS weight
  FROM decided WHERE decision <> 'PROMOTED') GROUP BY 2)
SELECT * FROM stood"""
)
def graph_standings(spark, d):
    """Two views of the graph: what is promoted, by shares of confidence, and what isn't, by equal shares, for diagnosis only."""
    every = written(decided(spark, d), "decided")
    stated = causal_graph.share_of_incoming(every.where("decision = 'PROMOTED'")).select(F.lit("STATED").alias("standing"), "kind", "weight")
    other = every.where("decision <> 'PROMOTED'")
    other = other.join(other.groupBy("target").agg(F.count("*").alias("n")), "target").select(F.lit("UNPROMOTED_DIAGNOSTIC").alias("standing"), "kind", (1 / F.col("n")).alias("weight"))
    return stated.union(other).groupBy("standing", "kind").agg(F.count("*").alias("edges"), F.round(F.sum("weight"), 4).alias("weight"))


@query(
    "WITH "
    + _DECIDED
    + """, r AS (SELECT source, target, bool_or(rule_id = 'CLICK_FROM_VIEW') AS plain, bool_or(rule_id <> 'CLICK_FROM_VIEW') AS conditional FROM fired
  GROUP BY 1, 2), s AS (SELECT DISTINCT source, target FROM merged WHERE kind = 'STRUCTURAL'),
t AS (SELECT p.kind, CASE WHEN r.source IS NOT NULL THEN 'RULE_DECLARED'
  WHEN s.source IS NOT NULL THEN 'STRUCTURAL' ELSE 'UNTYPED_DEFAULT' END AS typing,
  CASE WHEN r.source IS NULL THEN false WHEN p.kind = 'DIRECT' THEN NOT plain ELSE NOT conditional END AS disagrees FROM promoted p LEFT
  JOIN r USING (source, target) LEFT JOIN s USING (source, target))
SELECT typing, kind, disagrees, count(*) AS edges FROM t GROUP BY 1, 2, 3"""
)
def edge_typing(spark, d):
    """What says which kind of edge a promoted one is: a firing that holds both ends, a
    structural tie, or nothing; and whether the rule says another kind."""
    from .claims import RULES
    from ..operators.candidates import rule_kind

    plain = [r.rule_id for r in RULES if rule_kind(r) == "DIRECT"]
    f = _fired(spark, d).groupBy("source", "target").agg(F.max(F.col("rule_id").isin(*plain)).alias("plain"), F.max(~F.col("rule_id").isin(*plain)).alias("conditional"))
    every = written(decided(spark, d), "decided")
    tied = every.where("kind = 'STRUCTURAL'").select("source", "target", F.lit(True).alias("tied")).distinct()
    t = every.where("decision = 'PROMOTED'").select("source", "target", "kind").join(f, ["source", "target"], "left").join(tied, ["source", "target"], "left")
    typing = F.when(F.col("plain").isNotNull(), "RULE_DECLARED").when(F.col("tied").isNotNull(), "STRUCTURAL").otherwise("UNTYPED_DEFAULT")
    disagrees = F.when(F.col("plain").isNull(), False).when(F.col("kind") == "DIRECT", ~F.col("plain")).otherwise(~F.col("conditional"))
    return t.groupBy(typing.alias("typing"), "kind", disagrees.alias("disagrees")).agg(F.count("*").alias("edges"))


_LOOPS = """, t AS (SELECT source_type AS s, target_type AS t, avg(round(scalar, 6)) AS gain, count(*) FILTER (decision = 'PROMOTED') AS promoted,
  count(*) FILTER (verdict = 'CERTAIN') AS sure FROM decided GROUP BY 1, 2),
p AS (SELECT [s, t] AS path FROM t WHERE s < t UNION ALL SELECT list_append(path, t) FROM p JOIN t ON path[-1] = s
  WHERE t > path[1] AND NOT list_contains(path, t) AND len(path) < 4),
c AS (SELECT path FROM p JOIN t ON path[-1] = s AND t = path[1] UNION ALL SELECT [s] FROM t WHERE s = t),
lk AS (SELECT path, path[i] AS s, path[i % len(path) + 1] AS t FROM c, unnest(range(1, len(path) + 1)) u(i))"""


@query(
    "WITH RECURSIVE "
    + _DECIDED
    + _LOOPS
    + """ SELECT array_to_string(path, '>') AS circuit, CASE WHEN min(sure) = 0 THEN 'TEMPORAL_ARTIFACT' WHEN len(path) = 1 THEN 'WITHIN_INSTANCE'
  WHEN min(promoted) = 0 THEN 'UNPROMOTED' ELSE 'GENUINE' END AS class,
  round(product(gain), 6) AS gain, arg_min(s || '>' || t, (round(gain, 6), s || '>' || t)) AS weakest FROM lk JOIN t USING (s, t) GROUP BY path"""
)
def loop_classes(spark, d):
    """Circuits of event types among all candidates: what kind of loop each is, its gain, its weakest link."""
    every = decided(spark, d)
    t = every.groupBy("source_type", "target_type").agg(
        F.avg("scalar").alias("gain"), F.count_if(F.col("decision") == "PROMOTED").alias("promoted"), F.count_if(F.col("verdict") == "CERTAIN").alias("sure")
    )
    t = written(t, "types")
    c = causal_graph.circuits(t, 4).withColumn("circuit", F.array_join("path", ">"))
    ends = F.concat(F.slice("path", 2, F.size("path") - 1), F.slice("path", 1, 1))
    links = c.select("circuit", F.size("path").alias("n"), F.explode(F.arrays_zip(F.col("path").alias("s"), ends.alias("t"))).alias("l")).select("circuit", "n", F.col("l.s").alias("source_type"), F.col("l.t").alias("target_type"))
    links = links.join(F.broadcast(t), ["source_type", "target_type"]).withColumn("link", F.concat_ws(">", "source_type", "target_type"))
    found = links.groupBy("circuit", "n").agg(F.product("gain").alias("gain"), F.min_by("link", F.struct(F.round("gain", 6).alias("g"), "link")).alias("weakest"), F.min("promoted").alias("promoted"), F.min("sure").alias("sure"))
    kind = F.when(F.col("sure") == 0, "TEMPORAL_ARTIFACT").when(F.col("n") == 1, "WITHIN_INSTANCE").when(F.col("promoted") == 0, "UNPROMOTED").otherwise("GENUINE")
    return found.select("circuit", kind.alias("class"), F.round("gain", 6).alias("gain"), "weakest")


_VERDICTS = """CASE WHEN cost IS NULL THEN 'NOT_ACTIONABLE' WHEN belief < 0.15 THEN 'BELIEF_TOO_LOW' WHEN prevented = 0 THEN 'NO_BENEFIT'
  WHEN outcomes < 1 THEN 'NO_OUTCOME'
  WHEN stability < 0.5 THEN 'UNSTABLE' WHEN place > 25 THEN 'BEYOND_LIMIT' ELSE 'PUBLISHED' END"""


@query(
    "WITH "
    + _RANKED
    + f""", b AS (SELECT source AS cause, min(scalar) AS least, max(scalar) AS most FROM e GROUP BY 1),
r AS (SELECT cause, outcomes, prevented, round(least(chain, least), 6) AS belief, round(least / most, 6) AS stability, CASE cause_type
  WHEN 'view' THEN 0.25 END AS cost,
  row_number() OVER (ORDER BY round(prevented * chain, 6) DESC, cause) AS place FROM ranked JOIN b USING (cause))
SELECT {_VERDICTS} AS verdict, count(*) AS causes, round(min(belief), 6) AS least_belief, round(sum(prevented), 4) AS prevented FROM r GROUP BY 1"""
)
def recommendations(spark, d):
    """Causes as recommendations: belief is the least of their components; who isn't published has the first reason that holds."""
    from pyspark.sql import Window

    e = pairs_of(spark, d)
    b = e.groupBy(F.col("source").alias("cause")).agg(F.min("scalar").alias("least"), F.max("scalar").alias("most"))
    r = _ranked(spark, d).join(b, "cause").withColumns({"belief": F.round(F.least("chain", "least"), 6), "stability": F.round(F.col("least") / F.col("most"), 6), "cost": F.when(F.col("cause_type") == "view", 0.25)})
    top = r.orderBy(F.round(F.col("prevented") * F.col("chain"), 6).desc(), "cause").limit(25)  # the publication limit
    top = top.select("cause", F.lit(1).alias("place"))
    r = r.join(F.broadcast(top), "cause", "left")
    verdict = (
        F.when(F.col("cost").isNull(), "NOT_ACTIONABLE")
        .when(F.col("belief") < 0.15, "BELIEF_TOO_LOW")
        .when(F.col("prevented") == 0, "NO_BENEFIT")
        .when(F.col("outcomes") < 1, "NO_OUTCOME")
        .when(F.col("stability") < 0.5, "UNSTABLE")
        .when(F.col("place").isNull(), "BEYOND_LIMIT")
        .otherwise("PUBLISHED")
    )
    return r.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("causes"), F.round(F.min("belief"), 6).alias("least_belief"), F.round(F.sum("prevented"), 4).alias("prevented"))


@query(
    "WITH RECURSIVE "
    + _DECIDED
    + """, seeds AS (SELECT DISTINCT source AS seed FROM promoted WHERE source_type IN ('signup', 'view')), e AS (SELECT DISTINCT source, target,
  target_type FROM promoted),
s AS (SELECT unnest(['', 'signup', 'view', 'click', 'purchase', 'error']) AS set_id),
r AS (SELECT set_id, seed, seed AS node, 0 AS n FROM s, seeds UNION SELECT r.set_id, r.seed, e.target, n + 1 FROM r
  JOIN e ON r.node = e.source AND e.target_type <> r.set_id WHERE n < 3),
x AS (SELECT DISTINCT set_id, seed, node FROM r WHERE n > 0 AND seed <> node), base AS (SELECT seed, node FROM x WHERE set_id = ''),
broken AS (SELECT s.set_id AS event_type, seed, node FROM s, base WHERE s.set_id <> '' AND NOT EXISTS (SELECT 1 FROM x
  WHERE x.set_id = s.set_id AND x.seed = base.seed AND x.node = base.node)),
f AS (SELECT event_type, count(*) AS broken FROM broken GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1),
g AS (SELECT event_type, count(*) AS broken FROM broken b WHERE NOT EXISTS (SELECT 1 FROM broken c JOIN f ON c.event_type = f.event_type
  WHERE c.seed = b.seed AND c.node = b.node) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1)
SELECT 1 AS turn, event_type, broken FROM f UNION ALL SELECT 2, event_type, broken FROM g"""
)
def greedy_cut(spark, d):
    """Which types, one after the other, break most connections from views and signups."""
    e = _edges(spark, d)
    types = ("signup", "view", "click", "purchase", "error")
    sets = F.broadcast(spark.createDataFrame([("", "")] + [(t, t) for t in types], "set_id string, target_type string"))
    seeds = e.where(F.col("source_type").isin("signup", "view")).select(F.col("source").alias("node")).distinct()
    without = e.select("target", "target_type").distinct().join(sets, "target_type").select("set_id", F.col("target").alias("node"))
    starts = seeds.crossJoin(sets.select("set_id"))
    reached = causal_graph.reach(e, starts, 3, without)
    base = reached.where("set_id = ''").select("seed", "node")
    left = reached.where("set_id <> ''").select(F.col("set_id").alias("event_type"), "seed", "node")
    every = base.crossJoin(F.broadcast(spark.createDataFrame([(t,) for t in types], "event_type string")))
    return simulation.greedy_cut(written(every.join(left, ["event_type", "seed", "node"], "left_anti"), "broken"), every.select("event_type").distinct(), 2)

"""Further queries: constraints, interventions, recommendations, as-believed states."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import causal_graph, rules
from ..operators.stitched import stitched
from ..sources import tables
from .causes import _DECIDED, _edges, decided, promoted
from .claims import EDGES, RULES_SQL, _fired, proposed
from .common import HOUR, LOG, query, sequenced


@query(RULES_SQL + ", c AS (SELECT f.*, EXISTS (SELECT 1 FROM log a JOIN log x USING (user_id) JOIN log b USING (user_id) WHERE a.event_id = f.source AND b.event_id = f.target AND x.event_type = 'error' AND x.us > a.us AND x.us < b.us) AS suppressed FROM fired f) SELECT rule_id, suppressed, count(*) AS n FROM c GROUP BY 1, 2")
def rule_constraint_suppression(spark, d):
    """A declared constraint: a firing doesn't stand if an error lies between.

    The last error before each effect is found by a window, so nothing is joined by range."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    log = tables.log_events(spark, d).select("event_id", "user_id", "event_type", us.alias("us"))
    instants = log.groupBy("user_id", "us").agg(F.max(F.when(F.col("event_type") == "error", F.col("us"))).alias("erred"))
    instants = stitched(instants, "user_id", ["us"], F.floor(F.col("us") / HOUR), most_before={"last_error": "erred"})
    before = log.join(instants.select("user_id", "us", "last_error"), ["user_id", "us"])
    f = _fired(spark, d).join(before.select(F.col("event_id").alias("target"), (F.col("us") - F.col("last_error")).alias("since")), "target")
    return f.groupBy("rule_id", F.coalesce(F.col("since") < F.col("gap_us"), F.lit(False)).alias("suppressed")).agg(F.count("*").alias("n"))


@query("WITH " + LOG + f"SELECT coalesce(b.value > 20, false) AS holds, count(*) AS pairs, count(DISTINCT b.event_id) AS effects FROM log a JOIN log b USING (user_id) WHERE a.event_type = 'click' AND b.event_type = 'purchase' AND b.us > a.us AND b.us - a.us <= {12 * HOUR} GROUP BY 1")
def rule_conditional(spark, d):
    """Pairs of a conditional rule by whether its condition holds."""
    plain = rules.CausalRule("ANY", "click", "purchase", 12 * HOUR, 1.0)
    values = tables.log_events(spark, d).select(F.col("event_id").alias("target"), "value")
    f = rules.firings(tables.log_events(spark, d), [plain], "user_id").join(values, "target")
    return f.groupBy(F.coalesce(F.col("value") > 20, F.lit(False)).alias("holds")).agg(F.count("*").alias("pairs"), F.count_distinct("target").alias("effects"))


@query("WITH " + _DECIDED + "SELECT target, count(*) AS members, bool_and(decision = 'PROMOTED') AS stands FROM decided GROUP BY 1 HAVING count(*) >= 2")
def joint_groups(spark, d):
    """The causes of one effect as a joint group: all stand or none does."""
    return decided(spark, d).groupBy("target").agg(F.count("*").alias("members"), F.bool_and(F.col("decision") == "PROMOTED").alias("stands")).where("members >= 2")


@query(
    "WITH "
    + _DECIDED
    + """, h AS (SELECT source_type, sha256(source || '>' || target || '>' || kind) AS h FROM promoted)
SELECT source_type, count(*) AS edges, sum(('0x' || substr(h, 1, 15))::BIGINT)::VARCHAR || ':' || sum(('0x' || substr(h, 16,
  15))::BIGINT)::VARCHAR AS fingerprint FROM h GROUP BY 1"""
)
def projection_fingerprint(spark, d):
    """An order-free fingerprint of the promoted graph, by cause type."""
    h = F.sha2(F.concat_ws(">", F.col("source").cast("string"), F.col("target").cast("string"), "kind").cast("binary"), 256)
    half = lambda at: F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    return promoted(spark, d).groupBy("source_type").agg(F.count("*").alias("edges"), F.concat_ws(":", half(1), half(16)).alias("fingerprint"))


@query("""WITH s AS (SELECT o_orderkey, o_orderstatus AS state, o_orderdate AS valid_from,
  o_orderdate + INTERVAL 1 DAY * (o_orderkey % 5) AS known_from FROM orders), l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM lineitem
  GROUP BY 1),
v AS (SELECT o_orderkey, 'PLACED' AS state, valid_from, known_from FROM s UNION ALL SELECT o_orderkey, 'SHIPPED', shipped, shipped + INTERVAL 2 DAY
  FROM s JOIN l ON l_orderkey = o_orderkey)
SELECT state, count(*) AS orders FROM (SELECT o_orderkey, state FROM v
  WHERE valid_from <= TIMESTAMP '1997-01-01' AND known_from <= TIMESTAMP '1997-01-03' QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY
  valid_from DESC, state DESC) = 1) GROUP BY 1""")
def bitemporal_as_believed(spark, d):
    """Each order's state at an instant, as it was known two days later."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    placed = o.select("o_orderkey", F.lit("PLACED").alias("state"), F.col("o_orderdate").alias("valid_from"), (F.col("o_orderdate") + F.make_dt_interval(F.col("o_orderkey") % 5)).alias("known_from"))
    last = line.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("valid_from")).join(o.select("o_orderkey"), "o_orderkey", "left_semi")
    shipped = last.select("o_orderkey", F.lit("SHIPPED").alias("state"), "valid_from", (F.col("valid_from") + F.expr("INTERVAL 2 DAY")).alias("known_from"))
    at = lambda s: F.lit(s).cast("timestamp_ntz")
    known = placed.union(shipped).where((F.col("valid_from") <= at("1997-01-01 00:00:00")) & (F.col("known_from") <= at("1997-01-03 00:00:00")))
    now = known.groupBy("o_orderkey").agg(F.max_by("state", F.struct("valid_from", "state")).alias("state"))
    return now.groupBy("state").agg(F.count("*").alias("orders"))


@query("""WITH i AS (SELECT event_id % 5 AS kind, event_id, CASE event_id % 5 WHEN 0 THEN 'REMOVE_EVENT' WHEN 1 THEN 'SHIFT_TIMING'
  WHEN 2 THEN 'CHANGE_ATTRIBUTE' WHEN 3 THEN 'INSERT_EVENT' ELSE 'CHANGE_ENTITY_STATE' END AS intervention, event_type, value FROM events),
a AS (SELECT *, CASE WHEN event_type = 'error' THEN 'NOT_ACTIONABLE' WHEN intervention = 'CHANGE_ATTRIBUTE' AND value IS NULL THEN 'NO_ATTRIBUTE'
  WHEN intervention = 'SHIFT_TIMING' AND event_type = 'signup' THEN 'FIXED_IN_TIME' ELSE 'ADMITTED' END AS reason FROM i) SELECT intervention, reason,
  count(*) AS n FROM a GROUP BY 1, 2""")
def intervention_admission(spark, d):
    """Which proposed changes of events are admitted, and why others aren't."""
    kinds = ("REMOVE_EVENT", "SHIFT_TIMING", "CHANGE_ATTRIBUTE", "INSERT_EVENT", "CHANGE_ENTITY_STATE")
    e = tables.table(spark, d, "events")
    kind = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("event_id") % 5 + 1).cast("int"))
    i = e.select(kind.alias("intervention"), "event_type", "value")
    reason = F.when(F.col("event_type") == "error", "NOT_ACTIONABLE").when((F.col("intervention") == "CHANGE_ATTRIBUTE") & F.col("value").isNull(), "NO_ATTRIBUTE").when((F.col("intervention") == "SHIFT_TIMING") & (F.col("event_type") == "signup"), "FIXED_IN_TIME").otherwise("ADMITTED")
    return i.groupBy("intervention", reason.alias("reason")).agg(F.count("*").alias("n"))


@query("WITH " + _DECIDED + ", r AS (SELECT source, source_type, count(*) AS effects, avg(scalar) AS belief FROM promoted GROUP BY 1, 2) SELECT source, CASE WHEN effects >= 3 THEN 'HIGH_LEVERAGE' WHEN source_type = 'view' THEN 'LOW_COST' WHEN source NOT IN (SELECT target FROM promoted) THEN 'EARLY' END AS basis, CASE WHEN source_type = 'error' THEN 'NOT_ACTIONABLE' WHEN belief < 0.15 THEN 'BELIEF_TOO_LOW' ELSE 'PROPOSED' END AS verdict FROM r WHERE effects >= 3 OR source_type = 'view' OR source NOT IN (SELECT target FROM promoted)")
def candidate_interventions(spark, d):
    """Causes worth acting on: of many effects, cheap, or first in their chain."""
    p = promoted(spark, d)
    effects = p.select(F.col("target").alias("source")).distinct().withColumn("caused", F.lit(True))
    r = p.groupBy("source", "source_type").agg(F.count("*").alias("effects"), F.avg("scalar").alias("belief")).join(effects, "source", "left")
    basis = F.when(F.col("effects") >= 3, "HIGH_LEVERAGE").when(F.col("source_type") == "view", "LOW_COST").when(F.col("caused").isNull(), "EARLY")
    verdict = F.when(F.col("source_type") == "error", "NOT_ACTIONABLE").when(F.col("belief") < 0.15, "BELIEF_TOO_LOW").otherwise("PROPOSED")
    return r.select("source", basis.alias("basis"), verdict.alias("verdict")).where("basis is not null")


@query("WITH " + _DECIDED + """, t AS (SELECT DISTINCT source_type, target FROM promoted), s AS (SELECT source_type, count(*) AS own FROM t
  GROUP BY 1)
SELECT a.source_type AS first, b.source_type AS second, any_value(x.own) + any_value(y.own) AS naive,
  any_value(x.own) + any_value(y.own) - count(b.target) AS joint, count(b.target) AS overlap
FROM (SELECT p.source_type, q.source_type AS other, p.target FROM t p CROSS JOIN (SELECT source_type FROM s) q WHERE p.source_type < q.source_type) a
  LEFT JOIN t b ON b.source_type = a.other AND b.target = a.target JOIN s x ON x.source_type = a.source_type JOIN s y ON y.source_type = a.other
  WHERE b.source_type IS NOT NULL GROUP BY 1, 2""")
def portfolio_overlap(spark, d):
    """What two levers reach together, and how much of it both reach alone."""
    t = promoted(spark, d).select("source_type", "target").distinct()
    own = t.groupBy("source_type").agg(F.count("*").alias("own"))
    both = t.select(F.col("source_type").alias("first"), "target").join(t.select(F.col("source_type").alias("second"), "target"), "target").where("first < second").groupBy("first", "second").agg(F.count("*").alias("overlap"))
    r = both.join(own.select(F.col("source_type").alias("first"), F.col("own").alias("a")), "first").join(own.select(F.col("source_type").alias("second"), F.col("own").alias("b")), "second")
    return r.select("first", "second", (F.col("a") + F.col("b")).alias("naive"), (F.col("a") + F.col("b") - F.col("overlap")).alias("joint"), "overlap")


@query("WITH " + _DECIDED + ", m AS (SELECT source_type, target_type, count(DISTINCT timeline_id) AS timelines FROM promoted GROUP BY 1, 2) SELECT p.target AS outcome, p.source AS cause, m.timelines, m.timelines >= 10 AS structural FROM promoted p JOIN m USING (source_type, target_type) WHERE p.target_type = 'purchase'")
def recurrence(spark, d):
    """Of each purchase's direct causes, in how many user-days their types recur."""
    where = tables.log_events(spark, d).select(F.col("event_id").alias("source"), "timeline_id")
    p = promoted(spark, d)
    m = causal_graph.motifs(p.join(where, "source"), 1).drop("occurrences")
    hit = p.where("target_type = 'purchase'").join(F.broadcast(m), ["source_type", "target_type"])
    return hit.select(F.col("target").alias("outcome"), F.col("source").alias("cause"), "timelines", (F.col("timelines") >= 10).alias("structural"))


@query("WITH " + LOG + ", m AS (SELECT user_id, event_id, event_type, ts FROM log WHERE event_type IN ('view', 'click') UNION ALL SELECT user_id, event_id, event_type, ts FROM log WHERE event_type = 'purchase') SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS position FROM m")
def timeline_join(spark, d):
    """Two timelines of a user merged into one order."""
    from ..operators.sequences import sequence

    e = tables.log_events(spark, d)
    both = e.where(F.col("event_type").isin("view", "click")).unionByName(e.where("event_type = 'purchase'"))
    return sequence(both, "user_id").select("user_id", "event_id", "event_type", "position")


@query("SELECT event_type, count(ts) AS parsed, count(*) - count(ts) AS unparsed, min(ts) AS earliest, max(ts) AS latest, count(*) FILTER (epoch_us(ts) % 60000000 <> 0) AS with_seconds FROM events GROUP BY 1")
def temporal_summary(spark, d):
    e = tables.table(spark, d, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return e.groupBy("event_type").agg(F.count("ts").alias("parsed"), (F.count("*") - F.count("ts")).alias("unparsed"), F.min("ts").alias("earliest"), F.max("ts").alias("latest"), F.count_if(us % 60000000 != 0).alias("with_seconds"))


@query("""SELECT l_orderkey AS entity_id, 'LINE_SHIPPED' AS event_type, l_linenumber AS line, l_shipdate::DATE::VARCHAR AS day FROM lineitem
  WHERE l_quantity > 25 AND l_linestatus = 'F' UNION ALL SELECT o_orderkey, 'ORDER_PLACED', 0, o_orderdate::DATE::VARCHAR FROM orders
  WHERE o_totalprice > 100000""")
def emit_events(spark, d):
    """Events that declared conditions on rows emit."""
    from ..functions.conditions import compile_condition

    line = tables.table(spark, d, "lineitem").where(compile_condition(("all", ("l_quantity", ">", 25), ("l_linestatus", "=", "F"))))
    o = tables.table(spark, d, "orders").where(compile_condition(("o_totalprice", ">", 100000)))
    a = line.select(F.col("l_orderkey").alias("entity_id"), F.lit("LINE_SHIPPED").alias("event_type"), F.col("l_linenumber").alias("line"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return a.union(o.select("o_orderkey", F.lit("ORDER_PLACED"), F.lit(0), F.date_format("o_orderdate", "yyyy-MM-dd")))


@query("WITH " + EDGES + ", c AS (SELECT target, count(*) AS n FROM proposed GROUP BY 1) SELECT CASE WHEN n <= 1 THEN 1 WHEN n <= 2 THEN 2 WHEN n <= 5 THEN 5 WHEN n <= 10 THEN 10 ELSE 20 END AS at_most, count(*) AS effects FROM c GROUP BY 1")
def candidates_per_effect(spark, d):
    """How many proposals effects have, in buckets."""
    c = proposed(spark, d).groupBy("target").agg(F.count("*").alias("n"))
    bucket = F.when(F.col("n") <= 1, 1).when(F.col("n") <= 2, 2).when(F.col("n") <= 5, 5).when(F.col("n") <= 10, 10).otherwise(20)
    return c.groupBy(bucket.alias("at_most")).agg(F.count("*").alias("effects"))


@query("WITH " + LOG + "SELECT a.event_type AS source_type, b.event_type AS target_type, count(*) AS gaps, min(b.us - a.us) AS least, max(b.us - a.us) AS greatest FROM seq a JOIN seq b ON a.timeline_id = b.timeline_id AND b.position = a.position + 1 GROUP BY 1, 2")
def neighbour_gaps(spark, d):
    """Gaps between events that follow each other within a user-day."""
    w = Window.partitionBy("timeline_id").orderBy("position")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    s = sequenced(spark, d).select("event_type", us.alias("us"), F.lead("event_type").over(w).alias("next"), F.lead(us).over(w).alias("next_us")).where("next is not null")
    return s.groupBy(F.col("event_type").alias("source_type"), F.col("next").alias("target_type")).agg(F.count("*").alias("gaps"), F.min(F.col("next_us") - F.col("us")).alias("least"), F.max(F.col("next_us") - F.col("us")).alias("greatest"))


@query("WITH " + _DECIDED + ", e AS (SELECT DISTINCT source, target FROM promoted) SELECT CASE WHEN EXISTS (SELECT 1 FROM e r WHERE r.source = e.target AND r.target = e.source) THEN 'BOTH_WAYS' ELSE 'ONE_WAY' END AS direction, count(*) AS edges FROM e GROUP BY 1")
def contradictions(spark, d):
    """Promoted edges whose reverse is promoted too."""
    e = _edges(spark, d).select("source", "target").distinct()
    back = e.select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("BOTH_WAYS").alias("direction"))
    return e.join(back, ["source", "target"], "left").groupBy(F.coalesce("direction", F.lit("ONE_WAY")).alias("direction")).agg(F.count("*").alias("edges"))

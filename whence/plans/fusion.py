"""Queries on what candidates rest on: their evidence, their payloads, and what the cap leaves out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import candidates, evidence
from ..shared import written
from ..sources import tables
from .claims import _NEAR, EDGES, NEARBY, RULES, RULES_SQL, _fired, proposed
from .common import WINDOWS, query

#: Ids of evidence that a fused candidate carries.
CARRIED = 2
_KINDS = " ".join(f"WHEN '{r.rule_id}' THEN '{candidates.rule_kind(r)}'" for r in RULES)


@query(
    RULES_SQL
    + f""", claims AS (SELECT source, target, CASE rule_id {_KINDS} END AS kind, 'rule:' || rule_id AS evidence, 'rule:' || rule_id AS payload FROM fired
  UNION ALL SELECT a.event_id, b.event_id, 'DIRECT', 'window:' || a.event_type || '>' || b.event_type, 'window:' || a.event_type || '>' || b.event_type
    FROM log a JOIN log b USING (user_id) WHERE b.us > a.us AND ({_NEAR})
  UNION ALL SELECT source, target, 'DIRECT', 'decade:' || floor(a_k / 10)::BIGINT, 'decade' FROM pairs WHERE floor(a_k / 10) = floor(b_k / 10)
  UNION ALL SELECT a.event_id, b.event_id, 'STRUCTURAL', 'user:' || user_id, 'entity' FROM log a JOIN log b USING (user_id)
    WHERE b.us > a.us AND b.us - a.us <= {NEARBY}),
p AS (SELECT source, target, kind, count(*) AS payloads, sum(('0x' || substr(sha256(payload), 1, 15))::BIGINT)::VARCHAR || ':' ||
  sum(('0x' || substr(sha256(payload), 16, 15))::BIGINT)::VARCHAR AS payload FROM (SELECT DISTINCT source, target, kind, payload FROM claims) GROUP BY 1, 2, 3)
SELECT source, target, kind, count(*) AS claims, count(DISTINCT evidence) AS n_evidence,
  array_to_string(list_sort(list_distinct(list(evidence)))[1:{CARRIED}], ',') AS evidence, greatest(count(DISTINCT evidence) - {CARRIED}, 0) AS left_out,
  any_value(p.payload) AS payload, any_value(payloads) > 1 AS diverges FROM claims JOIN p USING (source, target, kind) GROUP BY 1, 2, 3"""
)
def fuse_evidence(spark, d):
    """Candidates of four generators with the evidence that they rest on, and whether its payloads diverge."""
    from ..operators.sequences import sequence

    e = written(tables.log_events(spark, d), "log")
    near = candidates.near_pairs(e, "user_id", max(hi for _, hi in WINDOWS.values()))
    ends = [F.col("cause.event_id").alias("source"), F.col("effect.event_id").alias("target")]
    types = F.concat(F.lit("window:"), F.col("cause.event_type"), F.lit(">"), F.col("effect.event_type"))
    kind = F.create_map(*[F.lit(x) for r in RULES for x in (r.rule_id, candidates.rule_kind(r))])
    rule = F.concat(F.lit("rule:"), F.col("rule_id"))
    fired = _fired(spark, d).select("source", "target", F.element_at(kind, F.col("rule_id")).alias("kind"), rule.alias("evidence"), rule.alias("payload"))
    window = near.where(candidates.within_windows(WINDOWS)).select(*ends, F.lit("DIRECT").alias("kind"), types.alias("evidence"), types.alias("payload"))
    days = candidates.ordered_pairs(sequence(e)).where("cause.decade = effect.decade")
    decade = days.select(*ends, F.lit("DIRECT").alias("kind"), F.concat(F.lit("decade:"), F.col("cause.decade").cast("string")).alias("evidence"), F.lit("decade").alias("payload"))
    own = candidates.near_pairs(e, "user_id", NEARBY)
    user = own.select(*ends, F.lit("STRUCTURAL").alias("kind"), F.concat(F.lit("user:"), F.col("cause.user_id").cast("string")).alias("evidence"), F.lit("entity").alias("payload"))
    return evidence.merged(written(reduce(DataFrame.unionByName, [fired, window, decade, user]), "claims"), CARRIED)


@query(
    "WITH "
    + EDGES
    + """, t AS (SELECT *, row_number() OVER (PARTITION BY target, generator ORDER BY source, kind) AS turn FROM proposed),
r AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY turn, generator) AS taken FROM t)
SELECT generator, count(*) AS proposed, count(*) FILTER (taken <= 2) AS kept, count(*) FILTER (taken > 2) AS dropped FROM r GROUP BY 1"""
)
def cap_ledger(spark, d):
    """What a cap of two proposals an effect takes of each generator's."""
    every = written(proposed(spark, d), "proposed")
    return evidence.ledger(every, candidates.round_robin(every, 2))

"""Queries on raw rows: shape, mapping, layers, times of occurrence, participants, identity, layers of knowledge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mapping, temporal
from ..functions.temporal import interval
from ..operators import sequences
from ..operators.stitched import bucket_of, stitched
from ..shared import new_path
from ..sources import delimited, tables
from .common import LOG, query, sequenced

HEADER = ("order", "customer", "status", "total", "placed", "priority")
ORDERS = mapping.Mapping(
    "order",
    ("order", "customer"),
    (
        mapping.Field("status", "status", ("TRIM", "UPPERCASE"), {"O": "OPEN", "P": "PART", "F": "FULFILLED"}),
        mapping.Field("total", "total", ("TRIM", "PARSE_DECIMAL")),
        mapping.Field("priority", "priority", ("TRIM", "EMPTY_TO_NULL")),
    ),
    (("placed_at", "placed", "MM/dd/yyyy HH:mm", "MINUTE"),),
)


def raw_lines(spark, d) -> DataFrame:
    """Orders as a source's lines, some of them too short, too long or with values that can't be mapped."""
    key = F.col("o_orderkey")
    placed = F.when(key % 83 == 0, F.lit("99/99/9999")).otherwise(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"))
    status = F.when(key % 79 == 0, F.lit("x")).otherwise(F.concat(F.lower("o_orderstatus"), F.lit(" ")))
    total = F.when(key % 73 == 0, F.lit("n/a")).otherwise((F.col("o_totalprice") * 100).cast("bigint").cast("string"))
    first = [key.cast("string"), F.col("o_custkey").cast("string"), status, total]
    rest = F.when(key % 97 == 0, F.lit(None)).otherwise(F.concat_ws(";", placed, F.concat(F.lit('"'), F.col("o_orderpriority"), F.lit(';"'))))
    more = F.when((key % 89 == 0) & (key % 97 != 0), F.lit("extra;more;still"))
    return tables.table(spark, d, "orders").select(key.alias("row_number"), F.concat_ws(";", *first, rest, more).alias("line"))


def judged(spark, d) -> DataFrame:
    rows = delimited.records(raw_lines(spark, d), HEADER, ";", "v1")
    found = mapping.apply(rows, ORDERS._replace(fields=tuple(f._replace(name=f"mapped_{f.name}") for f in ORDERS.fields)))
    return found.withColumn("reasons", F.concat("reasons", F.when(F.col("shape") != "FULL", F.array(F.concat("shape", F.lit("_ROW")))).otherwise(F.array().cast("array<string>"))))


_RAW = """r AS (SELECT *, o_orderkey % 97 = 0 AS short, o_orderkey % 89 = 0 AND o_orderkey % 97 <> 0 AS long_,
  o_orderkey % 97 <> 0 AND o_orderkey % 83 <> 0 AS timed,
  o_orderkey % 79 <> 0 AS known, o_orderkey % 73 <> 0 AS numbered FROM orders)"""


@query(
    "WITH "
    + _RAW
    + """ SELECT 'rec:' || substr(sha256('v1|' || o_orderkey), 1, 16) AS evidence_id, o_orderkey AS row_number, CASE WHEN short THEN 'SHORT'
  WHEN long_ THEN 'LONG' ELSE 'FULL' END AS shape,
  CASE WHEN short THEN '' ELSE o_orderpriority || ';' END AS priority, CASE WHEN long_ THEN 'extra' END AS "__surplus_1", CASE
  WHEN long_ THEN 'more;still' END AS "__surplus_2" FROM r"""
)
def raw_records(spark, d):
    """Every line as a record: short ones padded, what long ones have too much kept aside."""
    rows = delimited.records(raw_lines(spark, d), HEADER, ";", "v1")
    return rows.select("evidence_id", "row_number", "shape", "priority", "__surplus_1", "__surplus_2")


@query(
    "WITH "
    + _RAW
    + """ SELECT o_orderkey AS row_number, 'order:' || substr(sha256(o_orderkey || '|' || o_custkey), 1, 16) AS address, CASE WHEN known THEN
  CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'P' THEN 'PART' ELSE 'FULFILLED' END END AS status,
  CASE WHEN numbered THEN trunc(o_totalprice * 100)::DOUBLE END AS total, CASE WHEN timed THEN date_trunc('minute', o_orderdate) END AS t_earliest,
  CASE WHEN timed THEN 'MINUTE' ELSE 'UNKNOWN' END AS precision FROM r"""
)
def raw_mapping(spark, d):
    """Lines mapped to typed records: natural key, enumeration, number, instant to the minute."""
    return judged(spark, d).select("row_number", "address", F.col("mapped_status").alias("status"), F.col("mapped_total").alias("total"), "placed_at.t_earliest", "placed_at.precision")


@query(
    "WITH "
    + _RAW
    + """, c AS (SELECT unnest([CASE WHEN NOT known THEN 'UNMAPPED_mapped_status' END, CASE WHEN NOT numbered THEN 'UNPARSED_mapped_total' END, CASE
  WHEN NOT timed THEN 'UNPARSED_placed_at' END,
  CASE WHEN short THEN 'SHORT_ROW' WHEN long_ THEN 'LONG_ROW' END, CASE
  WHEN known AND numbered AND timed AND NOT short AND NOT long_ THEN 'CLEAN' END]) AS code FROM r)
SELECT code, count(*) AS rows FROM c WHERE code IS NOT NULL GROUP BY 1"""
)
def raw_ledger(spark, d):
    """How many lines are clean, and how many are put aside for each reason."""
    codes = F.when(F.size("reasons") == 0, F.array(F.lit("CLEAN"))).otherwise(F.col("reasons"))
    return judged(spark, d).select(F.explode(codes).alias("code")).groupBy("code").agg(F.count("*").alias("rows"))


@query(
    "WITH "
    + _RAW
    + """ SELECT 'status' AS field, count(*) AS rows, count(*) FILTER (known) AS mapped, 'ENUMERATION' AS kind FROM r UNION ALL SELECT 'total',
  count(*), count(*) FILTER (numbered), 'NUMBER' FROM r
UNION ALL SELECT 'placed', count(*), count(*) FILTER (timed), 'INSTANT' FROM r UNION ALL SELECT 'priority', count(*), count(*) FILTER (NOT short),
  'TEXT' FROM r
UNION ALL SELECT c, count(*), 0, 'UNCLAIMED' FROM r, (SELECT unnest(['__surplus_1', '__surplus_2']) AS c) GROUP BY 1"""
)
def mapping_coverage(spark, d):
    """Of each column of the source how many values the mapping takes; columns that nothing claims too."""
    j = judged(spark, d)
    kinds = {"status": ("mapped_status", "ENUMERATION"), "total": ("mapped_total", "NUMBER"), "placed": ("placed_at.t_earliest", "INSTANT"), "priority": ("mapped_priority", "TEXT")}
    taken = j.agg(F.count("*").alias("rows"), *[F.count(c).alias(n) for n, (c, _) in kinds.items()])
    made = [F.struct(F.lit(n).alias("field"), F.col("rows"), F.col(n).alias("mapped"), F.lit(k).alias("kind")) for n, (_, k) in kinds.items()]
    made += [F.struct(F.lit(n).alias("field"), F.col("rows"), F.lit(0).cast("bigint").alias("mapped"), F.lit("UNCLAIMED").alias("kind")) for n in ("__surplus_1", "__surplus_2")]
    return taken.select(F.inline(F.array(*made)))


@query(
    """SELECT 'order' AS entity_type, count(*) AS read, count(DISTINCT o_orderkey) AS entities, count(*) - count(DISTINCT o_orderkey) AS repeated
  FROM orders
UNION ALL SELECT 'customer', count(*), count(DISTINCT o_custkey), count(*) - count(DISTINCT o_custkey) FROM orders
UNION ALL SELECT 'part', count(*), count(DISTINCT l_partkey), count(*) - count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'supplier',
  count(*), count(DISTINCT l_suppkey), count(*) - count(DISTINCT l_suppkey) FROM lineitem"""
)
def entity_reconciliation(spark, d):
    """Of each type of entity: mentions read, entities, mentions that repeat one."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    said = [(o, "order", "o_orderkey"), (o, "customer", "o_custkey"), (line, "part", "l_partkey"), (line, "supplier", "l_suppkey")]
    keys = reduce(DataFrame.union, [t.select(F.lit(n).alias("entity_type"), F.col(c).alias("key")) for t, n, c in said])
    each = keys.groupBy("entity_type", "key").agg(F.count("*").alias("n")).groupBy("entity_type")
    return each.agg(F.sum("n").alias("read"), F.count("*").alias("entities"), (F.sum("n") - F.count("*")).alias("repeated"))


_TIMES = """t AS (SELECT date_trunc('day', o_orderdate) AS a0, date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS a1,
  date_trunc('day', l_shipdate) AS b0, date_trunc('day', l_shipdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND AS b1, l_linenumber FROM orders
  JOIN lineitem ON o_orderkey = l_orderkey)"""


def _line_times(spark, d) -> DataFrame:
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    j = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return j.select(interval(F.col("o_orderdate"), "DAY").alias("placed"), interval(F.col("l_shipdate"), "DAY").alias("shipped"), "l_linenumber")


@query(
    "WITH "
    + _TIMES
    + """, p AS (SELECT 'PACKED' AS event_type, CASE WHEN a0 > b1 THEN 'UNKNOWN' ELSE 'DAY' END AS precision, CASE
  WHEN a0 > b1 THEN 'ASSUMED' ELSE 'INFERRED' END AS provenance, CASE WHEN a0 <= b1 THEN a0 END AS e, CASE WHEN a0 <= b1 THEN b1 END AS l FROM t
  UNION ALL SELECT 'DUE', 'DAY', 'INFERRED', a0 + INTERVAL 1 DAY * l_linenumber, a1 + INTERVAL 1 DAY * l_linenumber FROM t UNION ALL SELECT 'SHIPPED',
  'DAY', 'OBSERVED', b0, b1 FROM t UNION ALL SELECT 'INSPECTED', 'UNKNOWN', 'ASSUMED', NULL, NULL FROM t)
SELECT event_type, precision, provenance, count(*) AS n, min(e) AS earliest, max(l) AS latest FROM p GROUP BY 1, 2, 3"""
)
def occurrence_policies(spark, d):
    """When things happened, by declared policy: from the source, between two known events, an offset from one, or unknown."""
    t = _line_times(spark, d)
    made = {"PACKED": mapping.bounded_between("placed", "shipped"), "DUE": mapping.offset_from("placed", F.col("l_linenumber")), "SHIPPED": F.col("shipped"), "INSPECTED": mapping.unknown()}
    rows = t.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, made)), F.array(*made.values()))).alias("event_type", "at"))
    return rows.groupBy("event_type", "at.precision", "at.provenance").agg(F.count("*").alias("n"), F.min("at.t_earliest").alias("earliest"), F.max("at.t_latest").alias("latest"))


@query(
    "WITH "
    + _TIMES
    + """, p AS (SELECT a0 > b1 AS inverted, a0, b1, a0 + INTERVAL 1 DAY * l_linenumber AS d0, a1 + INTERVAL 1 DAY * l_linenumber AS d1, b0 FROM t)
SELECT CASE WHEN d0 >= b1 THEN 'VIOLATION' ELSE 'UNDETERMINED' END AS verdict, CASE WHEN d0 >= b1 THEN 'VIOLATION'
  WHEN d1 < b0 THEN 'CERTAIN' ELSE 'UNDETERMINED' END AS simulated, d1 < b0 AS strictly_before, count(*) AS n FROM p GROUP BY 1, 2, 3"""
)
def simulated_precedence(spark, d):
    """Does the due day precede the shipping day?  A verdict on facts doesn't trust the inferred day, a simulation does."""
    t = _line_times(spark, d).select(mapping.offset_from("placed", F.col("l_linenumber")).alias("due"), "shipped")
    v = t.select(temporal.verdict("due", "shipped").alias("verdict"), mapping.simulated_precedes("due", "shipped").alias("simulated"), mapping.strictly_before("due", "shipped").alias("strictly_before"))
    return v.groupBy("verdict", "simulated", "strictly_before").agg(F.count("*").alias("n"))


@query(
    """WITH j AS (SELECT l_returnflag, l_linestatus, l_shipdate >= o_orderdate AS holds FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
s AS (SELECT l_returnflag AS cause_source, l_linestatus AS effect_source, count(*) AS n, avg(CASE WHEN holds THEN 1.0 ELSE 0.0 END) AS share FROM j
  GROUP BY 1, 2)
SELECT cause_source, effect_source, CASE WHEN share >= 0.5 THEN 'PRECEDES' ELSE 'UNSETTLED' END AS derived, n AS pairs FROM s"""
)
def derived_precedence(spark, d):
    """Whether orders precede shipments, as derived from the data by pair of sources and looked up for each pair."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    j = o.join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    j = j.select(F.col("l_returnflag").alias("cause_source"), F.col("l_linestatus").alias("effect_source"), (F.col("l_shipdate") >= F.col("o_orderdate")).alias("holds"))
    lookup = j.groupBy("cause_source", "effect_source").agg(F.avg(F.col("holds").cast("double")).alias("share"))
    lookup = lookup.select("cause_source", "effect_source", F.when(F.col("share") >= 0.5, "PRECEDES").otherwise("UNSETTLED").alias("derived"))
    return j.join(F.broadcast(lookup), ["cause_source", "effect_source"]).groupBy("cause_source", "effect_source", "derived").agg(F.count("*").alias("pairs"))


@query(
    """WITH e AS (SELECT l_returnflag, o.o_orderkey IS NOT NULL AS has_order, s.s_suppkey IS NOT NULL AS has_supplier FROM lineitem LEFT
  JOIN (SELECT * FROM orders WHERE o_orderstatus <> 'P') o ON l_orderkey = o.o_orderkey
  LEFT JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON l_suppkey = s.s_suppkey)
SELECT l_returnflag, count(*) AS events, count(*) FILTER (NOT has_order) AS suppressed,
  count(*) FILTER (has_order AND NOT has_supplier) AS orphan_targets, count(*) FILTER (has_order) AS emitted FROM e GROUP BY 1"""
)
def participants(spark, d):
    """Shipments with their participants: one without its order (the source) isn't emitted, an unknown supplier (a target) is an orphan."""
    line = tables.table(spark, d, "lineitem")
    o = tables.table(spark, d, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(True).alias("source"))
    s = tables.table(spark, d, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("l_suppkey"), F.lit(True).alias("target"))
    e = line.join(o, "l_orderkey", "left").join(s, "l_suppkey", "left")
    source, target = F.col("source").isNotNull(), F.col("target").isNotNull()
    return e.groupBy("l_returnflag").agg(F.count("*").alias("events"), F.count_if(~source).alias("suppressed"), F.count_if(source & ~target).alias("orphan_targets"), F.count_if(source).alias("emitted"))


@query(
    """SELECT n_name AS nation, count(*) AS pairs, count(DISTINCT o_orderkey) AS orders FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
  JOIN nation ON n_nationkey = c_nationkey
WHERE l_shipdate > o_orderdate GROUP BY 1"""
)
def typed_relationship_pairs(spark, d):
    """Orders and later shipments whose customer and supplier a LOCATED_IN relationship ties to one nation, from both ends."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    c, s, n = (tables.table(spark, d, t) for t in ("customer", "supplier", "nation"))
    located = c.select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("from"), F.col("c_nationkey").alias("to")).union(s.select(F.lit("supplier"), "s_suppkey", "s_nationkey"))
    end = lambda kind, key, to: located.where(F.col("kind") == kind).select(F.col("from").alias(key), F.col("to").alias(to))
    j = o.join(end("customer", "o_custkey", "cause_to"), "o_custkey").join(line, F.col("o_orderkey") == F.col("l_orderkey")).join(end("supplier", "l_suppkey", "effect_to"), "l_suppkey")
    hit = j.where((F.col("cause_to") == F.col("effect_to")) & (F.col("l_shipdate") > F.col("o_orderdate"))).join(n, F.col("cause_to") == F.col("n_nationkey"))
    return hit.groupBy(F.col("n_name").alias("nation")).agg(F.count("*").alias("pairs"), F.count_distinct("o_orderkey").alias("orders"))


@query("SELECT event_type, count(*) AS staged, count(*) FILTER (event_id % 3 <> 0) AS added FROM events WHERE event_id % 2 = 0 OR event_id % 3 = 0 GROUP BY 1")
def staged_rows_added(spark, d):
    """Rows of a later run that an earlier one didn't bring already."""
    e = tables.table(spark, d, "events").select("event_id", "event_type")
    staged, present = e.where("event_id % 2 = 0 or event_id % 3 = 0"), e.where("event_id % 3 = 0")
    added = staged.join(present, "event_id", "left_anti").groupBy("event_type").agg(F.count("*").alias("added"))
    return staged.groupBy("event_type").agg(F.count("*").alias("staged")).join(added, "event_type", "left").na.fill(0, ["added"])


@query(
    """WITH l AS (SELECT l_orderkey, bool_and(l_linestatus = 'F') AS all_f, bool_and(l_linestatus = 'O') AS all_o FROM lineitem GROUP BY 1),
f AS (SELECT CASE WHEN o_orderstatus NOT IN ('O', 'P', 'F') THEN 'UNKNOWN_STATE'
  WHEN l_orderkey IS NULL AND o_orderstatus <> 'O' THEN 'UNREACHABLE_STATE'
  WHEN o_orderstatus = 'F' AND NOT all_f OR o_orderstatus = 'O' AND NOT all_o THEN 'CONTRADICTS_LINES' ELSE 'CONSISTENT' END AS code, o_orderstatus
  FROM orders LEFT JOIN l ON o_orderkey = l_orderkey)
SELECT code, o_orderstatus AS state, count(*) AS orders FROM f GROUP BY 1, 2"""
)
def lifecycle_contradictions(spark, d):
    """Orders whose state isn't one of the machine's, can't have been reached, or isn't that of their lines."""
    line = tables.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.bool_and(F.col("l_linestatus") == "F").alias("all_f"), F.bool_and(F.col("l_linestatus") == "O").alias("all_o"))
    j = tables.table(spark, d, "orders").join(line, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    s = F.col("o_orderstatus")
    code = F.when(~s.isin("O", "P", "F"), "UNKNOWN_STATE").when(F.col("l_orderkey").isNull() & (s != "O"), "UNREACHABLE_STATE")
    code = code.when(((s == "F") & ~F.col("all_f")) | ((s == "O") & ~F.col("all_o")), "CONTRADICTS_LINES").otherwise("CONSISTENT")
    return j.groupBy(code.alias("code"), s.alias("state")).agg(F.count("*").alias("orders"))


@query(
    """WITH p AS (SELECT count(*) AS n, count(*) FILTER (c_acctbal < 0) AS negative, count(DISTINCT c_mktsegment) AS segments,
  count(DISTINCT c_custkey) AS keys FROM customer)
SELECT 'PROFILE' AS ledger, 'NEGATIVE_BALANCE' AS code, CASE WHEN negative > 0 THEN 'FOUND' ELSE 'HOLDS' END AS outcome, negative AS rows FROM p
  UNION ALL SELECT 'CONSTRAINT', 'KEY_IS_UNIQUE', CASE WHEN keys = n THEN 'HOLDS' ELSE 'FOUND' END, n - keys FROM p
UNION ALL SELECT 'CONSTRAINT', 'FIVE_SEGMENTS', CASE WHEN segments = 5 THEN 'HOLDS' ELSE 'FOUND' END, segments FROM p UNION ALL SELECT 'NOT_CHECKED',
  'PHONE_FORMAT', 'NO_COLUMN', n FROM p"""
)
def findings_ledger(spark, d):
    """What a profile finds, which headline constraints hold, and what couldn't be checked."""
    c = tables.table(spark, d, "customer")
    p = c.agg(F.count("*").alias("n"), F.count_if(F.col("c_acctbal") < 0).alias("negative"), F.count_distinct("c_mktsegment").alias("segments"), F.count_distinct("c_custkey").alias("keys"))
    found = lambda bad: F.when(bad, "FOUND").otherwise("HOLDS")
    rows = [("PROFILE", "NEGATIVE_BALANCE", found(F.col("negative") > 0), F.col("negative")), ("CONSTRAINT", "KEY_IS_UNIQUE", found(F.col("keys") != F.col("n")), F.col("n") - F.col("keys"))]
    rows += [("CONSTRAINT", "FIVE_SEGMENTS", found(F.col("segments") != 5), F.col("segments"))]
    rows += [("NOT_CHECKED", "PHONE_FORMAT", F.lit("NO_COLUMN"), F.col("n"))] if "c_phone" not in c.columns else []
    return p.select(F.inline(F.array(*[F.struct(F.lit(a).alias("ledger"), F.lit(b).alias("code"), o.alias("outcome"), n.alias("rows")) for a, b, o, n in rows])))


#: Types whose events are observed, and the declared components of those that are derived.
DERIVED = {"error": {"rule": 0.5, "temporal": 0.8}, "purchase": {"rule": 0.9}}


@query("SELECT event_type, event_type NOT IN ('error', 'purchase') AS observed, CASE event_type WHEN 'error' THEN 0.5 WHEN 'purchase' THEN 0.9 ELSE 1.0 END::DOUBLE AS rule, CASE event_type WHEN 'error' THEN 0.8 END::DOUBLE AS temporal, count(*) AS events FROM events GROUP BY event_type")
def event_confidence(spark, d):
    """Observed events are sure; derived ones have the components that their type declares."""
    part = lambda name: reduce(lambda c, t: F.when(F.col("event_type") == t, F.lit(DERIVED[t].get(name)).cast("double")).otherwise(c), DERIVED, F.lit(1.0 if name == "rule" else None).cast("double"))
    e = tables.table(spark, d, "events")
    return e.groupBy("event_type", (~F.col("event_type").isin(*DERIVED)).alias("observed"), part("rule").alias("rule"), part("temporal").alias("temporal")).agg(F.count("*").alias("events"))


@query(
    "WITH "
    + LOG
    + """, s AS (SELECT unnest(['signup', 'view', 'click', 'purchase']) AS step), t AS (SELECT DISTINCT timeline_id FROM seq),
  m AS (SELECT t.timeline_id, step FROM t, s WHERE NOT EXISTS (SELECT 1 FROM seq x WHERE x.timeline_id = t.timeline_id AND x.event_type = step))
SELECT step AS expected_type, CASE WHEN step = 'signup' THEN 'EMIT_GAP_MARKER' ELSE 'RECORD_GAP' END AS policy, count(*) AS timelines FROM m
  GROUP BY 1, 2"""
)
def gap_markers(spark, d):
    """Steps that user-days lack: one that no rule emits gets a marker, the others are noted."""
    g = sequences.gaps(sequenced(spark, d), ("signup", "view", "click", "purchase"))
    policy = F.when(F.col("expected_type").isin("signup"), "EMIT_GAP_MARKER").otherwise("RECORD_GAP")
    return g.groupBy("expected_type", policy.alias("policy")).agg(F.count("*").alias("timelines"))


@query(
    """WITH s AS (SELECT o_orderkey, o_orderstatus AS state, o_orderdate AS known_from, c_acctbal < 0 AS retracted FROM orders
  JOIN customer ON o_custkey = c_custkey)
SELECT state, count(*) AS stated, count(*) FILTER (retracted) AS retracted, count(*) FILTER (NOT retracted) AS believed FROM s
  WHERE known_from <= TIMESTAMP '1998-01-01' GROUP BY 1"""
)
def retracted_states(spark, d):
    """States that were retracted: their period of knowledge is closed by a later row, nothing is overwritten."""
    o = tables.table(spark, d, "orders").where(F.col("o_orderdate") <= F.lit("1998-01-01 00:00:00").cast("timestamp_ntz"))
    bad = tables.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    never = F.lit(None).cast("timestamp_ntz")
    opened = o.select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").alias("written"), never.alias("known_to"))
    closed = o.join(bad, "o_custkey", "left_semi").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.timestamp_add("DAY", F.lit(1), "o_orderdate").alias("written"), F.timestamp_add("DAY", F.lit(1), "o_orderdate").alias("known_to"))
    last = opened.union(closed).groupBy("o_orderkey", "state").agg(F.max_by("known_to", "written").alias("known_to"))
    gone = F.col("known_to").isNotNull()
    return last.groupBy("state").agg(F.count("*").alias("stated"), F.count_if(gone).alias("retracted"), F.count_if(~gone).alias("believed"))


@query(
    """SELECT 'PLACED_BY' AS kind, count(*) AS edges, count(DISTINCT o_custkey) AS targets FROM orders UNION ALL SELECT 'CONTAINS', count(*),
  count(DISTINCT l_partkey) FROM lineitem UNION ALL SELECT 'SUPPLIED_BY', count(*), count(DISTINCT l_suppkey) FROM lineitem
UNION ALL SELECT 'CUSTOMER_OF', count(*), count(DISTINCT c_nationkey) FROM customer UNION ALL SELECT 'SUPPLIER_OF', count(*),
  count(DISTINCT s_nationkey) FROM supplier UNION ALL SELECT 'PART_OF_REGION', count(*), count(DISTINCT n_regionkey) FROM nation
UNION ALL SELECT 'ACTED', count(*), count(DISTINCT user_id) FROM events UNION ALL SELECT 'OF_TYPE', count(*), count(DISTINCT event_type) FROM events
  UNION ALL SELECT 'PRECEDES', count(*) - count(DISTINCT user_id), count(*) - count(DISTINCT user_id) FROM events"""
)
def projected_edges(spark, d):
    """The graph that entities and events project to: nine kinds of edges in one stream."""
    t = lambda n: tables.table(spark, d, n)
    edge = lambda df, kind, a, b: df.select(F.lit(kind).alias("kind"), F.col(a).cast("string").alias("source"), F.col(b).cast("string").alias("target"))
    follows = stitched(t("events").select("user_id", "ts", "event_id"), "user_id", ["ts", "event_id"], bucket_of(F.col("ts")), after={"next": "event_id"}).where("next is not null")
    line, e = t("lineitem").withColumn("line", F.concat_ws("-", "l_orderkey", "l_linenumber")), t("events")
    every = [edge(t("orders"), "PLACED_BY", "o_orderkey", "o_custkey"), edge(line, "CONTAINS", "line", "l_partkey"), edge(line, "SUPPLIED_BY", "line", "l_suppkey")]
    every += [edge(t("customer"), "CUSTOMER_OF", "c_custkey", "c_nationkey"), edge(t("supplier"), "SUPPLIER_OF", "s_suppkey", "s_nationkey"), edge(t("nation"), "PART_OF_REGION", "n_nationkey", "n_regionkey")]
    every += [edge(e, "ACTED", "event_id", "user_id"), edge(e, "OF_TYPE", "event_id", "event_type"), edge(follows, "PRECEDES", "event_id", "next")]
    return reduce(DataFrame.unionByName, every).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("target").alias("targets"))


@query(
    """WITH j AS (SELECT event_type, '{"event_id":' || event_id || ',"event_type":"' || event_type || '","props":"' || replace(props, '"', '\\"') || '","schema":1,"user_id":' || user_id || '}' AS json FROM events)
SELECT event_type, count(*) AS events, max(length(json)) AS longest, sum(('0x' || substr(sha256(json), 1, 15))::BIGINT)::VARCHAR AS fingerprint,
  count(*) AS round_trips FROM j GROUP BY 1"""
)
def canonical_json(spark, d):
    """Events as JSON with sorted keys and a schema version: equal rows have equal text, and it reads back."""
    e = tables.table(spark, d, "events")
    own = F.struct(*[F.lit(1).alias("schema") if c == "schema" else F.col(c) for c in sorted(("event_id", "event_type", "props", "user_id", "schema"))])
    j = e.select("event_type", "event_id", "user_id", "props", F.to_json(own).alias("json"))
    back = F.from_json("json", "event_id bigint, event_type string, props string, schema int, user_id bigint")
    same = (back["event_id"] == F.col("event_id")) & (back["props"] == F.col("props")) & (back["user_id"] == F.col("user_id"))
    h = F.conv(F.substring(F.sha2("json", 256), 1, 15), 16, 10).cast("decimal(20,0)")
    return j.groupBy("event_type").agg(F.count("*").alias("events"), F.max(F.length("json")).cast("bigint").alias("longest"), F.sum(h).cast("string").alias("fingerprint"), F.count_if(same).alias("round_trips"))


@query("SELECT p_brand, count(*) FILTER (regexp_matches(p_type, '(^|[^A-Za-z0-9_])TIN([^A-Za-z0-9_]|$)')) AS tin, count(*) FILTER (contains(p_type, 'TIN')) AS holds FROM part GROUP BY 1")
def token_names(spark, d):
    """Types that name a token as a word of its own, beside those that hold its letters."""
    p = tables.table(spark, d, "part")
    return p.groupBy("p_brand").agg(F.count_if(mapping.names_token(F.col("p_type"), "TIN")).alias("tin"), F.count_if(F.contains(F.col("p_type"), F.lit("TIN"))).alias("holds"))


@query(
    """SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d') AS day, count(*) AS witnesses, string_agg(DISTINCT (l_linenumber || '/' || l_partkey),
  ',' ORDER BY (l_linenumber || '/' || l_partkey)) AS evidence,
  arg_min(l_partkey, (l_linenumber, l_partkey)) AS first_part FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"""
)
def occurrence_witnesses(spark, d):
    """Shipments of an order on one day are one occurrence: the union of what witnesses it, and the first one."""
    line = tables.table(spark, d, "lineitem")
    said = F.concat_ws("/", F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"))
    g = line.groupBy("l_orderkey", F.date_format("l_shipdate", "yyyy-MM-dd").alias("day"))
    return g.agg(F.count("*").alias("witnesses"), F.array_join(F.array_sort(F.collect_set(said)), ",").alias("evidence"), F.min_by("l_partkey", F.struct("l_linenumber", "l_partkey")).alias("first_part")).where("witnesses > 1")


VARIANTS = {"buy": ("view", "click", "purchase"), "join": ("signup", "view"), "fail": ("error", "click")}


@query(
    "WITH "
    + LOG
    + """, v AS (SELECT * FROM (VALUES ('buy', ['view', 'click', 'purchase']), ('join', ['signup', 'view']), ('fail', ['error', 'click'])) x(variant,
  steps)),
t AS (SELECT timeline_id, list(DISTINCT event_type) AS seen FROM seq GROUP BY 1), m AS (SELECT timeline_id, seen, variant, steps,
  len(list_intersect(seen, steps)) AS overlap FROM t, v),
b AS (SELECT * FROM m WHERE overlap > 0 QUALIFY row_number() OVER (PARTITION BY timeline_id ORDER BY overlap DESC, len(steps), variant) = 1),
  x AS (SELECT variant, unnest(steps) AS step, seen FROM b)
SELECT variant, step, count(*) AS expecting, count(*) FILTER (NOT list_contains(seen, step)) AS missing FROM x GROUP BY 1, 2"""
)
def process_variants(spark, d):
    """Each user-day's best-fitting variant of the process, and which of its steps are missing."""
    seen = sequenced(spark, d).groupBy("timeline_id").agg(F.collect_set("event_type").alias("seen"))
    fit = [F.struct((-F.size(F.array_intersect("seen", F.array(*map(F.lit, s))))).alias("turned"), F.lit(len(s)).alias("length"), F.lit(n).alias("variant")) for n, s in VARIANTS.items()]
    best = seen.withColumn("best", F.array_min(F.array(*fit))).where("best.turned < 0")
    steps = F.create_map(*[x for n, s in VARIANTS.items() for x in (F.lit(n), F.array(*map(F.lit, s)))])
    rows = best.select(F.col("best.variant").alias("variant"), F.explode(F.element_at(steps, F.col("best.variant"))).alias("step"), "seen")
    return rows.groupBy("variant", "step").agg(F.count("*").alias("expecting"), F.count_if(~F.array_contains("seen", F.col("step"))).alias("missing"))


@query(
    """WITH k AS (SELECT l_orderkey, l_linenumber, count(DISTINCT l_partkey) AS parts, count(*) AS rows FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN rows = 1 THEN 'SINGLE' WHEN parts = 1 THEN 'REPEATED' ELSE 'REJECT' END AS decision, count(*) AS keys, sum(rows)::BIGINT AS rows,
  sum(CASE WHEN rows > 1 AND parts > 1 THEN parts - 1 ELSE 0 END)::BIGINT AS conflicts FROM k GROUP BY 1"""
)
def identity_ledger(spark, d):
    """Keys by what the REJECT policy makes of them: rows that say different things are all refused, as conflicts on a ledger."""
    k = tables.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("rows"))
    decision = F.when(F.col("rows") == 1, "SINGLE").when(F.col("parts") == 1, "REPEATED").otherwise("REJECT")
    clash = F.when((F.col("rows") > 1) & (F.col("parts") > 1), F.col("parts") - 1).otherwise(0)
    return k.groupBy(decision.alias("decision")).agg(F.count("*").alias("keys"), F.sum("rows").alias("rows"), F.sum(clash).alias("conflicts"))


@query("SELECT event_type, count(*) AS events, sum(CASE WHEN event_type = 'purchase' THEN floor(value)::BIGINT ELSE TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) END)::BIGINT AS total FROM events GROUP BY 1")
def attribute_lookup(spark, d):
    """The amount of an event: what it changed, else what is noted beside it."""
    e = tables.table(spark, d, "events")
    changed = F.when(F.col("event_type") == "purchase", F.create_map(F.lit("amount"), F.floor("value").cast("string")))
    noted = F.create_map(F.lit("amount"), F.get_json_object("props", "$.k"))
    amount = mapping.attribute(changed, noted, "amount").try_cast("bigint")
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(amount).alias("total"))


_REMARK = "'Größe ' || o_orderpriority || ' – „' || o_orderstatus || '“; ' || (o_orderkey % 97) || ' €'"


@query(
    f"""WITH o AS (SELECT o_orderkey, {_REMARK} AS remark FROM orders) SELECT o_orderkey AS order_key, remark, 'cp1252' AS encoding, ';' AS delimiter,
  'FULL' AS shape FROM o"""
)
def raw_file(spark, d):
    """Orders exported as a delimited file in cp1252, in as many parts as Spark
    writes, probed, and read again by the encoding and dialect that the probe found."""
    o = tables.table(spark, d, "orders")
    key, star = F.col("o_orderkey").cast("string"), F.lit('"')
    remark = F.concat(F.lit("Größe "), "o_orderpriority", F.lit(" – „"), "o_orderstatus", F.lit("“; "), (F.col("o_orderkey") % 97).cast("string"), F.lit(" €"))
    lines = spark.createDataFrame([("order;remark;mark",)], "line string").union(o.select(F.concat(key, F.lit(";"), star, remark, star, F.lit(";x"))))
    path = new_path(spark, "export")
    lines.select(delimited.encoded(F.col("line"), "cp1252").cast("string")).write.text(path)
    found = delimited.probe(spark, path)
    rows = delimited.records(delimited.numbered(spark, path, found.encoding).where("row_number > 1"), found.header, found.delimiter, "v1")
    return rows.select(F.col("order").cast("long").alias("order_key"), "remark", F.lit(found.encoding).alias("encoding"), F.lit(found.delimiter).alias("delimiter"), "shape")

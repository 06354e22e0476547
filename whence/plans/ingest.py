"""Queries on raw tables: profiles, validation, keys, entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import identity, temporal, transforms
from ..operators import profiling
from ..sources import tables
from .common import query

_KIND = """CASE WHEN value IS NULL OR trim(value) = '' THEN 'EMPTY' WHEN lower(trim(value)) IN ('true','false','yes','no') THEN 'BOOLEAN'
  WHEN regexp_full_match(trim(value), '[+-]?[0-9]+') THEN 'INTEGER' WHEN regexp_full_match(trim(value),
  '[+-]?([0-9]+\\.[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN 'DECIMAL'
  WHEN regexp_full_match(trim(value), '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'DATE' WHEN regexp_full_match(trim(value),
  '[0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\\.[0-9]+)?)?') THEN 'DATETIME' ELSE 'TEXT' END"""


@query(f"""
WITH t AS (SELECT o_orderkey::VARCHAR AS o_orderkey, o_orderstatus, o_orderpriority, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders),
long AS (UNPIVOT t ON o_orderkey, o_orderstatus, o_orderpriority, day INTO NAME "column" VALUE value),
c AS (SELECT "column", value, count(*) AS n, {_KIND} AS kind FROM long GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS r FROM c)
SELECT "column", sum(n)::BIGINT AS rows, sum(CASE WHEN kind = 'EMPTY' THEN n ELSE 0 END)::BIGINT AS blanks,
  count(*) FILTER (kind <> 'EMPTY') AS distinct_values,
  min(value) AS least, max(value) AS greatest, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds, string_agg(value,
  '|' ORDER BY r) FILTER (r <= 3) AS often
FROM r GROUP BY "column" """)
def column_profile(spark, d):
    """Kinds, blanks, distinct and frequent values of order columns."""
    o = tables.table(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return profiling.column_profile(o)


@query("""SELECT count(*) AS n, min(c_acctbal) AS least, max(c_acctbal) AS greatest, round(avg(c_acctbal), 4) AS mean,
  round(coalesce(stddev_samp(c_acctbal), 0), 4) AS deviation FROM customer""")
def numeric_summary(spark, d):
    c = F.col("c_acctbal")
    return tables.table(spark, d, "customer").agg(F.count(c).alias("n"), F.min(c).alias("least"), F.max(c).alias("greatest"), F.round(F.avg(c), 4).alias("mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 4).alias("deviation"))


_HIST = """b AS (SELECT min(l_extendedprice) AS low, (max(l_extendedprice) - min(l_extendedprice)) / 1024 AS w FROM lineitem),
h AS (SELECT least(floor((l_extendedprice - low) / w), 1023)::BIGINT AS bin, count(*) AS n, min(low + (least(floor((l_extendedprice - low) / w),
  1023) + 0.5) * w) AS centre FROM lineitem, b GROUP BY 1),
c AS (SELECT *, sum(n) OVER (ORDER BY bin) AS below, sum(n) OVER () AS total FROM h),
q AS (SELECT share, arg_min(centre, bin) AS value FROM c, unnest([0.01, 0.25, 0.5, 0.75, 0.99]::DOUBLE[]) s(share) WHERE below >= share * total
  GROUP BY share)"""


@query(f"WITH {_HIST} SELECT share, round(value, 4) AS value FROM q")
def numeric_histogram_quantiles(spark, d):
    """Quantiles of line prices from 1,024 bins."""
    q = profiling.quantiles(profiling.histogram(tables.table(spark, d, "lineitem"), "l_extendedprice"))
    return q.select("share", F.round("value", 4).alias("value"))


@query(f"""WITH {_HIST}, f AS (SELECT max(value) FILTER (share = 0.25) AS q1, max(value) FILTER (share = 0.75) AS q3 FROM q)
SELECT round(q1 - 1.5 * (q3 - q1), 4) AS low_fence, round(q3 + 1.5 * (q3 - q1), 4) AS high_fence,
  sum(CASE WHEN centre < q1 - 1.5 * (q3 - q1) OR centre > q3 + 1.5 * (q3 - q1) THEN n ELSE 0 END)::BIGINT AS outliers FROM h, f GROUP BY q1, q3""")
def tukey_outliers(spark, d):
    h = profiling.histogram(tables.table(spark, d, "lineitem"), "l_extendedprice")
    out = profiling.tukey_outliers(h, profiling.quantiles(h))
    return out.select(F.round("low_fence", 4).alias("low_fence"), F.round("high_fence", 4).alias("high_fence"), "outliers")


@query("""WITH j AS (SELECT o_orderkey, l_linenumber, CASE WHEN date_trunc('day', o_orderdate) >= date_trunc('day',
  l_shipdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND THEN 'VIOLATION'
    WHEN date_trunc('day', o_orderdate) + INTERVAL 1 DAY - INTERVAL 1 MICROSECOND < date_trunc('day',
  l_shipdate) THEN 'CERTAIN' ELSE 'UNDETERMINED' END AS verdict
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT verdict, CASE verdict WHEN 'VIOLATION' THEN 'error' WHEN 'UNDETERMINED' THEN 'warning' ELSE 'ok' END AS severity, count(*) AS n FROM j
  GROUP BY 1, 2""")
def precedence_check(spark, d):
    """Lines that ship before their order: a violation is an error, the same day a warning."""
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    j = o.select("o_orderkey", temporal.interval(F.col("o_orderdate"), "DAY").alias("a")).join(line.select("l_orderkey", temporal.interval(F.col("l_shipdate"), "DAY").alias("b")), F.col("o_orderkey") == F.col("l_orderkey"))
    v = temporal.verdict("a", "b")
    severity = F.when(v == "VIOLATION", "error").when(v == "UNDETERMINED", "warning").otherwise("ok")
    return j.select(v.alias("verdict"), severity.alias("severity")).groupBy("verdict", "severity").agg(F.count("*").alias("n"))


@query("""WITH f AS (SELECT unnest([CASE WHEN c_acctbal < 0 THEN 'NEGATIVE_BALANCE' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'AUTOMOBILE',
  'MACHINERY') THEN 'UNMAPPED_SEGMENT' END,
    CASE WHEN NOT regexp_matches(c_name, '[0-9]$') THEN 'NAME_FORMAT' END]) AS code, c_custkey FROM customer)
SELECT code, count(*) AS n, array_to_string(list_sort(list(c_custkey))[1:5], ',') AS examples FROM f WHERE code IS NOT NULL GROUP BY code""")
def row_validation_counts(spark, d):
    """Findings by code, with the first five rows that have each."""
    c = tables.table(spark, d, "customer")
    found = F.array(
        F.when(F.col("c_acctbal") < 0, "NEGATIVE_BALANCE"),
        F.when(~F.col("c_mktsegment").isin("BUILDING", "AUTOMOBILE", "MACHINERY"), "UNMAPPED_SEGMENT"),
        F.when(~F.col("c_name").rlike("[0-9]$"), "NAME_FORMAT"),
    )
    rows = c.select(F.explode(found).alias("code"), "c_custkey").where("code is not null")
    counts = rows.groupBy("code").agg(F.count("*").alias("n"))
    first = profiling.first_rows(rows, ["code"], ["c_custkey"], 5).groupBy("code").agg(F.array_join(F.array_sort(F.collect_list("c_custkey")).cast("array<string>"), ",").alias("examples"))
    return counts.join(first, "code")


@query("""SELECT count(*) AS read, count(*) FILTER (l_shipdate >= o_orderdate) AS clean,
  count(*) FILTER (NOT l_shipdate >= o_orderdate) AS quarantined,
  count(*) FILTER (o_orderkey IS NULL) AS orphans FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey""")
def row_reconciliation(spark, d):
    o, line = tables.table(spark, d, "orders"), tables.table(spark, d, "lineitem")
    ok = F.col("l_shipdate") >= F.col("o_orderdate")
    j = line.join(o, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return j.agg(F.count("*").alias("read"), F.count_if(ok).alias("clean"), F.count_if(~ok).alias("quarantined"), F.count_if(F.col("o_orderkey").isNull()).alias("orphans"))


@query("""SELECT date_diff('day', o_orderdate::DATE, l_shipdate::DATE) - l_linenumber AS residual_days, count(*) AS n FROM orders
  JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1""")
def derivation_audit(spark, d):
    """How far the ship day is from the order's day plus the line number."""
    j = tables.table(spark, d, "orders").join(tables.table(spark, d, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    return profiling.residuals(j, "o_orderdate", "l_shipdate", "l_linenumber")


@query("""SELECT o_orderpriority, count(*) AS orders, count(*) FILTER (NOT EXISTS (SELECT 1 FROM customer
  WHERE c_custkey = o_custkey AND c_acctbal > 0)) AS orphans FROM orders GROUP BY 1""")
def orphan_keys(spark, d):
    """Orders whose customer isn't among those in credit."""
    o, c = tables.table(spark, d, "orders"), tables.table(spark, d, "customer").where("c_acctbal > 0")
    missing = o.join(c, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("o_orderpriority").agg(F.count("*").alias("orphans"))
    return o.groupBy("o_orderpriority").agg(F.count("*").alias("orders")).join(missing, "o_orderpriority", "left").select("o_orderpriority", "orders", F.coalesce("orphans", F.lit(0)).alias("orphans"))


@query("""WITH p AS (SELECT l_orderkey, l_linenumber, l_shipdate, l_partkey || '|' || l_suppkey AS print FROM lineitem),
f AS (SELECT l_orderkey, l_linenumber, count(*) AS rows, count(DISTINCT print) AS contents, arg_min(print, (l_shipdate, print)) AS first FROM p
  GROUP BY 1, 2 HAVING count(*) > 1)
SELECT l_orderkey, l_linenumber, any_value(rows) AS rows, any_value(contents) AS contents, count(*) FILTER (print <> first) AS conflicting FROM p
  JOIN f USING (l_orderkey, l_linenumber) GROUP BY 1, 2""")
def identity_conflicts(spark, d):
    """Line keys that occur more than once."""
    line = tables.table(spark, d, "lineitem")
    return profiling.identity_conflicts(line, ["l_orderkey", "l_linenumber"], ["l_shipdate"], ["l_partkey", "l_suppkey"])


_RESOLVE = """SELECT user_id, {f}(event_type, (ts, event_id)) AS event_type, {f}(value, (ts, event_id)) FILTER (value IS NOT NULL) AS value,
  count(*) AS witnesses FROM events GROUP BY user_id"""


@query(_RESOLVE.format(f="arg_min"))
def entity_first_wins(spark, d):
    return profiling.resolve(tables.table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"])


@query(_RESOLVE.format(f="arg_max"))
def entity_last_wins(spark, d):
    return profiling.resolve(tables.table(spark, d, "events"), "user_id", ["ts", "event_id"], ["event_type", "value"], last=True)


@query("""WITH l AS (SELECT user_id, event_type, ts, event_id, lag(event_type) OVER w AS was, row_number() OVER w AS r
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
c AS (SELECT * FROM l WHERE r = 1 OR event_type IS DISTINCT FROM was)
SELECT user_id, row_number() OVER w AS version, event_type AS value, lead(true, 1, false) OVER w AS superseded
  FROM c WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def attribute_history(spark, d):
    return profiling.history(tables.table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query(r"""SELECT event_id, 'evt:' || substr(sha256(concat_ws('|', replace(replace(replace(replace(event_type, '\', '\\'), '|', '\p'), ',', '\c'),
  '=', '\e'), user_id::VARCHAR,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN epoch_us(ts) % 1000000 = 0 THEN '' ELSE '.' || strftime(ts, '%f') END || '+00:00',
  replace(replace(replace(replace(props, '\', '\\'), '|', '\p'), ',', '\c'), '=', '\e'))), 1, 16) AS address FROM events""")
def content_address(spark, d):
    e = tables.table(spark, d, "events")
    return e.select("event_id", identity.address("evt", F.col("event_type"), F.col("user_id"), identity.instant(F.col("ts")), F.col("props")).alias("address"))


@query("""SELECT upper(trim(c_mktsegment)) AS segment, count(*) FILTER (trim(c_mktsegment) <> c_mktsegment) AS trimmed,
  count(*) FILTER (upper(trim(c_mktsegment)) <> trim(c_mktsegment)) AS raised,
  count(TRY_CAST(c_name AS BIGINT)) AS integers FROM customer GROUP BY 1""")
def transform_receipts(spark, d):
    """How many rows each step of a chain of transforms changed."""
    c = tables.table(spark, d, "customer")
    first, trimmed, raised = transforms.chain(("TRIM", "UPPERCASE"), F.col("c_mktsegment"))
    changed = lambda a, b: F.count_if(~a.eqNullSafe(b))
    return c.groupBy(raised.alias("segment")).agg(changed(first, trimmed).alias("trimmed"), changed(trimmed, raised).alias("raised"), F.count(transforms.apply("PARSE_INTEGER", F.col("c_name"))).alias("integers"))


@query(f"""WITH v AS (SELECT unnest([c_name, c_acctbal::VARCHAR, c_custkey::VARCHAR, '']) AS value FROM customer) SELECT {_KIND} AS kind,
  count(*) AS n FROM v GROUP BY 1""")
def value_kinds(spark, d):
    c = tables.table(spark, d, "customer")
    v = c.select(F.explode(F.array("c_name", F.col("c_acctbal").cast("decimal(20,2)").cast("string"), F.col("c_custkey").cast("string"), F.lit(""))).alias("value"))
    return v.groupBy(transforms.classify(F.col("value")).alias("kind")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey, p_name AS n_name, p_type AS r_name FROM part), w AS (SELECT *,
  list_distinct(list_filter(regexp_split_to_array(lower(n_name), '[^a-z0-9]+'), lambda x: x <> '')) AS a,
  list_distinct(list_filter(regexp_split_to_array(lower(r_name), '[^a-z0-9]+'), lambda x: x <> '')) AS b,
  regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') AS p, regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') AS q FROM r),
g AS (SELECT *, list_distinct(list_transform(range(1, greatest(length(p) - 1, 1) + 1), lambda i: substr(p, i, 2))) AS x,
  list_distinct(list_transform(range(1, greatest(length(q) - 1, 1) + 1), lambda i: substr(q, i, 2))) AS y FROM w)
SELECT p_partkey, round(greatest(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 2.0 * len(list_intersect(x,
  y)) / (len(x) + len(y))), 6) AS similarity FROM g""")
def name_similarity(spark, d):
    """How much each part's name is like its type."""
    p = tables.table(spark, d, "part")
    return p.select("p_partkey", F.round(transforms.name_similarity(F.col("p_name"), F.col("p_type")), 6).alias("similarity"))


@query("""SELECT c_nationkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS value, count(*) FILTER (l_tax = 0) AS untaxed,
  round(min(l_extendedprice / nullif(l_tax, 0)), 4) AS least_ratio
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
  WHERE (l_quantity > 10 AND NOT l_returnflag IN ('R')) OR l_linestatus = 'O' GROUP BY 1""")
def measurement_values(spark, d):
    """Declared measurements of lines that a declared condition fits, by nation."""
    from ..functions.conditions import compile_condition, compile_measurement

    condition = ("any", ("all", ("l_quantity", ">", 10), ("not", ("l_returnflag", "in", ("R",)))), ("l_linestatus", "=", "O"))
    line = tables.table(spark, d, "lineitem").where(compile_condition(condition))
    value = compile_measurement(("product", "l_extendedprice", ("difference", 1, "l_discount")))
    ratio = compile_measurement(("ratio", "l_extendedprice", "l_tax"))
    j = line.join(tables.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(tables.table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return j.groupBy("c_nationkey").agg(F.round(F.sum(value), 2).alias("value"), F.count_if(F.col("l_tax") == 0).alias("untaxed"), F.round(F.min(ratio), 4).alias("least_ratio"))

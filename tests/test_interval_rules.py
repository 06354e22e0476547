import datetime
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from whence.functions.temporal import PRECISIONS
from whence.operators import interval_rules as R

HOUR = 3_600_000_000
RULES = (
    R.IntervalRule("OPEN", "a", "b", 0, 5 * HOUR, 0.5),
    R.IntervalRule("LATER", "a", "b", 2 * HOUR, 60 * HOUR, 0.8, least_in=False, most_in=False),
    R.IntervalRule("SELF", "c", "c", 0, 24 * HOUR, 0.3),
    R.IntervalRule("NEVER", "a", "z", 0, HOUR, 0.3),
)
UNITS = {"EXACT": 0, "MINUTE": 60, "HOUR": 3600, "DAY": 86400}


def events(seed, n=260):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        precision = rng.choice(["EXACT", "MINUTE", "HOUR", "DAY", "DAY", "UNKNOWN"])
        at = rng.randrange(0, 6 * 86400, 1800)
        lo = hi = None
        if precision != "UNKNOWN":
            unit = UNITS[precision] or 1
            lo = at // unit * unit * 1_000_000
            hi = lo if precision == "EXACT" else lo + unit * 1_000_000 - 1
        rows.append((i, rng.choice([None, 1, 1, 1, 2, 3]), rng.choice("abc"), lo, hi, precision))
    return rows


def brute(rows):
    fired, refused = [], Counter({r.rule_id: 0 for r in RULES})
    for r in RULES:
        for i, k, t, lo, hi, p in rows:
            for j, k2, t2, lo2, hi2, p2 in rows:
                if i == j or k is None or k != k2 or t != r.cause_type or t2 != r.effect_type:
                    continue
                if "UNKNOWN" in (p, p2):
                    fired.append((r.rule_id, k, i, j, None, None, "UNDETERMINED", True))
                    continue
                if lo >= hi2:
                    refused[r.rule_id] += 1
                    continue
                low, high = lo2 - hi, hi2 - lo
                early = high >= r.least_us if r.least_in else high > r.least_us
                late = low <= r.most_us if r.most_in else low < r.most_us
                if early and late:
                    fired.append((r.rule_id, k, i, j, low, high, "CERTAIN" if hi < lo2 else "UNDETERMINED", False))
    return fired, refused


def frame(spark, rows):
    at = lambda us: None if us is None else datetime.datetime(1970, 1, 1) + datetime.timedelta(microseconds=us)
    df = spark.createDataFrame([(i, k, t, at(lo), at(hi), p) for i, k, t, lo, hi, p in rows], "event_id long, user long, event_type string, a timestamp_ntz, b timestamp_ntz, p string")
    known = F.struct(F.col("a").alias("t_earliest"), F.col("b").alias("t_latest"), F.col("p").alias("precision"), F.lit("OBSERVED").alias("provenance"))
    return df.select("event_id", "user", "event_type", known.alias("known"))


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rows = events(seed)
    assert {r[5] for r in rows} <= set(PRECISIONS)
    e = frame(spark, rows)
    fired, refused = brute(rows)
    got = R.firings(e, RULES, "user").cache()
    assert sorted((tuple(r)[:8] for r in got.collect()), key=repr) == sorted(fired, key=repr) and fired
    assert {r.rule_id: r.refused for r in R.refused(e, RULES, "user").collect()} == refused

    states = spark.createDataFrame([(1, "held"), (1, "held"), (2, "free")], "entity long, state string")
    judged = R.judged(got, e, RULES, states, [R.Constraint("held", "b")], [R.Modifier("c", "OPEN", 3.0), R.Modifier("b", "LATER", 0.5), R.Modifier("a", "LATER", 0.5)], "user")
    has = {(k, t) for _, k, t, *_ in rows}
    out = {(r.rule_id, r.source, r.target): r for r in judged.collect()}
    assert len(out) == len(fired)
    for rule, k, i, j, *_ in fired:
        r = out[rule, i, j]
        assert r.prohibited == (k == 1 and rule in ("OPEN", "LATER"))
        times = {"OPEN": 3.0 if (k, "c") in has else 1.0, "LATER": 0.25}.get(rule, 1.0)
        assert r.strength == pytest.approx(min(1.0, {x.rule_id: x.strength for x in RULES}[rule] * times))
    table = {r.rule_id: r for r in R.statistics(judged, R.refused(e, RULES, "user")).collect()}
    for rule in RULES:
        own = [f for f in fired if f[0] == rule.rule_id]
        r = table[rule.rule_id]
        assert (r.firings, r.certain, r.unverifiable, r.refused) == (len(own), sum(f[6] == "CERTAIN" for f in own), sum(f[7] for f in own), refused[rule.rule_id])


def test_empty(spark):
    e = frame(spark, [])
    assert R.firings(e, RULES, "user").collect() == []
    assert {r.refused for r in R.refused(e, RULES, "user").collect()} == {0}

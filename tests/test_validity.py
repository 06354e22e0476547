import random

import pytest
from pyspark.sql import functions as F
from whence.operators import validity as V


def brute(links, starts):
    """Worst verdict and least belief by relaxation until nothing changes."""
    out = {}
    for s in {k for k, _ in starts}:
        reach = {n for k, n in starts if k == s}
        e = [x[1:] for x in links if x[0] == s]
        while more := {b for a, b, *_ in e if a in reach} - reach:
            reach |= more
        own = {n for k, n in starts if k == s}
        state = {n: (0, 1.0) for n in reach}
        for _ in range(len(reach) + 2):
            for a, b, v, p in e:
                if b in reach and (a in reach or b in own):
                    up = state.get(a, (0, 1.0)) if a in reach else (0, 1.0)
                    state[b] = (max(state[b][0], v, up[0]), min(state[b][1], p, up[1]))
        out |= {(s, n): (V.VERDICTS[v], p) for n, (v, p) in state.items()}
    return out


def run(spark, links, starts):
    e = spark.createDataFrame(links, "set_id string, source long, target long, verdict int, belief double")
    return {(r.set_id, r.node): (r.verdict, r.belief) for r in V.carried(e, spark.createDataFrame(starts, "set_id string, node long")).collect()}


def test_diamond(spark):
    links = [("s", 1, 2, 0, 0.9), ("s", 1, 3, 1, 0.5), ("s", 2, 4, 0, 0.8), ("s", 3, 4, 0, 0.7), ("s", 4, 5, 3, 0.95), ("s", 5, 6, 0, 0.99), ("s", 9, 6, 2, 0.1)]
    got = run(spark, links, [("s", 1)])
    # 9 isn't touched, and 6 is no start: that link is as it was.
    assert got == {("s", 1): ("WITHIN", 1.0), ("s", 2): ("WITHIN", 0.9), ("s", 3): ("AT_EDGE", 0.5), ("s", 4): ("AT_EDGE", 0.5), ("s", 5): ("NOT_ASSESSABLE", 0.5), ("s", 6): ("NOT_ASSESSABLE", 0.5)}


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links = [(s, *rng.sample(range(25), 2), rng.choice([0, 0, 0, 0, 1, 2, 3]), round(rng.random(), 3)) for s in ("a", "b") for _ in range(35)]
    starts = [("a", 1), ("a", 2), ("b", 3), ("b", 24), ("b", 3)]
    assert run(spark, links, starts) == brute(links, starts)


def test_verdicts(spark):
    rows = [(5.0, 0.0, 10.0, 9), (0.0, 0.0, 10.0, 9), (11.0, 0.0, 10.0, 9), (-1.0, 0.0, 10.0, 9), (11.1, 0.0, 10.0, 9), (5.0, 0.0, 10.0, 4), (None, 0.0, 10.0, 9), (5.0, None, None, 0), (3.0, 2.0, 2.0, 9)]
    df = spark.createDataFrame(rows, "asked double, low double, high double, seen long")
    got = [r.v for r in df.select(V.verdict(F.col("asked"), F.col("low"), F.col("high"), F.col("seen"), 5, 0.1).alias("v")).collect()]
    assert got == [0, 0, 1, 1, 2, 3, 3, 3, 2]


def test_empty(spark):
    assert run(spark, [], []) == {} and run(spark, [("s", 1, 2, 0, 0.5)], []) == {}

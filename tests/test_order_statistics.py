import random
import statistics

import pytest
from whence.operators import order_statistics as O


def values():
    rng = random.Random(7)
    out = {"ties": [rng.choice([0.0, 0.5, 1.0]) for _ in range(3001)], "one": [0.25], "none": [None, None], "even": [rng.random() for _ in range(1000)]}
    out["steep"] = [10.0 ** rng.uniform(-300, 300) * rng.choice([-1, 1]) for _ in range(700)] + [0.0, 1.7e308, -1.7e308]
    out["near"] = [1.0 + i * 2**-52 for i in range(50)] + [1e9, None, float("nan")]
    return out


def test_every_rank(spark):
    own = values()
    rows = [(g, v) for g, vs in own.items() for v in vs]
    df = spark.createDataFrame(rows, "group string, value double").repartition(4)
    ranks = [(g, r) for g, vs in own.items() for r in {0, 1, 2, 25, len(vs) // 3, len(vs) // 2, len(vs) - 2, len(vs), len(vs) + 1}]
    got = {(r.group, r["rank"]): r.value for r in O.at_ranks(df, spark.createDataFrame(ranks, "group string, rank long")).collect()}
    want = {}
    for g, r in ranks:
        known = sorted(v for v in own[g] if v is not None and v == v)
        if 1 <= r <= len(known):
            want[g, r] = known[r - 1]
    assert got == want


def test_summary(spark):
    own = {k: v for k, v in values().items() if k in ("ties", "one", "none", "even")}
    own["even"] = [*own["even"], None, 0.0, 1.0, 2.0]
    df = spark.createDataFrame([(g, v) for g, vs in own.items() for v in vs], "group string, value double")
    got = {r.group: r for r in O.summary(df).collect()}
    for g, vs in own.items():
        known = [v for v in vs if v is not None]
        r = got[g]
        bins = [sum(0 <= v <= 1 and min(9, int(v * 10)) == i for v in known) for i in range(10)]
        assert (r.n, r.zeros, r.bins) == (len(vs), known.count(0.0), ",".join(map(str, bins)))
        assert r.missing == pytest.approx(1 - len(known) / len(vs))
        assert (r.median, r.least, r.greatest) == ((statistics.median(known), min(known), max(known)) if known else (None,) * 3)


def test_empty(spark):
    none = spark.createDataFrame([], "group string, value double")
    assert O.summary(none).collect() == [] and O.at_ranks(none, spark.createDataFrame([("a", 1)], "group string, rank long")).collect() == []

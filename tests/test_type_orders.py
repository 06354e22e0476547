"""Orders of types within days, from a row of each day, against the general counts and brute force."""

import datetime
import random

import pytest
from whence.functions import scoring
from whence.operators import candidates
from whence.plans import causes, claims
from whence.plans.common import one_graph

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("types", [3, 9])  # few: bits of a long; more: the general way
def test_orders_with_equal_times(spark, types):
    rng = random.Random(types)
    rows = [(i, rng.choice([1, 2, 3]), datetime.date(2024, 1, rng.randint(1, 12)), rng.randint(0, 3), f"t{rng.randrange(types)}") for i in range(400)]
    rng.shuffle(rows)
    e = spark.createDataFrame(rows, "event_id long, user_id long, day date, us long, event_type string")
    daily, weekly = candidates.orders_of_days(e)
    names = sorted({r[4] for r in rows})
    days, weeks = {}, {}
    for i, u, d, us, t in rows:
        days.setdefault((u, d), []).append((us, i, t))
        weeks.setdefault((u, d.isocalendar()[:2]), set()).add(t)
    want = {}
    for a in names:
        for b in names:
            n = sum(any(x[2] == a and y[2] == b and x[:2] < y[:2] for x in v for y in v) for v in days.values())
            if n:
                want[a, b] = (n, *(sum(any(x[2] == t for x in v) for v in days.values()) for t in (a, b)), len(days))
    columns = ("both", "with_cause", "with_effect", "instances")
    assert {(r.cause_type, r.effect_type): tuple(r[c] for c in columns) for r in daily.collect()} == want
    want = {(a, b): (n, *(sum(t in v for v in weeks.values()) for t in (a, b)), len(weeks)) for a in names for b in names if a != b and (n := sum({a, b} <= v for v in weeks.values()))}
    assert {(r.cause_type, r.effect_type): tuple(r[c] for c in columns) for r in weekly.collect()} == want


def test_bars_are_looked_for_only_where_a_candidate_can_reach_their_cap(spark, monkeypatch):
    names = ["source", "target", "kind", "scalar"]

    def graph():
        with one_graph():
            return sorted(map(tuple, causes.promoted(spark, SF).select(*names).collect()))

    asked, made = [], claims.candidates.judged
    monkeypatch.setattr(claims.candidates, "judged", lambda pairs, generators, *a, **k: asked.append(len(generators)) or made(pairs, generators, *a, **k))
    short = graph()
    assert asked == [5]  # those of the graph's kinds only
    monkeypatch.setattr(scoring, "height", lambda *_: 0.0)
    assert graph() == short and short and asked == [5, 8]

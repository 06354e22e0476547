import random
from itertools import combinations

import pytest
from whence.operators import cuts


def brute(edges, kinds, seeds, outcomes, depth, groups, most):
    """Every closed set, by walking the graph without its types."""

    def reached(seed, without):
        if kinds[seed] in without:
            return set()
        seen, last = {seed}, {seed}
        for _ in range(depth):
            last = {b for a, b in edges if a in last and (kinds[a] not in without)} - seen
            seen |= last
        return seen

    pairs = [(s, o) for s in seeds for o in outcomes if s != o and o in reached(s, set())]
    types = sorted(set(kinds.values()))
    out = {}
    for n in range(1, most + 1):
        for c in combinations(types, n):
            c = set(c)
            while any(c & set(g) and not set(g) <= c for g in groups):
                c |= {t for g in groups if c & set(g) for t in g}
            key = ",".join(sorted(c))
            out[key] = None if len(c) > most else sum(o not in reached(s, c) for s, o in pairs)
    return pairs, out


def run(spark, edges, kinds, seeds, outcomes, depth, groups, most, ceiling=12):
    e = spark.createDataFrame([(a, b, kinds[a]) for a, b in edges] * 2, "source long, target long, source_type string")
    bits = cuts.numbered(spark.createDataFrame([(k,) for k in kinds.values()], "event_type string"))
    routes = cuts.route_masks(e, spark.createDataFrame([(s,) for s in seeds], "node long"), bits, depth)
    routes = routes.join(spark.createDataFrame([(o,) for o in outcomes], "node long"), "node")
    return cuts.minimum_cut_sets(routes, bits, groups, most, ceiling).collect()


@pytest.mark.parametrize(("seed", "groups"), [(1, []), (2, [["b", "d"]]), (3, [["a", "c"], ["c", "e"], ["f", "a"]])])
def test_against_all_subsets(spark, seed, groups):
    rng = random.Random(seed)
    kinds = {n: rng.choice("abcdef") for n in range(40)}
    edges = {tuple(rng.sample(range(40), 2)) for _ in range(90)}  # in loops, too
    seeds, outcomes = range(6), range(30, 40)
    got = run(spark, edges, kinds, seeds, outcomes, 4, groups, 3)
    pairs, want = brute(edges, kinds, seeds, outcomes, 4, groups, 3)
    assert {r.members: r.broken for r in got} == want and {r.considered for r in got} == {len(pairs)}
    for r in got:
        assert r.regime == ("OVERSIZED" if r.broken is None else "EXACT") and r["size"] == len(r.members.split(","))
        if r.broken is not None:
            smaller = [o for o in got if o.broken is not None and set(o.members.split(",")) < set(r.members.split(","))]
            assert r.minimal == all(o.broken < r.broken for o in smaller)


def test_parallel_routes_need_both(spark):
    kinds = {1: "s", 2: "a", 3: "b", 4: "o"}
    got = {r.members: (r.broken, r.minimal) for r in run(spark, [(1, 2), (1, 3), (2, 4), (3, 4)], kinds, [1], [4], 3, [], 2)}
    assert got["a"] == (0, True) and got["b"] == (0, True) and got["a,b"] == (1, True) and got["s"] == (1, True) and got["a,s"] == (1, False)


def test_greedy_beyond_the_ceiling(spark):
    kinds = {1: "s", 2: "a", 3: "b", 4: "o", 5: "s", 6: "c"}
    got = run(spark, [(1, 2), (2, 4), (5, 3), (3, 6), (1, 6), (5, 4)], kinds, [1, 5], [4, 6], 3, [["b", "c"]], 2, ceiling=2)
    assert {r.regime for r in got} == {"NOT_PROVEN_MINIMAL"} and {r.minimal for r in got} == {None}
    _, want = brute([(1, 2), (2, 4), (5, 3), (3, 6), (1, 6), (5, 4)], kinds, [1, 5], [4, 6], 3, [["b", "c"]], 2)
    assert all(want[r.members] == r.broken for r in got) and {"s", "a", "o", "b,c"} <= {r.members for r in got}


def test_empty(spark):
    got = run(spark, [(1, 2)], {1: "s", 2: "a"}, [2], [1], 3, [], 1)
    assert {(r.members, r.broken, r.considered) for r in got} == {("a", 0, 0), ("s", 0, 0)}

import random

import pytest
from whence.operators import retiming


def brute(links, times, shifts):
    """Relaxation of every bound, round by round, over all events of each set."""
    out = {}
    for s in {k for k, _ in shifts}:
        moved = {n: x for (k, n), x in shifts.items() if k == s and n in times}
        e = [(a, b, lo, hi) for a, b, lo, hi in links if a in times and b in times]
        affected, frontier = set(), set(moved)
        while frontier:
            frontier = {b for a, b, *_ in e if a in frontier} - affected - set(moved)
            affected |= frontier
        fixed = {n: (lo + moved.get(n, 0), hi + moved.get(n, 0)) for n, (lo, hi) in times.items() if n not in affected}
        bound = {n: (None, None) for n in affected}
        loose = set()
        for k in range(2 * len(affected) + 2):
            new = {}
            for n in affected:
                lows = [x + low for a, b, low, _ in e if b == n and low is not None and (x := (fixed.get(a) or bound[a])[0]) is not None]
                highs = [x + high for a, b, _, high in e if b == n and high is not None and (x := (fixed.get(a) or bound[a])[1]) is not None]
                new[n] = (max(lows, default=None), min(highs, default=None))
            if k > len(affected):
                loose |= {(n, i) for n in affected for i in (0, 1) if new[n][i] != bound[n][i]}
            bound = new
        for n in affected:
            lo, hi = (None if (n, i) in loose else bound[n][i] for i in (0, 1))
            a, b = times[n]
            status = "UNBOUNDED" if lo is None or hi is None else "CONFLICT" if lo > hi else "LATER" if lo > b else "EARLIER" if hi < a else "HOLDS" if lo <= a and hi >= b else "NARROWED"
            out[s, n] = (a, b, lo, hi, status)
        for n in moved:
            out[s, n] = (*times[n], *fixed[n], "SHIFTED")
    return out


def run(spark, links, times, shifts):
    e = spark.createDataFrame([(*r, "x") for r in links], "source long, target long, low long, high long, node string")
    t = spark.createDataFrame([(n, *r) for n, r in times.items()], "node long, lo long, hi long")
    s = spark.createDataFrame([(k, n, x) for (k, n), x in shifts.items()], "set_id string, node long, shift long")
    return {(r.set_id, r.node): tuple(r)[2:] for r in retiming.retimed(e, t, s).collect()}


def test_diamond(spark):
    times = {1: (0, 0), 2: (10, 12), 3: (20, 20), 4: (40, 45), 5: (100, 100)}
    links = [(1, 2, 5, 15), (1, 3, 20, 30), (2, 4, 10, 60), (3, 4, 5, 25), (5, 4, -80, -50)]
    got = run(spark, links, times, {("a", 1): 20, ("b", 3): 100, ("c", 9): 5})
    assert got == brute(links, times, {("a", 1): 20, ("b", 3): 100})
    # Through both arms, and through the one cause that stays where it is.
    assert got["a", 4] == (40, 45, 45, 50, "NARROWED") and got["b", 4][4] == "CONFLICT"


def test_loop_that_never_settles_and_one_that_does(spark):
    times = {n: (n * 10, n * 10 + 5) for n in range(1, 8)}
    gains = [(1, 2, 10, 20), (2, 3, 10, 20), (3, 2, 1, None), (3, 4, 1, 50), (1, 5, 0, 90), (5, 6, 10, 20), (6, 5, -15, 30), (6, 7, 0, 5)]
    shifts = {("s", 1): 7}
    got = run(spark, gains, times, shifts)
    assert got == brute(gains, times, shifts)
    assert [got["s", n][4] for n in (2, 3, 4)] == ["UNBOUNDED"] * 3 and got["s", 5][2] is not None


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    links, times, shifts = [], {}, {}
    for block in range(6):  # paths of more than sixteen links, sparse and dense parts, loops in some
        nodes = [100 * block + i for i in range(rng.choice([6, 12, 24]))]
        for n in nodes:
            lo = rng.randint(0, 500)
            times[n] = (lo, lo + rng.choice([0, 0, 10, 60]))
        pairs = {(a, b) for a, b in zip(nodes, nodes[1:])} | {tuple(sorted(rng.sample(nodes, 2))) for _ in range(len(nodes))}
        if block % 2:
            pairs |= {tuple(sorted(rng.sample(nodes, 2), reverse=True)) for _ in range(2)}
        for a, b in sorted(pairs):
            low = rng.choice([None, -5, 0, 3, 20])
            links.append((a, b, low, rng.choice([None, (low or 0) + rng.randint(0, 80)])))
        for s in ("x", "y"):
            shifts[s, rng.choice(nodes[:2])] = rng.choice([-50, 7, 400])
    shifts["x", 105] = 1
    links += [(1, 999, 0, 5), (998, 2, 0, 5)]  # no times there
    assert run(spark, links, times, shifts) == brute(links, times, shifts)


def test_nothing_to_move(spark):
    assert run(spark, [], {}, {}) == {} and run(spark, [(1, 2, 0, 1)], {1: (0, 0), 2: (1, 1)}, {("s", 5): 1}) == {}

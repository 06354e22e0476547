import hashlib
import random

from whence.operators import evidence as E


def brute(rows, most):
    out = {}
    for s, t, k, e, p in rows:
        claims, ids, said = out.setdefault((s, t, k), [0, set(), set()])
        out[s, t, k][0] = claims + 1
        if e is not None:
            ids.add(e)
        if p is not None:
            said.add(p)
    found = []
    for key, (n, ids, said) in out.items():
        hashes = [hashlib.sha256(p.encode()).hexdigest() for p in said]
        payload = f"{sum(int(h[:15], 16) for h in hashes)}:{sum(int(h[15:30], 16) for h in hashes)}"
        found.append((*key, n, len(ids), ",".join(sorted(ids)[:most]), max(0, len(ids) - most), payload, len(said) > 1))
    return sorted(found, key=repr)


def test_merging_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), rng.randrange(4), rng.choice("DS"), rng.choice([None, *[f"e{i}" for i in range(30)]]), rng.choice([None, "p", "p", "q"])) for _ in range(400)]
    rows += [(9, 9, "D", None, None), (8, 8, "D", "x", "p"), (8, 8, "D", "x", "p")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "source long, target long, kind string, evidence string, payload string, claims int").repartition(3)
    for most in (1, 5):
        assert sorted(map(tuple, E.merged(df, most).collect()), key=repr) == brute(rows, most)
    assert E.merged(df.limit(0), 3).collect() == []


def test_ledger(spark):
    every = spark.createDataFrame([("a",), ("a",), ("b",)], "generator string")
    got = sorted(map(tuple, E.ledger(every, every.where("generator = 'a'").limit(1)).collect()))
    assert got == [("a", 2, 1, 1), ("b", 1, 0, 1)]

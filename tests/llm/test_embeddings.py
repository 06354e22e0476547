import duckdb
import numpy as np
import pytest
from whence.llm import embeddings as E


def brute(rows):
    ok, root = [], {}
    for k, (i, v) in enumerate(rows):
        root[k] = k
        if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.append(k)
    n = dict.fromkeys(root, 0)
    vec = {k: np.array(rows[k][1], np.float32).astype(float) for k in ok}
    pairs = [(a, b) for a in ok for b in ok if a < b and len(vec[a]) == len(vec[b]) and vec[a] @ vec[b] / np.sqrt((vec[a] @ vec[a]) * (vec[b] @ vec[b])) >= 0.95]
    for a, b in pairs:
        n[a] += 1
        n[b] += 1

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        root[find(a)] = find(b)
    best = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            best[find(k)] = min(i, best.get(find(k), i))
    return sorted(((i, n[k], best.get(find(k))) for k, (i, _) in enumerate(rows)), key=str)


def vectors(seed, dim=12):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(60):
        c = rng.normal(size=dim)
        rows += [c + rng.normal(size=dim) * rng.choice([0.02, 0.15, 0.25]) for _ in range(rng.integers(1, 12))]
    rows = [list(map(float, np.float32(r))) for r in rows]
    rows += [rows[0]] * 20 + [[3 * x for x in rows[1]], [0.0] * dim, [-0.0] * dim, None, [], [1.0, None] + [0.0] * (dim - 2), [float("nan")] * dim, [float("inf")] * dim, [1.0, 2.0], [2.0, 4.0], [1e-20] * dim, [1e18] * dim]
    rows = list(enumerate(rows))
    return rows + [(5, rows[5][1]), (5, rows[9][1]), (None, rows[5][1]), (None, [9.0, -9.0, 1.0])]


@pytest.mark.parametrize("block", [8192, 40])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(E, "BLOCK", block)
    monkeypatch.setattr(E, "SAMPLE", 100)
    rows = vectors(1)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, n long, vec string").repartition(3)
    got = E.near_duplicates(df).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)


def test_tree_covers():
    rng = np.random.default_rng(2)
    rows = E.unit(rng.normal(size=(500, 6)))
    t = E.Tree(rows, E.nodes(rows))
    for starts, radius, most in zip(t.starts, t.radius, E.RADII):
        assert radius.max() <= 2 * most
        for s, e, r in zip(starts, [*starts[1:], 500], radius):
            assert E.distances(t.rows[s : s + 1], t.rows[s:e]).max() <= r + 1e-7
    assert [len(s) for s in t.starts] == sorted(len(s) for s in t.starts)


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert E.near_duplicates(df).collect() == []


def test_sql_agrees(spark):
    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{d}/embeddings.parquet'")
    assert sorted(map(tuple, E.op8_embeddings(spark, d).collect())) == sorted(con.execute(E.OP8_SQL).fetchall())


def test_doubles_stay_doubles(spark):
    a, b = [1.0, 1e-9, 0.0], [1.0, -1e-9, 0.0]
    rows = [(1, a), (2, b), (3, [1e300, 1e300, 0.0]), (4, [1e-300, 1e-300, 0.0]), (5, [0.0, 0.0, 5e-324])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.id: (r.n_links, r.component) for r in E.near_duplicates(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 3), 4: (1, 3), 5: (0, 5)}
    one = spark.createDataFrame([(1, [16777217.0, 1.0]), (2, [16777216.0, 1.0])], "vec_id long, embedding array<double>")
    assert one.select("embedding").distinct().count() == 2 and E.near_duplicates(one).where("n_links = 1").count() == 2

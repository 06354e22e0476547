"""Rounds of removal and reach write what is new in them, and send no rows through the driver."""

import pytest
from whence.operators import causal_graph, simulation


@pytest.fixture
def writes(monkeypatch):
    kept, orig = [], simulation.written

    def written(df, label):
        kept.append((label, df._jdf.queryExecution().executedPlan().toString(), out := orig(df, label)))
        return out

    for module in (simulation, causal_graph):
        monkeypatch.setattr(module, "written", written)
    return kept


CHAIN = [(i, i + 1) for i in range(6)]


def test_removal_and_chains(spark, writes):
    e = spark.createDataFrame(CHAIN, "source long, target long")
    gone = simulation.eliminated(e, spark.createDataFrame([("a", 0)], "set_id string, node long"))
    assert {(r.node, r["round"]) for r in gone.collect()} == {(i, i) for i in range(7)}
    assert [t.count() for label, _, t in writes if label == "gone"] == [1] * 7 + [0]
    found = simulation.chains(e.selectExpr("*", "0.5D AS scalar"), spark.createDataFrame([(0,)], "node long"), 4)
    assert {(r.node, r.distance, r.confidence) for r in found.collect()} == {(i, i, 0.5**i) for i in range(1, 5)}
    assert [t.count() for label, _, t in writes if label == "chains"] == [1] * 5
    assert not any("Broadcast" in plan for _, plan, _ in writes)


def test_reach(spark, writes):
    e, seeds = spark.createDataFrame(CHAIN, "source long, target long"), spark.createDataFrame([("a", 0)], "set_id string, node long")
    assert {(r.node, r.distance) for r in causal_graph.reach(e, seeds, 3).collect()} == {(1, 1), (2, 2), (3, 3)}
    assert [t.count() for label, _, t in writes if label == "reach"] == [1] * 4


def test_sets_are_bits_of_one_row(spark, writes):
    # 3 keeps half of its reading in set a, as its link from 5 stays; b takes both.
    e = spark.createDataFrame([(0, 1, 1.0), (1, 3, 0.5), (5, 3, 0.5), (3, 4, 1.0)], "source long, target long, weight double")
    sets = spark.createDataFrame([("a", 0), ("b", 0), ("b", 5)], "set_id string, node long")
    want = {("a", 0, 0.0), ("a", 1, 0.0), ("a", 3, 0.5)} | {("b", n, 0.0) for n in (0, 1, 3, 4, 5)}
    assert {tuple(r) for r in simulation.simulated(e, sets).select("set_id", "node", "kept").collect()} == want
    assert max(t.count() for label, _, t in writes if label == "gone") == 5  # nodes, not sets times nodes
    assert {tuple(r) for r in simulation._simulated_by_rows(e, sets, ()).select("set_id", "node", "kept").collect()} == want

"""The graph is built from what can be promoted only, and is the same as from all candidates."""

from pyspark.sql import functions as F
from whence.plans import causes, claims
from whence.plans.common import one_graph

SF = "/root/testdata/sf0.001"


def test_promoted_is_what_the_ledger_promotes(spark):
    with one_graph():
        names = ["source", "target", "kind", "scalar", "n_generators"]
        want = causes.decided(spark, SF).where("decision = 'PROMOTED'").select(*names)
        got = causes.promoted(spark, SF).select(*names)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count()
        every = causes.scored(spark, SF).where("verdict = 'CERTAIN'").where(F.col("kind").isin(*causes.FLOORS))
        assert causes.promotable(spark, SF).count() == every.count()


def test_no_pair_of_tied_users_is_made_for_the_graph(spark, monkeypatch):
    asked, made = [], claims.candidates.near_pairs

    def near(events, entity, *a, **k):
        asked.append(entity)
        return made(events, entity, *a, **k)

    monkeypatch.setattr(claims.candidates, "near_pairs", near)
    with one_graph():
        causes.promoted(spark, SF)
    assert asked == ["user_id"]

"""The fewest kinds of events without which outcomes are out of reach.

A set of types cuts an outcome off from a source if every route between them
passes one of them.  So each pair is worth the type masks of its routes, and of
these only those that hold no other one; a set cuts the pair if it hits them
all.  One walk finds the masks of all pairs; pairs with equal families of masks
are counted, and sets are tried on the families, which a vocabulary bounds.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shared import written

#: A mask is one long.
MOST_TYPES = 63


def _least(masks: Column) -> Column:
    """Of an array of masks those that hold no other one, in order."""
    return F.array_sort(F.filter(masks, lambda m: ~F.exists(masks, lambda o: (o != m) & (o.bitwiseAND(m) == o))))


def route_masks(edges: DataFrame, seeds: DataFrame, bits: DataFrame, depth: int, ends: DataFrame | None = None) -> DataFrame:
    """seed, node, masks: the least type masks of all routes of up to depth links
    from each seed(node) to what it reaches; a route's mask has the types of its
    nodes but the last one's.  ends(node): only the routes to these are told.

    edges(source, target, source_type); bits(event_type, bit), one row per type.
    A round writes a row per seed, node and mask that routes of its length have,
    whatever the number of routes.
    """
    e = edges.select("source", "target", "source_type").distinct().join(F.broadcast(bits.withColumnRenamed("event_type", "source_type")), "source_type")
    e = written(e.select("source", "target", "bit"), "cut-edges")
    last = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).cast("long").alias("mask")).distinct()
    rounds = []
    for _ in range(depth):
        step = last.withColumnRenamed("node", "source").join(e.hint("merge"), "source").select("seed", F.col("target").alias("node"), F.col("mask").bitwiseOR(F.col("bit")).alias("mask"))
        # A route that comes back to its seed holds the mask of what is left without the loop.
        last = written(step.where("seed <> node").distinct(), "routes")
        if last.isEmpty():
            break
        rounds.append(last)
    every = reduce(DataFrame.union, rounds or [last])
    if ends is not None:
        every = every.join(ends.select("node").hint("merge"), "node", "left_semi")
    return every.groupBy("seed", "node").agg(_least(F.collect_set("mask")).alias("masks"))


def closed(types: list[str], groups: list[list[str]], most: int) -> tuple[list[frozenset[str]], list[frozenset[str]]]:
    """(sets, refused): all sets of up to most types, each grown to hold the whole
    of every group that it touches; refused are those that grow beyond most."""
    sets: set[frozenset[str]] = set()
    for n in range(1, min(most, len(types)) + 1):
        sets |= {_grown(frozenset(c), groups) for c in combinations(sorted(types), n)}
    return [s for s in sets if len(s) <= most], [s for s in sets if len(s) > most]


def _grown(members: frozenset[str], groups: list[list[str]]) -> frozenset[str]:
    while True:
        more = members.union(*(g for g in groups if members & set(g)))
        if more == members:
            return members
        members = more


def minimum_cut_sets(routes: DataFrame, bits: DataFrame, groups: list[list[str]], most: int, ceiling: int) -> DataFrame:
    """members, size, broken, considered, regime, minimal of the sets of types tried
    on routes(masks), a row per pair.

    bits(event_type, bit): the candidates.  groups: types that only count
    together.  Up to ceiling candidates every closed set of up to most of them is
    tried: EXACT, and minimal says that no smaller set within it breaks as many
    pairs.  Beyond it, each by itself and then greedily: NOT_PROVEN_MINIMAL, with
    minimal null.  A set that a group makes larger than most is OVERSIZED and not
    tried.  The tables of candidates and of families are as small as the vocabulary.
    """
    spark = routes.sparkSession
    bit = {r.event_type: r.bit for r in bits.collect()}
    families = written(routes.groupBy("masks").agg(F.count("*").alias("pairs")), "families")
    considered = families.agg(F.coalesce(F.sum("pairs"), F.lit(0))).first()[0]

    def broken(sets: list[frozenset[str]]) -> dict[frozenset[str], int]:
        if not sets:
            return {}
        rows = spark.createDataFrame([(i, sum(bit[t] for t in s)) for i, s in enumerate(sets)], "set int, act long")
        hit = families.join(F.broadcast(rows), F.expr("forall(masks, m -> (m & act) <> 0)")).groupBy("set").agg(F.sum("pairs").alias("broken"))
        got = {r["set"]: r.broken for r in hit.collect()}
        return {s: got.get(i, 0) for i, s in enumerate(sets)}

    exact = len(bit) <= ceiling
    tried, refused = closed(list(bit), groups, most if exact else 1)
    if not exact:  # a group alone may be larger than one
        refused, singles = [s for s in refused if len(s) > most], [s for s in tried + refused if len(s) <= most]
        tried = singles
    worth = broken(tried)
    if not exact:
        taken: frozenset[str] = frozenset()
        while True:
            larger = [s for s in {taken | x for x in singles} if s != taken and len(s) <= most]
            gains = broken(larger)
            best = min(gains, key=lambda s: (-gains[s], sorted(s)), default=None)
            if best is None or gains[best] <= worth.get(taken, 0) and taken:
                break
            taken, worth[best] = best, gains[best]
    rows = []
    for s, n in worth.items():
        minimal = not any(o < s and worth[o] >= n for o in worth) if exact else None
        rows.append((",".join(sorted(s)), len(s), n, considered, "EXACT" if exact else "NOT_PROVEN_MINIMAL", minimal))
    rows += [(",".join(sorted(s)), len(s), None, considered, "OVERSIZED", None) for s in refused]
    return spark.createDataFrame(rows, "members string, size int, broken long, considered long, regime string, minimal boolean")


def numbered(types: DataFrame) -> DataFrame:
    """event_type, bit of types(event_type), in order of their names."""
    names = sorted(r.event_type for r in types.select("event_type").where("event_type is not null").distinct().limit(MOST_TYPES + 1).collect())
    if len(names) > MOST_TYPES:
        raise ValueError(f"more than {MOST_TYPES} types of events")
    return types.sparkSession.createDataFrame([(n, 1 << i) for i, n in enumerate(names)], "event_type string, bit long")

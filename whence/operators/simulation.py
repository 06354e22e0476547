"""What the promoted graph would be without some of its events.

A link stops when its source is gone, and an effect is gone when all its links
have stopped; so removal spreads until nothing more goes.  An effect that keeps
some of its links keeps their share of its reading.
"""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written


#: Sets that one long holds as bits.
BITS = 63


def eliminated(edges: DataFrame, removed: DataFrame, world: tuple[str, ...] = ()) -> DataFrame:
    """set_id, node, round of all that goes with each set of removed(set_id, node),
    which themselves go in round 0, all sets in one loop.

    edges(source, target): an edge that comes twice counts once.  world: columns
    by which edges and sets belong to one of several graphs.  Only what the last
    round removed is looked at, and each link into an effect counts once, when it
    stops; a round writes what it removed and what it stopped, nothing of the
    rounds before.  A node in a circuit goes only if all its links do.  Rounds go
    on until nothing more goes: as many as the longest chain has links.
    """
    by = ["set_id", *world]
    e = _with_links(edges.select(*world, "source", "target").distinct(), world)
    last = written(removed.select(*by, "node").distinct(), "gone")
    rounds = [last.withColumn("round", F.lit(0))]
    # What went in round 0 can't go again: it lacks more links than there are.
    waits = [last.select(*by, F.col("node").alias("target"), F.lit(-(1 << 40)).alias("stopped"), F.lit(0).cast("long").alias("links"), F.lit(0).alias("round"))]
    for r in count(1):  # each round removes something, so it ends
        # By merging throughout: rows of a loop that are broadcast go through the driver, round by round.
        now = last.withColumnRenamed("node", "source").join(e.hint("merge"), [*world, "source"]).groupBy(*by, "target").agg(F.count("*").alias("stopped"), F.max("links").alias("links"))
        now = written(now.withColumn("round", F.lit(r)), "stopped")
        every = reduce(DataFrame.unionByName, [*waits, now]).groupBy(*by, "target").agg(F.sum("stopped").alias("stopped"), F.max("links").alias("links"), F.max("round").alias("round"))
        last = written(every.where((F.col("round") == r) & (F.col("stopped") == F.col("links"))).select(*by, F.col("target").alias("node")), "gone")
        if last.isEmpty():
            break
        rounds.append(last.withColumn("round", F.lit(r)))
        waits.append(now.where("stopped < links"))
        if len(rounds) > 16:  # what is known becomes one table again
            rounds = [written(reduce(DataFrame.union, rounds), "gone")]
            waits = [written(reduce(DataFrame.union, waits).groupBy(*by, "target").agg(F.sum("stopped").alias("stopped"), F.max("links").alias("links"), F.max("round").alias("round")), "stopped")]
    return reduce(DataFrame.union, rounds)


def _with_links(edges: DataFrame, world: tuple[str, ...]) -> DataFrame:
    """edges, each with how many links its effect has, written."""
    links = edges.groupBy(*world, "target").agg(F.count("*").alias("links"))
    return written(edges.join(links.hint("merge"), [*world, "target"]), "links")


def simulated(edges: DataFrame, removed: DataFrame, world: tuple[str, ...] = ()) -> DataFrame:
    """set_id, node, kept: what share of its reading each event keeps that a removal
    touches; 0 of those that go.  edges(source, target, weight), the weights of
    an effect's links adding up to one; events that nothing touches have no row.

    Up to 63 sets are bits of one mask of each event, so a round costs no more
    for many sets than for one."""
    names = [r.set_id for r in removed.select("set_id").distinct().limit(BITS + 1).collect()]
    if not 0 < len(names) <= BITS:
        return _simulated_by_rows(edges, removed, world)
    bit = {n: 1 << i for i, n in enumerate(sorted(names))}
    place = F.element_at(F.create_map(*[F.lit(x) for kv in bit.items() for x in kv]), F.col("set_id")).cast("long")
    by = [*world, "node"]
    e = _with_links(edges.groupBy(*world, "source", "target").agg(F.sum("weight").alias("weight")), world)
    start = written(removed.groupBy(*by).agg(F.bit_or(place).alias("mask")), "gone")
    gone, before = start, None
    while True:  # each round but the last adds a bit to some mask
        sources = gone.select(*world, F.col("node").alias("source"), "mask")
        links = e.select(*world, "source", "target", "links").join(sources.hint("merge"), [*world, "source"])
        whole = links.groupBy(*world, F.col("target").alias("node")).agg(F.bit_and("mask").alias("mask"), F.count("*").alias("stopped"), F.max("links").alias("links"))
        whole = whole.where("stopped = links and mask <> 0").select(*by, "mask")
        gone = written(start.unionByName(whole).groupBy(*by).agg(F.bit_or("mask").alias("mask")), "gone")
        n = gone.agg(F.sum(F.bit_count("mask"))).first()[0]
        if n == before:
            break
        before = n
    sources = gone.select(*world, F.col("node").alias("source"), "mask")
    lost = e.join(sources.hint("merge"), [*world, "source"]).groupBy(*world, F.col("target").alias("node"))
    lost = lost.agg(*[F.sum(F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, F.col("weight"))).alias(f"lost{i}") for i, b in enumerate(bit.values())])
    both = lost.join(gone.hint("merge"), by, "full")
    share = lambda i, b: F.when(F.col("mask").bitwiseAND(F.lit(b)) != 0, 0.0).otherwise(F.when(F.col(f"lost{i}").isNotNull(), F.greatest(1 - F.col(f"lost{i}"), F.lit(0.0))))
    told = F.array(*[F.struct(F.lit(n).alias("set_id"), share(i, b).alias("kept")) for i, (n, b) in enumerate(bit.items())])
    return both.select(*by, F.inline(told)).where("kept is not null").select("set_id", *by, "kept")


def _simulated_by_rows(edges: DataFrame, removed: DataFrame, world: tuple[str, ...]) -> DataFrame:
    """simulated() of any number of sets: a row of each set and event."""
    by = ["set_id", *world]
    gone = eliminated(edges, removed, world)
    links = gone.select(*by, F.col("node").alias("source")).join(edges, [*world, "source"])
    lost = links.groupBy(*by, F.col("target").alias("node")).agg(F.sum("weight").alias("lost"))
    rest = lost.join(gone.select(*by, "node"), [*by, "node"], "left_anti").select(*by, "node", F.greatest(1 - F.col("lost"), F.lit(0.0)).alias("kept"))
    return rest.unionByName(gone.select(*by, "node", F.lit(0.0).alias("kept")))


def chains(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, distance, parent, confidence: of the shortest chains from each
    seed to what it reaches the most confident one, the smallest parent among
    equals; confidence is the product along it.

    edges(source, target, scalar), one per pair; seeds(node).  A round keeps one
    row for each seed and node, and writes only what it reached first.
    """
    e = edges.select("source", "target", "scalar")
    last = seeds.select(F.col("node").alias("seed"), "node", F.lit(0).alias("distance"), F.lit(None).cast(seeds.schema["node"].dataType).alias("parent"), F.lit(1.0).alias("confidence"))
    last = written(last.distinct(), "chains")
    rounds = [last]
    for d in range(1, depth + 1):
        step = last.join(e.hint("merge"), last.node == e.source).select("seed", F.col("target").alias("node"), F.lit(d).alias("distance"), F.col("source").alias("parent"), (F.col("confidence") * F.col("scalar")).alias("confidence"))
        # What was reached before is among the rows of the same grouping, by a smaller distance.
        best = reduce(DataFrame.unionByName, [*rounds, step]).groupBy("seed", "node")
        best = best.agg(F.min("distance").alias("distance"), F.max("confidence").alias("confidence"), F.min_by("parent", F.struct(-F.col("confidence"), "parent")).alias("parent"))
        last = written(best.where(F.col("distance") == d).select(*last.columns), "chains")
        if last.isEmpty():
            break
        rounds.append(last)
    return reduce(DataFrame.union, rounds).where("distance > 0")


def greedy_cut(reached: DataFrame, types: DataFrame, most: int) -> DataFrame:
    """turn, event_type, broken: one type after another, each breaking most of the
    (seed, node) connections that are left, the first name among equals.

    reached: (seed, node, event_type) for every type on some connection that
    breaks without it.  The table of types is as small as the vocabulary.
    """
    left, out = reached, None
    for turn in range(1, most + 1):
        counts = left.groupBy("event_type").agg(F.count_distinct("seed", "node").alias("broken"))
        best = written(types.join(counts, "event_type").orderBy(F.col("broken").desc(), "event_type").limit(1).withColumn("turn", F.lit(turn)), "cut")
        out = best if out is None else out.unionByName(best)
        hit = left.join(F.broadcast(best.select("event_type")), "event_type", "left_semi").select("seed", "node").distinct()
        left = left.join(hit, ["seed", "node"], "left_anti")
    return out.select("turn", "event_type", "broken")

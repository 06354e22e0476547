"""The promoted graph: weights, selection, loops, walks, motifs, cuts."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import written
from .profiling import first_rows


def share_of_incoming(edges: DataFrame) -> DataFrame:
    """weight: an edge's scalar over the sum of its effect's; equal parts if that
    is zero.  Sums combine before the shuffle, and AQE splits the join's hot effects."""
    total = edges.groupBy("target").agg(F.sum("scalar").alias("total"), F.count("*").alias("links"))
    weight = F.when(F.col("total") > 0, F.col("scalar") / F.col("total")).otherwise(1 / F.col("links"))
    return edges.join(total.hint("merge"), "target").withColumn("weight", weight).drop("total", "links")


def promotion(edges: DataFrame, floors: dict[str, float], least_evidence: int) -> DataFrame:
    """decision of every edge, the first reason that holds: NO_THRESHOLD for its
    kind, INSUFFICIENT evidence, a VIOLATION or UNDETERMINED order, BELOW its
    floor; else PROMOTED."""
    floor = F.lit(None).cast("double")
    for kind, least in floors.items():
        floor = F.when(F.col("kind") == kind, least).otherwise(floor)
    return edges.withColumn(
        "decision",
        F.when(floor.isNull(), "NO_THRESHOLD")
        .when(F.col("n_generators") < least_evidence, "INSUFFICIENT_EVIDENCE")
        .when(F.col("verdict") == "VIOLATION", "TEMPORAL_MISMATCH")
        .when(F.col("verdict") != "CERTAIN", "NOT_CERTAIN")
        .when(F.col("scalar") < floor, "BELOW_THRESHOLD")
        .otherwise("PROMOTED"),
    )


def top_per_effect(edges: DataFrame, n: int) -> DataFrame:
    return first_rows(edges, ["target"], [F.col("scalar").desc(), "source", "kind"], n).drop("r")


def type_projection(edges: DataFrame) -> DataFrame:
    return edges.groupBy("source_type", "target_type").agg(F.count("*").alias("edges"), F.avg("scalar").alias("mean_scalar"))


def circuits(types: DataFrame, longest: int) -> DataFrame:
    """path of every elementary circuit of a graph of types, from its smallest
    type, by joins that lengthen paths.  The graph of types is as small as the
    vocabulary, whatever the number of events."""
    e = types.select(F.col("source_type").alias("s"), F.col("target_type").alias("t")).distinct()
    paths = e.where("s < t").select(F.array("s", "t").alias("path"))
    found = e.where("s = t").select(F.array("s").alias("path"))
    for _ in range(longest - 1):
        closed = paths.join(e, (F.element_at("path", -1) == F.col("s")) & (F.col("path")[0] == F.col("t"))).select("path")
        found = found.union(closed)
        paths = paths.join(e, F.element_at("path", -1) == F.col("s")).where((F.col("t") > F.col("path")[0]) & ~F.array_contains("path", F.col("t"))).select(F.concat("path", F.array("t")).alias("path"))
    return found


def reach(edges: DataFrame, seeds: DataFrame, depth: int, without: DataFrame | None = None) -> DataFrame:
    """set_id, seed, node, distance of what each seed(set_id, node) reaches in up to
    depth steps, the seed itself left out, in one loop for all of them.

    edges(source, target); without(set_id, node): nodes that a set may not enter.
    A round writes what it reached first; it stops when nothing new is reached.
    """
    e = edges.select("source", "target").distinct()
    if depth > 1:
        e = written(e, "links")
    last = written(seeds.select("set_id", F.col("node").alias("seed"), "node").distinct().withColumn("distance", F.lit(0)), "reach")
    rounds = [last]
    for d in range(1, depth + 1):
        step = last.join(e.hint("merge"), last.node == e.source).select("set_id", "seed", F.col("target").alias("node"), F.lit(d).alias("distance"))
        if without is not None:
            step = step.join(without.select("set_id", "node"), ["set_id", "node"], "left_anti")
        merged = reduce(DataFrame.unionByName, [*rounds, step]).groupBy("set_id", "seed", "node").agg(F.min("distance").alias("distance"))
        last = written(merged.where(F.col("distance") == d), "reach")
        if last.isEmpty():
            break
        rounds.append(last)
    return reduce(DataFrame.union, rounds).where("distance > 0")


def walk(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """seed, node, distance, routes, weight: shortest distance, in how many walks of
    at most depth steps the node is reached, and the weakest link's strength on
    the strongest of them.  A round keeps one row per seed and node, whatever the
    number of walks; a walk that comes back to its seed ends there.

    edges(source, target, scalar), one row per pair.
    """
    e = edges.select("source", "target", "scalar")
    last = seeds.select(F.col("node").alias("seed"), F.col("node"), F.lit(1).cast("bigint").alias("routes"), F.lit(1.0).alias("weight"))
    every = None
    for d in range(1, depth + 1):
        step = last.join(e, (last.node == e.source) & (e.target != last.seed)).groupBy("seed", F.col("target").alias("node"))
        last = written(step.agg(F.sum("routes").alias("routes"), F.max(F.least("weight", "scalar")).alias("weight")), "walk")
        found = last.withColumn("distance", F.lit(d))
        every = found if every is None else every.union(found)
    return every.groupBy("seed", "node").agg(F.min("distance").alias("distance"), F.sum("routes").alias("routes"), F.max("weight").alias("weight"))


def motifs(edges: DataFrame, least: int) -> DataFrame:
    """Type pairs by occurrences and timelines, with at least so many timelines."""
    found = edges.groupBy("source_type", "target_type").agg(F.count("*").alias("occurrences"), F.count_distinct("timeline_id").alias("timelines"))
    return found.where(F.col("timelines") >= least)


def bottlenecks(types: DataFrame) -> DataFrame:
    """Of every type: distinct types before and after it, and edges that touch it."""
    into = types.groupBy(F.col("target_type").alias("event_type")).agg(F.count_distinct("source_type").alias("before"), F.sum("edges").alias("edges_in"))
    out = types.groupBy(F.col("source_type").alias("event_type")).agg(F.count_distinct("target_type").alias("after"), F.sum("edges").alias("edges_out"))
    return into.join(out, "event_type", "full").na.fill(0, ["before", "edges_in", "after", "edges_out"])


def cut_sets(reached: DataFrame, pairs_of: DataFrame, candidates: list, most: int) -> DataFrame:
    """members, broken of every set of up to most candidates: how many of the
    (seed, node) pairs no longer connect.  reached: reach() with each candidate
    set as set_id excluded; pairs_of: reach() with none."""
    base = pairs_of.select("seed", "node")
    left = reached.join(base, ["seed", "node"], "left_semi").groupBy("set_id").agg(F.count("*").alias("left"))
    total = base.agg(F.count("*").alias("total"))
    sets = [",".join(map(str, c)) for k in range(1, most + 1) for c in combinations(sorted(candidates), k)]
    names = reached.sparkSession.createDataFrame([(s,) for s in sets], "set_id string")
    return names.join(left, "set_id", "left").crossJoin(F.broadcast(total)).select(F.col("set_id").alias("members"), (F.col("total") - F.coalesce("left", F.lit(0))).alias("broken"))


def pareto_front(rows: DataFrame, key: str, better_high: list[str], better_low: list[str]) -> DataFrame:
    """Rows that no other row is as good as on every axis and better on one; a
    row with a null axis is left out.  Axes are first grouped, so equal rows
    meet once; meant for a ranked list, not for facts."""
    axes = better_high + better_low
    whole = rows.where(" and ".join(f"{a} is not null" for a in axes))
    points = whole.select(*axes).distinct()
    other = points.select(*[F.col(a).alias(f"o_{a}") for a in axes])
    no_worse = [F.col(f"o_{a}") >= F.col(a) for a in better_high] + [F.col(f"o_{a}") <= F.col(a) for a in better_low]
    differs = [F.col(f"o_{a}") != F.col(a) for a in axes]
    condition, some = no_worse[0], differs[0]
    for c in no_worse[1:]:
        condition = condition & c
    for c in differs[1:]:
        some = some | c
    front = points.join(other, condition & some, "left_anti")
    return whole.join(front, axes, "left_semi").select(key, *axes)

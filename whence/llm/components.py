"""Connected components of an edge table, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges(a long, b long) -> (node, component): the smallest node reachable.

    Every node of a proper edge comes back once; self loops, nulls and repeated
    edges are ignored; an empty table gives an empty table.  Large-star and
    small-star rounds (Kiveris et al., 2014) use grouped minima, which combine
    before the shuffle, and joins whose skewed keys AQE splits, so a hub node
    is never gathered in one task.  Each round ends in a written table.
    """
    star = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")).distinct(),
        "edges",
    )
    seen = _digest(star)
    if seen[0] == 0:
        return star.select(F.col("x").alias("node"), F.col("y").alias("component"))
    for _ in range(max_rounds):
        both = star.select(F.col("x").alias("u"), F.col("y").alias("v")).union(star.select("y", "x"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").where("y <> m").select(F.col("y").alias("x"), F.col("m").alias("y"))
        star = written(small.union(low.select("x", "m")).distinct(), "stars")
        now = _digest(star)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # A fixed point is a forest of stars, so each x has exactly one y.
    nodes = star.select(F.col("x").alias("node"), F.col("y").alias("component"))
    roots = star.select(F.col("y").alias("node"), F.col("y").alias("component")).distinct()
    return nodes.union(roots)


def _digest(df: DataFrame) -> tuple:
    """Row count and order-free hash sums: equal for equal edge sets."""
    h = F.xxhash64("x", "y")
    row = df.agg(F.count("*"), F.coalesce(F.bit_xor(h), F.lit(0)), F.coalesce(F.sum(F.shiftright(h, 16)), F.lit(0))).first()
    return tuple(row)

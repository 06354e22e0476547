"""All pairs of vectors at a cosine of 0.95 or more, by cover trees.

On unit vectors a cosine is a distance, and the levels of a cover tree have
radii that halve.  The top level are pivots from a bounded sample; every vector
belongs to the cell of its nearest pivot, and cells are cut into blocks of
bounded size.  A vector meets another cell only if it lies within that cell's
covering radius and the distance sought; so most pairs of cells of clustered
data never meet.  Where two blocks meet, the lower levels of both trees are
walked together: a pair of nodes goes on only while its centres are no farther
apart than both covering radii and the distance sought.  What is left is
compared exactly, in double precision.  Only each vector's count of links and
edges that join linked vectors leave a task, not the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

COSINE = 0.95
#: Vectors of a block; a task holds two blocks.
BLOCK = 8192
#: Vectors that pivots are chosen from, and pivots at most.
SAMPLE, PIVOTS = 4096, 512
#: Radii of the levels below the pivots.
RADII = (1.0, 0.5, 0.25)
#: Distances are compared with this much to spare; only cosines decide.
SPARE = 1e-6


def reach(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine)) + SPARE


def scaled(rows: np.ndarray) -> np.ndarray:
    """Each vector times a power of two that brings its largest number near one:
    cosines are the same to the bit, and no square overflows."""
    return np.ldexp(rows, -np.frexp(np.abs(rows).max(axis=1, initial=0.0))[1][:, None])


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return scaled(np.asarray(column.flatten(), np.float64).reshape(len(column), dim))


def unit(rows: np.ndarray) -> np.ndarray:
    rows = scaled(np.asarray(rows, np.float64))
    return rows / np.sqrt((rows * rows).sum(axis=1))[:, None]


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (a @ b.T)))


def spread(rows: np.ndarray, most: int) -> np.ndarray:
    """Rows far from each other, each the farthest from those before."""
    chosen, far = [0], distances(rows, rows[:1])[:, 0]
    while len(chosen) < min(most, len(rows)) and far.max() > SPARE:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(rows, rows[chosen[-1:]])[:, 0])
    return rows[chosen]


def cover(rows: np.ndarray, radius: float) -> np.ndarray:
    """Of each row the number of its node: nodes' centres are more than the
    radius apart, and a row lies within it of its own centre."""
    node = np.full(len(rows), -1)
    n, todo = 0, np.arange(len(rows))
    while len(todo):
        some = todo[:128]
        apart = distances(rows[some], rows[some]) > radius
        centres: list[int] = []
        for i in range(len(some)):
            if apart[i, centres].all():
                centres.append(i)
        d = distances(rows[todo], rows[some[centres]])
        near = d.argmin(axis=1)
        inside = d[np.arange(len(todo)), near] <= radius
        node[todo[inside]] = n + near[inside]
        n += len(centres)
        todo = todo[~inside]
    return node


def nodes(rows: np.ndarray) -> list[np.ndarray]:
    """By level the number of each row's node; nodes lie within one of the level above."""
    keys: list[np.ndarray] = []
    for radius in RADII:
        node = np.zeros(len(rows), np.int64)
        if not keys:
            node = cover(rows, radius)
        else:
            n = 0
            order = np.argsort(keys[-1], kind="stable")
            cuts = np.flatnonzero(np.diff(keys[-1][order])) + 1
            for part in np.split(order, cuts):
                node[part] = n + (cover(rows[part], radius) if len(part) > 1 else 0)
                n = int(node[part].max()) + 1
        keys.append(node)
    return keys


class Tree:
    """Rows ordered so that each node's rows are contiguous on every level.  Of
    a part of a block's rows it is the tree that the block's nodes give it."""

    def __init__(self, rows: np.ndarray, keys: list[np.ndarray]):
        self.order = np.lexsort(keys[::-1])
        self.rows = rows[self.order]
        self.starts, self.radius = [], []
        for key in keys:
            k = key[self.order]
            starts = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            size = np.diff(np.r_[starts, len(k)])
            d = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ij->i", self.rows, np.repeat(self.rows[starts], size, axis=0))))
            self.starts.append(starts)
            self.radius.append(np.maximum.reduceat(d, starts))

    def children(self, level: int) -> np.ndarray:
        """Of each node of the level above where its nodes start, and the end."""
        return np.r_[np.searchsorted(self.starts[level], self.starts[level - 1]), len(self.starts[level])]


def _ranges(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    size = last - first
    return np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())


def leaf_pairs(a: Tree, b: Tree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows of a, rows of b) that the bounds can't tell apart."""
    found = []
    for at in range(0, len(a.starts[0]), 512):
        s = a.starts[0][at : at + 512]
        near = distances(a.rows[s], b.rows[b.starts[0]]) <= reach + a.radius[0][at : at + 512, None] + b.radius[0]
        found += [np.flatnonzero(row) for row in near]
    for level in range(1, len(RADII)):
        below_a, below_b = a.children(level), b.children(level)
        lower: list[np.ndarray] = []
        for i, others in enumerate(found):
            mine = np.arange(below_a[i], below_a[i + 1])
            theirs = _ranges(below_b[others], below_b[others + 1])
            if not len(theirs):
                lower += [theirs] * len(mine)
                continue
            near = distances(a.rows[a.starts[level][mine]], b.rows[b.starts[level][theirs]]) <= reach + a.radius[level][mine, None] + b.radius[level][theirs]
            lower += [theirs[row] for row in near]
        found = lower
    ends_a, ends_b = np.r_[a.starts[-1][1:], len(a.rows)], np.r_[b.starts[-1][1:], len(b.rows)]
    for i, others in enumerate(found):
        if len(others):
            theirs = _ranges(b.starts[-1][others], ends_b[others])
            for at in range(a.starts[-1][i], ends_a[i], 1024):
                mine = np.arange(at, min(at + 1024, ends_a[i]))
                for to in range(0, len(theirs), 8192):
                    yield mine, theirs[to : to + 8192]


class Links:
    """Counts and a forest of the links among numbered vectors."""

    def __init__(self, weights: np.ndarray):
        self.weights, self.counts = weights, np.zeros(len(weights), np.int64)
        self.label = np.arange(len(weights))

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        n = len(self.weights)
        self.counts += np.bincount(i, self.weights[j], n).astype(np.int64) + np.bincount(j, self.weights[i], n).astype(np.int64)
        while True:
            x, y = self.label[i], self.label[j]
            if (same := x == y).all():
                return
            i, j, x, y = i[~same], j[~same], x[~same], y[~same]
            np.minimum.at(self.label, np.maximum(x, y), np.minimum(x, y))
            while (self.label[self.label] != self.label).any():
                self.label = self.label[self.label]


def compare(rows: np.ndarray, weights: np.ndarray, side: np.ndarray, keys: list[np.ndarray], cosine: float) -> Links:
    """rows of two blocks (side 0 and 1), or of one (side 0)."""
    links, units = Links(weights), unit(rows)
    own = [np.flatnonzero(side == s) for s in (0, 1)]
    if len(own[0]) == 0 or (len(own[1]) == 0 and (side == 1).any()):
        return links
    a, b = (Tree(units[o], [k[o] for k in keys]) if len(o) else None for o in own)
    b = b or a
    norm = np.sqrt((rows * rows).sum(axis=1))
    for mine, theirs in leaf_pairs(a, b, reach(cosine)):
        i, j = own[0][a.order[mine]], own[1 if len(own[1]) else 0][b.order[theirs]]
        x, y = np.nonzero((rows[i] @ rows[j].T) / (norm[i][:, None] * norm[j]) >= cosine)
        i, j = i[x], j[y]
        if b is a:  # either order comes up
            i, j = i[i < j], j[i < j]
        if len(i):
            links.add(i, j)
    return links


def _groups(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[pa.Table]:
    """Rows sorted by the named columns -> the rows of each of their values."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        cols = [batch.column(n).to_numpy() for n in names]
        new = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
        cuts = [0, *(np.flatnonzero(new) + 1), batch.num_rows]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if e > s:
                key = tuple(c[s] for c in cols)
                if held and key != last:
                    yield pa.Table.from_batches(held).combine_chunks()
                    held = []
                last = key
                held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _build(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block: with the nodes of the block's tree."""
        for t in _groups(batches, "block"):
            for i, key in enumerate(nodes(unit(matrix(t.column("vec").chunk(0), dim)))):
                t = t.append_column(f"k{i}", pa.array(key, pa.int64()))
            yield from t.to_batches(max_chunksize=2000)

    return run


def _compare(dim: int, cosine: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (low, high): what two blocks have to compare."""
        for t in _groups(batches, "low", "high"):
            node, n, side, low, high = (t.column(c).to_numpy() for c in ("node", "n", "side", "low", "high"))
            if low[0] != high[0] and side.min() == side.max():
                continue
            keys = [t.column(f"k{i}").to_numpy() for i in range(len(RADII))]
            found = compare(matrix(t.column("vec").chunk(0), dim), n.astype(float), side, keys, cosine)
            hit = np.flatnonzero(found.counts)
            if len(hit):
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(found.counts[hit]), pa.array(node[found.label[hit]])], names=["node", "links", "root"])

    return run


def _one_dimension(reps: DataFrame, dim: int, n: int, cosine: float) -> DataFrame:
    """reps(node, vec, n) of one length -> node, links, root."""
    spark = reps.sparkSession
    wanted = min(PIVOTS, max(1, math.ceil(n / BLOCK)))
    sample = reps if n <= SAMPLE else reps.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < 1_000_000 * SAMPLE // n)
    rows = np.array([r.vec for r in sample.select("vec").collect()], float)
    shared = spark.sparkContext.broadcast(spread(unit(rows), wanted) if len(rows) else unit(np.ones((1, dim))))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = distances(unit(matrix(batch.column(1), dim)), shared.value)
            cell = d.argmin(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(d[np.arange(len(d)), cell])], names=["node", "vec", "n", "cell", "d"])

    placed = written(reps.select("node", "vec", "n").mapInArrow(assign, f"node long, vec {_kind(reps)}, n long, cell long, d double"), "cells")
    sizes = {r.cell: (r.size, r.radius) for r in placed.groupBy("cell").agg(F.count("*").alias("size"), F.max("d").alias("radius")).collect()}
    blocks, first, radius = {}, {}, {}
    for cell in sorted(sizes):
        first[cell] = sum(blocks.values())
        blocks[cell] = math.ceil(sizes[cell][0] / BLOCK)
        radius[cell] = sizes[cell][1]
    cells = np.array(sorted(sizes), np.int64)
    limits = np.array([radius[c] for c in cells.tolist()]) + reach(cosine) + SPARE
    many_of, first_of = (np.array([by[c] for c in cells.tolist()]) for by in (blocks, first))

    def own_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node = batch.column(0).to_numpy().astype(np.uint64)
            salt = (node * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            at = np.searchsorted(cells, batch.column(3).to_numpy())
            block = first_of[at] + (salt % many_of[at].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(block)], names=["node", "vec", "n", "block"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each pair of blocks that a vector takes part in."""
        pivots = shared.value[cells]
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                row, other = np.nonzero(distances(unit(matrix(batch.column(1), dim)), pivots) <= limits)
                many = many_of[other]
                own = np.repeat(batch.column(3).to_numpy()[row], many)
                theirs = _ranges(first_of[other], first_of[other] + many)
                low, high = np.minimum(own, theirs), np.maximum(own, theirs)
                take = pa.array(np.repeat(row, many))
                kept = [i for i, name in enumerate(batch.schema.names) if name != "block"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(low), pa.array(high), pa.array((own == high) & (low != high), pa.int64()), *(batch.column(i).take(take) for i in kept)],
                    names=["low", "high", "side", *(batch.schema.names[i] for i in kept)],
                )

    levels = "".join(f", k{i} long" for i in range(len(RADII)))
    rows = placed.mapInArrow(own_block, f"node long, vec {_kind(placed)}, n long, block long")
    rows = rows.repartition("block").sortWithinPartitions("block").mapInArrow(_build(dim), f"node long, vec {_kind(placed)}, n long, block long" + levels)
    rows = rows.mapInArrow(meet, f"low long, high long, side long, node long, vec {_kind(placed)}, n long" + levels)
    return rows.repartition("low", "high").sortWithinPartitions("low", "high").mapInArrow(_compare(dim, cosine), "node long, links long, root long")


def _kind(rows: DataFrame) -> str:
    return rows.schema["vec"].dataType.simpleString()


def _floats(rows: DataFrame, column: str) -> bool:
    """Are the numbers floats?  Others are taken as doubles, so that none is rounded."""
    return rows.schema[column].dataType.simpleString() == "array<float>"


def valid(vec) -> F.Column:
    """Neither null nor empty nor zero, and without null or non-finite numbers."""
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad & F.exists(vec, lambda x: x != 0), F.lit(False))


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """id, n_links, component of every row.

    Vectors of different lengths don't link; invalid ones (see valid) link with
    nothing.  Equal vectors count as links of each other, also rows with one
    id.  A row without an id has its component's smallest id, or null.
    """
    table = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<float>" if _floats(rows, vec_col) else "array<double>").alias("vec"))
    good = table.where(valid(F.col("vec")))
    reps = good.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id())
    reps = written(reps, "vectors")
    found = None
    for dim, n in sorted(tuple(r) for r in reps.groupBy(F.size("vec").alias("dim")).count().collect()):
        part = _one_dimension(reps.where(F.size("vec") == dim), dim, n, cosine)
        found = part if found is None else found.union(part)
    if found is None:
        return table.select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    found = written(found, "links")
    parts = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    marked = reps.join(counts, "node", "left").join(parts, "node", "left").select("vec", "id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("root"))
    marked = written(marked, "marked")
    least = marked.groupBy("root").agg(F.min("id").alias("component"))
    marked = marked.join(least, "root").select("vec", "n_links", "component")
    out = table.join(marked, "vec", "left")
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component")).alias("component"))


def op8_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all vectors."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), l AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.95
), r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.c AS component_id, e.vec_id = c.c AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = e.vec_id
JOIN (SELECT a, min(b) AS c FROM r GROUP BY a) c ON c.a = e.vec_id
"""

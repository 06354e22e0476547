"""Benchmark items found in documents, by SimHash of item-sized windows.

A window's fingerprint has 64 bits, of its word pairs.  An item is in the index
with its windows of one size, at most 0.8 of its own: whatever holds a similar
passage holds such a window, cut at its ends or not.  Documents are
fingerprinted in windows of the same sizes, every quarter of a window, and from
their first and to their last word; the item's windows start everywhere, so one
of each is aligned.  Four blocks of 16 bits index the items' fingerprints:
within 11 differing bits some block differs in two or fewer, so the entries at
a block's two-bit neighbours are all within the radius.  The pairs of document
and item found so are verified by the shingles themselves, weighted by how often
each occurs, over all the document's windows of the item's size.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .common import written

SHINGLE = 5
SIMILAR = 0.8
#: Words of a fingerprint's shingles: a changed word changes two of them, not five.
PAIR = 2
RADIUS, BLOCKS, BITS = 11, 4, 16
#: A document's windows start every so many parts of a window.
STEPS = 4
#: Items and bytes of the benchmark that are searched for at once; the rest follows in further passes.
INDEX_ITEMS, INDEX_BYTES = 500, 8 << 20
#: Bytes of text, and words of it, that are searched at once.
SLICE_BYTES, SLICE_WORDS = 4 << 20, 1 << 15

#: Words: ASCII letters and digits, and whatever is not ASCII.
_WORD = re.compile(r"[0-9A-Za-z\x80-\U0010ffff]+")
_SPACES = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_INDEXES: dict[int, Index] = {}


def hashes(own: list[bytes]) -> np.ndarray:
    """XXH64 of words: the same in every process."""
    return np.frombuffer(b"".join([xxhash.xxh64_digest(w) for w in own]), ">u8").astype(np.uint64)


def words(text: str | None) -> list[bytes]:
    """Lower-cased words; as many as _WORD finds in the text itself."""
    return (text or "").lower().encode("utf-8", "replace").translate(_SPACES).split()


def grams(own: list[bytes], k: int) -> list[bytes]:
    return [b" ".join(own[i : i + k]) for i in range(len(own) - k + 1)]


def similarity(window: Counter, item: Counter) -> float:
    """The share of the item's weight that the window has too."""
    return sum(min(n, window[s]) for s, n in item.items()) / item.total()


def window_size(shingles: int) -> int:
    """The largest of 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 14, 16, 20, ... that is at
    most 0.8 of an item's shingles: a quarter apart, so sizes are few."""
    room = max(1, int(SIMILAR * shingles + 1e-9))
    unit = 1 << max(0, room.bit_length() - 3)
    return room // unit * unit


class Votes:
    """Sums of the shingles' bits over windows of any of the sizes: a size is a
    power of two more or less another, and sums over those double."""

    def __init__(self, shingles: np.ndarray):
        self.sums = {1: np.unpackbits(shingles.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)}

    def power(self, p: int) -> np.ndarray:
        if p not in self.sums:
            half = self.power(p // 2)
            half = half.astype(np.uint16 if p < 1 << 15 else np.uint32) if p in (128, 1 << 15) else half
            self.sums[p] = half[: -(p // 2)] + half[p // 2 :]
        return self.sums[p]

    def prints(self, size: int, starts: np.ndarray | slice) -> np.ndarray:
        """Fingerprints of the windows: each bit that of most shingles, repeats counting."""
        top = 1 << size.bit_length() - 1
        n = len(self.sums[1]) - size + 1
        rest = size - top
        votes = self.power(top)[:n][starts]
        while rest:  # of a size, at most the two bits after its first are set
            part = 1 << rest.bit_length() - 1
            votes = votes + self.power(part)[size - rest :][:n][starts]
            rest -= part
        return np.packbits((votes > size // 2).reshape(-1)).view(">u8").astype(np.uint64)


def shingled(of: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k-word shingles of words."""
    with np.errstate(over="ignore"):
        out = np.zeros(max(0, len(of) - k + 1), np.uint64)
        for i in range(k if len(out) else 0):
            out = (out ^ of[i : len(of) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
    return out


class Blocks:
    """Fingerprints (entries) by the two-bit neighbours of their blocks."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        flips = [0, *[sum(1 << b for b in bits) for n in range(1, RADIUS // BLOCKS + 1) for bits in combinations(range(BITS), n)]]
        masks = np.array(flips, np.uint64)
        self.tables = []
        for b in range(BLOCKS):
            cells = ((prints >> np.uint64(BITS * b) & np.uint64((1 << BITS) - 1))[:, None] ^ masks).astype(np.int64)
            order = np.argsort(cells, axis=None, kind="stable")
            ends = np.zeros((1 << BITS) + 1, np.int64)
            np.cumsum(np.bincount(cells.ravel(), minlength=1 << BITS), out=ends[1:])
            self.tables.append((ends, (order // len(masks)).astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of prints, entry) of all within the radius; some twice."""
        rows, found = [], []
        for b, (ends, entries) in enumerate(self.tables):
            cell = (prints >> np.uint64(BITS * b) & np.uint64((1 << BITS) - 1)).astype(np.int64)
            first, n = ends[cell], ends[cell + 1] - ends[cell]
            row = np.repeat(np.arange(len(prints)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            entry = entries[at]
            close = np.bitwise_count(prints[row] ^ self.prints[entry]) <= RADIUS
            rows.append(row[close])
            found.append(entry[close])
        return np.concatenate(rows), np.concatenate(found)


class Index:
    """Items, and their windows' fingerprints by shingle words and window size."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.sizes, self.own = [], [], []
        entries: dict[tuple[int, int], list[tuple[np.ndarray, int]]] = {}
        for item_id, text in items:
            if not (w := words(text)):
                continue
            k = min(PAIR, len(w))
            size = window_size(len(w) - k + 1)
            votes = Votes(shingled(hashes(w), k))
            prints = np.unique(votes.prints(size, slice(None, None, max(1, size // STEPS // STEPS))))
            entries.setdefault((k, size), []).append((prints, len(self.ids)))
            self.ids.append(item_id)
            self.sizes.append(len(w))
            self.own.append(Counter(grams(w, min(SHINGLE, len(w)))))
        self.blocks = {
            key: (Blocks(np.concatenate([p for p, _ in own])), np.concatenate([np.full(len(p), i, np.int32) for p, i in own])) for key, own in entries.items()
        }

    def candidates(self, own: list[list[bytes]]) -> list[set[int]]:
        """Of each document the items that some window of it is near to."""
        out: list[set[int]] = [set() for _ in own]
        flat = hashes([w for ws in own for w in ws])
        sizes = np.array([len(ws) for ws in own], np.int64)
        ends = np.cumsum(sizes)
        for k in {k for k, _ in self.blocks}:
            shingles = shingled(flat, k)
            most = max(size for j, size in self.blocks if j == k)
            for at in range(0, len(shingles), SLICE_WORDS):
                votes = Votes(shingles[at : at + SLICE_WORDS + most - 1])
                for (j, size), (blocks, items) in self.blocks.items():
                    n = min(SLICE_WORDS, len(votes.sums[1]) - size + 1)
                    if j != k or n <= 0:
                        continue
                    step = max(1, size // STEPS)
                    edges = np.concatenate([ends - sizes, ends - size - k + 1]) - at  # from the first word, to the last
                    edges = edges[(edges >= 0) & (edges < n)]
                    starts = np.concatenate([np.arange(0, n, step), edges]) if step > 1 else np.arange(n)
                    prints = votes.prints(size, slice(0, n, step))
                    if step > 1 and len(edges):
                        prints = np.concatenate([prints, votes.prints(size, edges)])
                    row, entry = blocks.near(prints)
                    first = starts[row] + at
                    doc = np.searchsorted(ends, first, side="right")
                    inside = first + size + k - 1 <= ends[np.minimum(doc, len(ends) - 1)]
                    for d, i in set(zip(doc[inside].tolist(), items[entry[inside]].tolist(), strict=True)):
                        out[d].add(i)
        return out

    def search(self, texts: list[str | None]) -> list[dict[int, tuple[float, int, int]]]:
        """Of each text, by item, the best window: similarity, first word, words."""
        own = [words(t) for t in texts]
        out: list[dict] = []
        for ws, near in zip(own, self.candidates(own), strict=True):
            shingles: dict[int, list[bytes]] = {}
            best = {}
            for i in sorted(near):
                k = min(SHINGLE, self.sizes[i])
                if k not in shingles:
                    shingles[k] = grams(ws, k)
                if (found := self._verified(shingles[k], len(ws), k, i)) is not None:
                    best[i] = found
            out.append(best)
        return out

    def _verified(self, shingles: list[bytes], n: int, k: int, i: int) -> tuple[float, int, int] | None:
        """The best window of the item's size, the first of equals, if it is
        similar.  Some best one starts at a shingle of the item or at the last place."""
        item, size = self.own[i], self.sizes[i]
        hits = np.flatnonzero(np.fromiter(map(item.__contains__, shingles), bool, len(shingles)))
        if not len(hits):
            return None
        last = max(0, n - size)
        first = np.unique(np.minimum(hits, last))
        enough = np.searchsorted(hits, first + size - k, side="right") - np.searchsorted(hits, first)
        best = None
        for s in first[enough >= SIMILAR * (size - k + 1) - 1e-9].tolist():
            score = similarity(Counter(shingles[s : s + size - k + 1]), item)
            if score >= SIMILAR - 1e-9 and (best is None or score > best[0]):
                best = (score, s, min(size, n - s))
        return best


def _index(shared) -> Index:
    """One index for each broadcast value and Python worker."""
    if shared.value[0] not in _INDEXES:
        _INDEXES.clear()
        _INDEXES[shared.value[0]] = Index(shared.value[1])
    return _INDEXES[shared.value[0]]


def indexes(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator:
    """Broadcast values of bounded size, one at a time, that together hold all
    items.  Items without words are left out; repeated ones stay."""
    import uuid

    rows = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("length(t) > 0")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(1, -(-n // INDEX_ITEMS), -(-size // INDEX_BYTES))
    for p in range(parts):
        held = [tuple(r) for r in rows.where(F.pmod(F.xxhash64("t", "i"), F.lit(parts)) == p).collect()]
        yield benchmark.sparkSession.sparkContext.broadcast((uuid.uuid4().int, held)), p == parts - 1


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and size < SLICE_BYTES:
            size += len(texts[to] or "")
            to += 1
        yield at, to
        at = to


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, item_id, start, end (code points), similarity: of each document
    and each item that it holds the most similar window, the first of equals.

    Documents that hold no item, null and blank ones too, have no row; rows
    with a repeated or null id are searched each on its own.  An item of fewer
    than five words is one shingle.  No documents or no items: no row.
    A benchmark is searched for in blocks: what a block finds is written before
    the next block is sent.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start", pa.int64()), ("end", pa.int64()), ("similarity", pa.float64())])
    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))

    def searched(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = _index(shared)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                found = []
                for at, to in _slices(texts):
                    for doc_id, text, best in zip(ids[at:to], texts[at:to], index.search(texts[at:to]), strict=True):
                        if best:
                            spans = [m.span() for m in _WORD.finditer(text)]
                            found += [(doc_id, index.ids[i], spans[s][0], spans[s + n - 1][1], score) for i, (score, s, n) in best.items()]
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

        return rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, similarity double")

    out = None
    for shared, last in indexes(benchmark):
        part = searched(shared)
        if not last:
            part = written(part, "found")
            shared.destroy()
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, as they are, that hold no item."""

    def holds(shared):
        @F.pandas_udf(BooleanType())
        def held(texts: pd.Series) -> pd.Series:
            index = _index(shared)
            own = [t if isinstance(t, str) else None for t in texts]
            return pd.Series([bool(best) for at, to in _slices(own) for best in index.search(own[at:to])], dtype=bool)

        return held

    out = docs
    for shared, last in indexes(benchmark):
        out = out.where(~holds(shared)(F.col(text_col)))
        if not last:
            out = written(out, "clean")
            shared.destroy()
    return out


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, as they came."""
    from .common import table

    return clean(docs, table(spark, sf_dir, "benchmark"))


#: Exact similarity of all windows that hold a shingle of the item, over items of five words or more.
OP10_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(text, '[^0-9A-Za-z\x{80}-\x{10ffff}]*[0-9A-Za-z\x{80}-\x{10ffff}]+') AS parts FROM documents),
u AS (SELECT r, doc_id, len(parts) AS n, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM d),
w AS (SELECT r, doc_id, n, pos, regexp_extract(part, '[0-9A-Za-z\x{80}-\x{10ffff}]+') AS word, sum(length(part)) OVER (PARTITION BY r ORDER BY pos) AS to_ FROM u),
g AS (SELECT r, n, pos, lower(concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o)) AS gram FROM w
      WINDOW o AS (PARTITION BY r ORDER BY pos) QUALIFY pos <= n - 4),
i AS (SELECT row_number() OVER () AS b, item_id, regexp_extract_all(text, '[0-9A-Za-z\x{80}-\x{10ffff}]+') AS words FROM benchmark),
iw AS (SELECT b, item_id, len(words) AS size, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM i),
ig AS (SELECT b, item_id, size, pos, lower(concat_ws(' ', word, lead(word) OVER o, lead(word, 2) OVER o, lead(word, 3) OVER o, lead(word, 4) OVER o)) AS gram FROM iw
       WINDOW o AS (PARTITION BY b ORDER BY pos) QUALIFY pos <= size - 4),
goal AS (SELECT b, item_id, size, gram, count(*) AS times FROM ig GROUP BY ALL),
hit AS (SELECT r, n, b, item_id, size, pos, gram, times FROM g JOIN goal USING (gram)),
start AS (SELECT DISTINCT r, b, least(pos, greatest(1, n - size + 1)) AS s FROM hit),
own AS (SELECT hit.r, hit.b, item_id, size, n, s, gram, least(count(*), times) AS both_ FROM start JOIN hit ON hit.r = start.r AND hit.b = start.b AND pos BETWEEN s AND s + size - 5
        GROUP BY hit.r, hit.b, item_id, size, n, s, gram, times),
score AS (SELECT r, b, item_id, size, n, s, sum(both_) / (size - 4) AS similarity FROM own GROUP BY r, b, item_id, size, n, s HAVING sum(both_) / (size - 4) >= 0.8 - 1e-9
          QUALIFY row_number() OVER (PARTITION BY r, b ORDER BY sum(both_) DESC, s) = 1)
SELECT f.doc_id, item_id, CAST(f.to_ - length(f.word) AS BIGINT) AS start, CAST(l.to_ AS BIGINT) AS "end", CAST(similarity AS DOUBLE) AS similarity
FROM score JOIN w AS f ON f.r = score.r AND f.pos = s JOIN w AS l ON l.r = score.r AND l.pos = least(s + size - 1, score.n)
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and the benchmark items that it holds."""
    from .common import table

    return find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

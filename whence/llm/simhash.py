"""SimHash near-duplicates, found by Golay-code fuzzy hashing.

A fingerprint of 64 bits is cut into segments of 22, 21 and 21 bits, each a
word of the perfect [23,12,7] Golay code with the missing bits zero.  Every
such word decodes to exactly one codeword, at three errors or fewer.  Two
fingerprints that differ in four bits or fewer have, by the pigeonhole
principle, two segments that differ in two bits or fewer together.  Then some
word half-way differs from either in one bit at most; so the codeword indices
of the segment pair and of all its neighbours at one bit, about ten keys, have
one in common.  Rows that share a key are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components

#: Fixed value: x^11 + x^9 + x^7 + x^6 + x^5 + x + 1 generates the code.
GENERATOR = 0b101011100011
#: (shift, width) of the segments.
SEGMENTS = ((42, 22), (21, 21), (0, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
RADIUS = 4
#: Of the pipeline's stage: fingerprints of words and of word pairs, and how many of the latter's bits may differ.
WORD_PRINTS, PAIR_PRINTS, PAIR_BITS = 4, 4, 36
#: Rows of a key that one task compares; a longer list is split into blocks.
BLOCK = 8192
#: Broadcast the split keys up to this many rows of 16 bytes.
BROADCAST_ROWS = 200_000


def fingerprint(text: bytes | None, size: int = 4, seed: int = 42) -> bytes:
    """The fingerprint, big-endian.  Null and blank texts: eight zero bytes."""
    words = (text or b"").lower().split()  # bytes: A-Z only, and ASCII white space
    n = len(words)
    if n == 0:
        return bytes(8)
    joined = b" ".join(words)
    if n <= size:
        digests = xxhash.xxh64_digest(joined, seed)
        n = 1
    else:
        ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
        starts = [0, *(e + 1 for e in ends[: n - size])]
        digest = xxhash.xxh64_digest
        digests = b"".join([digest(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=True)])
        n -= size - 1
    rows = np.frombuffer(digests, np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(rows[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(counts * 2 > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, mark long, fp long): a hash of the text that tells rows of one id
    apart, and the fingerprint's bits as a signed number.  One row per input
    row, whatever its id; texts are read whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = [fingerprint(x.as_py(), size) for x in batch.column(2)]
            out = np.frombuffer(b"".join(fps), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["id", "mark", "fp"])

    text = F.col(text_col).cast("string")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("b"))
    return rows.mapInArrow(run, "id long, mark long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    low, high = _parity_tables()
    return low[words & 0xFFF] ^ high[words >> 12]


_TABLES: dict[str, np.ndarray] = {}


def _parity_tables() -> tuple[np.ndarray, np.ndarray]:
    if "low" not in _TABLES:
        rest = []
        for bit in range(23):  # x^bit modulo the generator
            r = 1 << bit
            for top in range(22, 10, -1):
                if r >> top & 1:
                    r ^= GENERATOR << (top - 11)
            rest.append(r)
        for name, bits in (("low", rest[:12]), ("high", rest[12:])):
            t = np.zeros(1 << len(bits), np.int32)
            for k, r in enumerate(bits):
                t[1 << k : 2 << k] = t[: 1 << k] ^ r
            _TABLES[name] = t
    return _TABLES["low"], _TABLES["high"]


def _errors() -> np.ndarray:
    """By syndrome, the one error pattern of three bits or fewer."""
    if "errors" not in _TABLES:
        ones = 1 << np.arange(23)
        two = (ones[:, None] | ones)[np.triu_indices(23, 1)]
        three = np.unique((two[:, None] | ones).ravel())
        words = np.unique(np.concatenate([[0], ones, two, three])).astype(np.int64)
        t = np.zeros(1 << 11, np.int32)
        t[_syndromes(words)] = words
        _TABLES["errors"] = t
    return _TABLES["errors"]


def decode(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword next to each 23-bit word."""
    return (words ^ _errors()[_syndromes(words)]) >> 11


def fuzzy_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of all keys of the fingerprints (uint64), without repeats."""
    own, near = [], []
    for shift, width in SEGMENTS:
        seg = ((fps >> np.uint64(shift)) & np.uint64((1 << width) - 1)).astype(np.int64)
        own.append(decode(seg).astype(np.int64))
        near.append(decode(seg[:, None] ^ (1 << np.arange(width))).astype(np.int64))
    rows, keys = [], []
    for p, (a, b) in enumerate(PAIRS):
        k = np.concatenate([(own[a] << 12 | own[b])[:, None], near[a] << 12 | own[b][:, None], own[a][:, None] << 12 | near[b]], axis=1)
        k.sort(axis=1)
        first = np.ones(k.shape, bool)
        first[:, 1:] = k[:, 1:] != k[:, :-1]
        rows.append(np.nonzero(first)[0])
        keys.append(k[first] | p << 24)
    return np.concatenate(rows), np.concatenate(keys)


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rep, fp = (np.asarray(batch.column(i)) for i in (0, 1))
        for at in range(0, len(fp), 4096):
            row, key = fuzzy_keys(fp[at : at + 4096].view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep[at + row]), pa.array(fp[at + row])], names=["key", "rep", "fp"])


def _linked(group: np.ndarray, side: np.ndarray, rep: np.ndarray, fp: np.ndarray) -> list[np.ndarray]:
    """Edges that join what is linked within each group.  side: 0 and 1 where
    only rows of different sides meet, -1 where all do."""
    out: list[np.ndarray] = []
    n = len(group)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 32, sizes)
    idx = np.flatnonzero(small)
    left = (np.repeat(starts + sizes, sizes) - np.arange(n))[idx]  # rows of the group from here on
    for lag in range(1, 32):
        idx, left = idx[left > lag], left[left > lag]
        if not len(idx):
            break
        near = np.bitwise_count(fp[idx] ^ fp[idx + lag]) <= RADIUS
        if near.any():
            out.append(np.stack([rep[idx[near]], rep[idx[near] + lag]], axis=1))
    for s, m in zip(starts[sizes > 32], sizes[sizes > 32], strict=True):
        f, r, t = fp[s : s + m], rep[s : s + m], side[s : s + m]
        pools = {-1: np.flatnonzero(t == -1)} if t[0] == -1 else {0: np.flatnonzero(t == 0), 1: np.flatnonzero(t == 1)}
        other = {-1: -1, 0: 1, 1: 0}
        while any(len(p) for p in pools.values()):
            k = next(k for k, p in pools.items() if len(p))
            root, queue = pools[k][0], [(k, pools[k][0])]
            pools[k] = pools[k][1:]
            while queue:  # what a row links leaves the pool, so dense groups shrink fast
                k, x = queue.pop()
                pool = pools[other[k]]
                near = np.bitwise_count(f[pool] ^ f[x]) <= RADIUS
                if near.any():
                    hit = pool[near]
                    out.append(np.stack([np.full(len(hit), r[root]), r[hit]], axis=1))
                    queue += [(other[k], y) for y in hit]
                    pools[other[k]] = pool[~near]
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, block), each block whole: edges of a spanning forest."""
    rest: list[np.ndarray] | None = None

    def found(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, block, side, rep, fp = cols
        if len(key) == 0:
            return
        group = np.cumsum(np.r_[False, (key[1:] != key[:-1]) | (block[1:] != block[:-1])])
        if parts := _linked(group, side, rep, fp.view(np.uint64)):
            e = np.concatenate(parts)
            e = np.unique(np.sort(e, axis=1), axis=0)
            e = e[e[:, 0] != e[:, 1]]
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    for batch in batches:
        cols = [np.asarray(batch.column(i)) for i in range(5)]
        if rest is not None:
            cols = [np.concatenate(x) for x in zip(rest, cols, strict=True)]
        if len(cols[0]) == 0:
            continue
        last = (cols[0] == cols[0][-1]) & (cols[1] == cols[1][-1])
        cut = int(np.argmax(last))
        yield from found([c[:cut] for c in cols])
        rest = [c[cut:] for c in cols]
    if rest is not None:
        yield from found(rest)


def links(reps: DataFrame) -> DataFrame:
    """reps(rep long, fp long), fingerprints distinct -> edges(a, b) whose
    components are those of all links; not every link is written out."""
    keyed = reps.select("rep", "fp").mapInArrow(_keyed, "key long, rep long, fp long")
    hot = written(keyed.groupBy("key").count().where(f"count > {BLOCK}").select("key", F.ceil(F.col("count") / BLOCK).cast("int").alias("n")), "hot")
    many = hot.count() > BROADCAST_ROWS
    dealt = keyed.join(hot if many else F.broadcast(hot), "key", "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("n", F.lit(1))).cast("int")
    # A list that was split into n blocks is compared block by block: each row meets its own and every other block.
    dealt = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    dealt = dealt.select(
        "key",
        (low.cast("long") * (1 << 31) + high).alias("block"),
        F.when(low == high, -1).when(F.col("own") == low, 0).otherwise(1).cast("int").alias("side"),
        "rep",
        "fp",
    )
    return dealt.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(_edges, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """(id, mark long, fp long, component long) for every row of docs.

    component: the smallest id reachable over links of four differing bits or
    fewer.  Equal fingerprints are linked, blank texts too (fingerprint zero).
    Repeated rows come back as often as they came.  Rows with a null
    id link others too, and get the component of what they reach, null if nothing has an id.
    """
    marked = written(fingerprints(docs, id_col, text_col, size), "fingerprints")
    # Fingerprints are their own numbers: an id may come with several, or be null.
    reps = written(marked.groupBy("fp").agg(F.min("id").alias("rep")), "reps")
    parts = connected_components(links(reps.select(F.col("fp").alias("rep"), "fp")))
    parts = written(reps.join(parts, reps.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("part")), "parts")
    parts = parts.join(parts.groupBy("part").agg(F.min("rep").alias("component")), "part").select("fp", "component")
    return marked.join(parts, "fp", "left").select("id", "mark", "fp", "component")


def _mixed(h: np.ndarray, seed: int) -> np.ndarray:
    """Other hashes, as good as independent, of the same things."""
    with np.errstate(over="ignore"):
        h = h + np.uint64(0x9E3779B97F4A7C15) * np.uint64(seed)
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def _majority(h: np.ndarray, seed: int) -> int:
    """A fingerprint of a set of hashes, as a signed number; of none: zero."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        rows = _mixed(h[at : at + (1 << 16)], seed).astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(rows, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(h)).tobytes(), "big", signed=True)


def copy_prints(text: bytes | None) -> list[int]:
    """Fingerprints of the set of a text's words, for candidates, and of the set of
    its word pairs, to judge them by.  Sets: what a long text repeats weighs no
    more than what it says once, so a few changed words move few bits."""
    words = (text or b"").lower().split()
    pairs = {a + b" " + b for a, b in zip(words, words[1:], strict=False)} or set(words)
    out = []
    for things, n in ((set(words), WORD_PRINTS), (pairs, PAIR_PRINTS)):
        h = np.frombuffer(b"".join([xxhash.xxh64_digest(x) for x in things]), ">u8").astype(np.uint64)
        out += [_majority(h, seed) for seed in range(1, n + 1)]
    return out


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark long, component long, stays boolean) for every row: the smallest id
    reachable over pairs of rows with equal texts or near copies, and whether the
    row's id and text are the ones that stay for all of these.

    Near copies: one of four fingerprints of their words is within four bits
    (found by the same keys as links()), and of 256 bits on their word pairs no
    more than PAIR_BITS differ.  Five-word shingles that are alike to 0.8 are
    mostly found so, whatever the order of what isn't alike.  Null and blank
    texts are alike.  ids may not be null; different texts may have one id, and
    then are told apart by their texts.
    """
    names = [f"w{i}" for i in range(WORD_PRINTS)] + [f"p{i}" for i in range(PAIR_PRINTS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = zip(*[copy_prints(x.as_py()) for x in batch.column(2)], strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, pa.int64()) for c in cols]], names=["id", "mark", *names])

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("mark"), text.cast("binary").alias("b"))
    marked = written(rows.mapInArrow(run, ", ".join(f"{n} long" for n in ["id", "mark", *names])), "copy-prints")
    # Texts get numbers of their own, in the order of their ids; a text is a hash and all its fingerprints.
    reps = written(marked.groupBy("mark", *names).agg(F.min("id").alias("first")), "copy-texts")
    reps = reps.repartitionByRange("first", "mark").sortWithinPartitions("first", "mark")
    reps = written(reps.withColumn("rep", F.monotonically_increasing_id()), "texts")
    found = []
    for w in names[:WORD_PRINTS]:
        centres = written(reps.groupBy(F.col(w).alias("fp")).agg(F.min("rep").alias("rep")), "centres")
        same = reps.select(F.col("rep").alias("b"), F.col(w).alias("fp")).join(centres.select("fp", F.col("rep").alias("a")), "fp").where("a <> b")
        found += [same.select("a", "b"), links(centres)]
    edges = found[0]
    for e in found[1:]:
        edges = edges.union(e)
    prints = reps.select("rep", *names[WORD_PRINTS:])
    edges = edges.distinct()
    for side in ("a", "b"):
        edges = edges.join(prints.toDF(side, *[f"{side}{i}" for i in range(PAIR_PRINTS)]), side)
    bits = sum((F.bit_count(F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))) for i in range(PAIR_PRINTS)), F.lit(0))
    parts = connected_components(edges.where(bits <= PAIR_BITS).select("a", "b"))
    grouped = written(reps.join(parts, reps.rep == parts.node, "left").select("mark", *names, "rep", "first", F.coalesce("component", "rep").alias("part")), "groups")
    best = grouped.groupBy("part").agg(F.min(F.struct("first", "mark", "rep")).alias("best"))
    grouped = grouped.join(best, "part").select("mark", *names, F.col("best.first").alias("component"), (F.col("rep") == F.col("best.rep")).alias("is_best"))
    return marked.join(grouped, ["mark", *names]).select("id", "mark", "component", (F.col("is_best") & (F.col("id") == F.col("component"))).alias("stays"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies, as it came: that with the smallest id
    (of several texts under it, that with the smallest hash).

    A null id counts as one made from the text, in the range from 2**62 on, so of
    equal texts without ids one stays too.
    """
    made = F.lit(1 << 62) + F.shiftrightunsigned(F.xxhash64("text"), 2)
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce(F.col("doc_id").cast("long"), made).alias("id"), F.col("text"))
    kept = near_copies(marked, "id").where("stays").select("id", "mark").distinct()
    rows = marked.select("doc", "id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"))
    return rows.join(kept, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("doc.*")


def op5_simhash(spark, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    from .common import table

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )

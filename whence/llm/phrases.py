"""Collocations: phrases whose words come together more often than apart.

Words are numbered by how frequent they are in their language.  Adjacent ids
are the coordinates of a pair; a part of the corpus lays its pairs out in
square tiles, counts full tiles by one bincount with the pair as the address,
and sorts what falls into thin ones.  Spark sums the parts' counts.  Frequent
pairs get ranks of their own, and the corpus, rewritten in them, goes through
the same tiles: two overlapping pairs are a phrase of three words, two
overlapping phrases of three words one of four, and so on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

LEAST, LONGEST, TOP = 100, 5, 2000
#: Bytes of text in a part; a longer document is a part of its own.
PART_BYTES = 2 << 20
#: Ids on a side of a tile, and the pairs from which a tile is counted densely.
SIDE, DENSE = 512, 1 << 15
#: Cells and pairs that a task keeps before it hands its counts on, and rows that it sends at once.
KEPT_PAIRS, SENT_ROWS = 1 << 21, 1 << 16
#: Numbers of a level are broadcast up to this many rows and bytes; beyond, parts are joined with them.
BROADCAST_ROWS, BROADCAST_BYTES = 1_000_000, 32 << 20
#: What separates pieces, and upper case.
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"\tABCDEFGHIJKLMNOPQRSTUVWXYZ" + _SEPARATORS, b" abcdefghijklmnopqrstuvwxyz" + b"\n" * len(_SEPARATORS))

PARTS = "lang string, part long, ids binary"


def numbered(texts: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """The words of the texts as numbers within their own list, -1 between pieces."""
    data = (b"\n".join(texts) + b"\n").translate(_PLAIN)
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero((raw == 32) | (raw == 10)) + 1
    offsets = np.concatenate([[0], ends]).astype(np.int64)
    # Each entry ends with the blank or line end that closes it; those of equal words are made one below.
    spelled = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    words: dict[bytes, int] = {}
    entries = spelled.dictionary.to_pylist()
    number = np.array([words.setdefault(e[:-1], len(words)) if len(e) > 1 else -2 for e in entries], np.int32)
    closes = np.array([-1 if e[-1] == 10 else -2 for e in entries], np.int32)
    at = spelled.indices.to_numpy()
    both = np.stack([number[at], closes[at]], axis=1).ravel()
    return _tight(both[both != -2]), list(words)


def _tight(ids: np.ndarray) -> np.ndarray:
    """Without a break after a break."""
    gap = ids < 0
    return ids[~(gap & np.r_[True, gap[:-1]])] if len(ids) else ids


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    waiting: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    number = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32

    def flush(lang: str) -> pa.RecordBatch:
        nonlocal number
        ids, words = numbered(waiting.pop(lang))
        del sizes[lang]
        number += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([lang]), pa.array([number]), pa.array([ids.tobytes()]), pa.array([words], pa.list_(pa.binary()))], names=["lang", "part", "ids", "words"]
        )

    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py()
            waiting.setdefault(lang, []).append(text)
            sizes[lang] = sizes.get(lang, 0) + len(text) + 1
            if sizes[lang] >= PART_BYTES:
                yield flush(lang)
            elif sum(sizes.values()) >= 4 * PART_BYTES:
                yield flush(max(sizes, key=sizes.get))
    for lang in list(waiting):
        yield flush(lang)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, ids, words in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            ids = np.frombuffer(ids.as_py(), np.int32)
            counts = np.bincount(ids[ids >= 0], minlength=len(words))
            yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(words)), words.values, pa.array(counts)], names=["lang", "word", "f"])


class Tiles:
    """Counts of pairs of ids, laid out in square tiles."""

    def __init__(self):
        self.dense: dict[int, np.ndarray] = {}
        self.codes, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __len__(self) -> int:
        return len(self.codes) + SIDE * SIDE * len(self.dense)

    def add(self, ids: np.ndarray) -> None:
        """All adjacent pairs of ids without a break between."""
        a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
        whole = (a >= 0) & (b >= 0)
        a, b = a[whole], b[whole]
        tile = a // SIDE << 32 | b // SIDE
        names, rows = np.unique(tile, return_counts=True)
        thin = np.ones(len(a), bool)
        for name in names[(rows >= DENSE) | np.isin(names, list(self.dense))].tolist():
            inside = tile == name
            thin &= ~inside
            if name not in self.dense:
                self.dense[name] = np.zeros(SIDE * SIDE, np.int64)
            self.dense[name] += np.bincount(a[inside] % SIDE * SIDE + b[inside] % SIDE, minlength=SIDE * SIDE)
        codes, counts = np.unique(a[thin] << 32 | b[thin], return_counts=True)
        self._merge(codes, counts)

    def _merge(self, codes: np.ndarray, counts: np.ndarray) -> None:
        codes, counts = np.concatenate([self.codes, codes]), np.concatenate([self.counts, counts])
        order = np.argsort(codes, kind="stable")  # two sorted runs
        codes, counts = codes[order], counts[order]
        first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
        self.codes, self.counts = codes[first], np.add.reduceat(counts, first) if len(first) else counts

    def drain(self) -> tuple[np.ndarray, np.ndarray]:
        codes, counts = [self.codes], [self.counts]
        for name, grid in self.dense.items():
            at = np.flatnonzero(grid)
            codes.append(((name >> 32) * SIDE + at // SIDE) << 32 | ((name & 0xFFFFFFFF) * SIDE + at % SIDE))
            counts.append(grid[at])
        self.__init__()
        return np.concatenate(codes), np.concatenate(counts)


def _pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, Tiles] = {}

    def drain() -> Iterator[pa.RecordBatch]:
        for lang, tiles in found.items():
            codes, counts = tiles.drain()
            for at in range(0, len(codes), SENT_ROWS):
                own = codes[at : at + SENT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, len(own)), pa.array(own), pa.array(counts[at : at + SENT_ROWS])], names=["lang", "code", "f"])
        found.clear()

    for batch in batches:
        for lang, ids in zip(batch.column(0), batch.column(1), strict=True):
            found.setdefault(lang.as_py(), Tiles()).add(np.frombuffer(ids.as_py(), np.int32))
            if sum(map(len, found.values())) >= KEPT_PAIRS:
                yield from drain()
    yield from drain()


def ranks(df: DataFrame, key: str, order: list[Column], name: str) -> DataFrame:
    """df with each row's place within its key, from 0, by order; no task holds
    a key.  order must leave no ties; df is read twice."""
    placed = df.repartitionByRange(F.col(key), *order).withColumn("_range", F.spark_partition_id())
    placed = placed.withColumn("_at", F.row_number().over(Window.partitionBy(key, "_range").orderBy(*order)))
    placed = written(placed, "ranges")
    # One row for each range and key that it holds: as many as there are partitions and keys together.
    before = placed.groupBy(key, "_range").agg(F.count("*").alias("_n"))
    before = before.select(key, "_range", (F.sum("_n").over(Window.partitionBy(key).orderBy("_range")) - F.col("_n")).alias("_before"))
    return placed.join(before, [key, "_range"]).withColumn(name, F.col("_before") + F.col("_at") - 1).drop("_range", "_at", "_before")


def _lookups(level: DataFrame, column: str) -> dict[str, tuple] | None:
    """The level's numbers by language, sorted by what they number; None beyond the bounds."""
    width = F.octet_length(column) if column == "word" else F.lit(8)
    rows, held = level.agg(F.count("*"), F.coalesce(F.sum(width), F.lit(0))).first()
    if rows > BROADCAST_ROWS or held > BROADCAST_BYTES:
        return None
    t = level.select("lang", column, "id").toArrow().combine_chunks()
    out = {}
    for lang in t.column("lang").unique().to_pylist():
        own = t.filter(pa.compute.equal(t.column("lang"), lang))
        keys, ids = own.column(column).to_pylist() if column == "word" else own.column(column).to_numpy(), own.column("id").to_numpy().astype(np.int32)
        if column == "word":
            out[lang] = dict(zip(keys, ids.tolist(), strict=True))
        else:
            order = np.argsort(keys)
            out[lang] = (keys[order], ids[order])
    return out


def _found(codes: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> np.ndarray:
    if len(keys) == 0:
        return np.full(len(codes), -1, np.int32)
    at = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    return np.where(keys[at] == codes, ids[at], -1).astype(np.int32)


def _pairs_of(ids: np.ndarray) -> np.ndarray:
    """A code for each adjacent pair, -1 where it isn't one."""
    a, b = ids[:-1].astype(np.int64), ids[1:].astype(np.int64)
    return np.where((a >= 0) & (b >= 0), a << 32 | b, -1)


def _one(lang, part, ids: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([part]), pa.array([_tight(ids).tobytes()])], names=["lang", "part", "ids"])


def _words_to_ids(parts: DataFrame, level: DataFrame) -> DataFrame:
    """Local numbers of words become their ranks, -1 for words of no rank."""
    known = _lookups(level, "word")
    if known is not None:
        shared = parts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, part, ids, words in zip(*batch.columns, strict=True):
                    own = shared.value.get(lang.as_py(), {})
                    new = np.array([own.get(w, -1) for w in words.as_py()] + [-1], np.int32)  # a break's -1 stays
                    yield _one(lang.as_py(), part.as_py(), new[np.frombuffer(ids.as_py(), np.int32)])

        return parts.select("lang", "part", "ids", "words").mapInArrow(run, PARTS)
    # A word comes once from each part, however often it is in it.
    asked = parts.select("lang", "part", F.posexplode("words").alias("local", "word")).join(level.select("lang", "word", "id"), ["lang", "word"])
    return _renumbered(parts, asked, lambda ids: ids)


def _pairs_to_ids(parts: DataFrame, level: DataFrame) -> DataFrame:
    """Adjacent ids become the rank of their pair, -1 for pairs of no rank."""
    known = _lookups(level, "code")
    if known is not None:
        shared = parts.sparkSession.sparkContext.broadcast(known)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lang, part, ids in zip(*batch.columns, strict=True):
                    keys, new = shared.value.get(lang.as_py(), (np.zeros(0, np.int64), np.zeros(0, np.int32)))
                    yield _one(lang.as_py(), part.as_py(), _found(_pairs_of(np.frombuffer(ids.as_py(), np.int32)), keys, new))

        return parts.select("lang", "part", "ids").mapInArrow(run, PARTS)

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, ids in zip(*batch.columns, strict=True):
                codes = np.unique(_pairs_of(np.frombuffer(ids.as_py(), np.int32)))
                n = len(codes)
                yield pa.RecordBatch.from_arrays([pa.repeat(lang, n), pa.repeat(part, n), pa.array(codes), pa.array(np.arange(n, dtype=np.int32))], names=["lang", "part", "code", "local"])

    asked = parts.select("lang", "part", "ids").mapInArrow(distinct, "lang string, part long, code long, local int")
    asked = asked.join(level.select("lang", "code", "id"), ["lang", "code"])

    def local(ids: np.ndarray) -> np.ndarray:
        return np.unique(_pairs_of(ids), return_inverse=True)[1]

    return _renumbered(parts, asked, local)


def _renumbered(parts: DataFrame, asked: DataFrame, local) -> DataFrame:
    """asked(part, local, id): what the local numbers of a part are called; a part has as many as it has words."""
    names = asked.groupBy("part").agg(F.collect_list(F.struct("local", "id")).alias("names"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, part, ids, pairs in zip(*batch.columns, strict=True):
                at = local(np.frombuffer(ids.as_py(), np.int32))
                new = np.full(max(at.max(initial=0), 0) + 2, -1, np.int32)
                if pairs.is_valid and len(pairs.values):
                    own, ranked = pairs.values.flatten()
                    new[own.to_numpy()] = ranked.to_numpy()
                yield _one(lang.as_py(), part.as_py(), new[at])

    return parts.select("lang", "part", "ids").join(names, "part", "left").select("lang", "part", "ids", "names").mapInArrow(run, PARTS)


def _level(counts: DataFrame, column: str, least: int) -> DataFrame:
    """Those that are frequent, with their ranks as ids."""
    frequent = written(counts.groupBy("lang", column).agg(F.sum("f").alias("f")).where(F.col("f") >= least), "frequent")
    return written(ranks(frequent, "lang", [F.desc("f"), F.col(column)], "id"), "level")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, DataFrame]:
    """(sizes(lang, n), candidates(lang, len, phrase, a, l, r, n, score, inside)) of docs(lang, text).

    Candidates are all phrases of two to `longest` words that occur `least`
    times or more in their language; inside: a longer candidate holds it and
    occurs as often.  Null langs count as `und`, null texts as empty.  Blank
    pieces have no words.  Texts are read whole; repeated rows count each.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    parts = written(rows.mapInArrow(_parts, PARTS + ", words array<binary>"), "parts")
    counts = parts.select("lang", "ids", "words").mapInArrow(_word_counts, "lang string, word binary, f long")
    counts = written(counts.groupBy("lang", "word").agg(F.sum("f").alias("f")), "words")
    sizes = written(counts.groupBy("lang").agg(F.sum("f").alias("n")), "sizes")
    level = _level(counts, "word", least)
    parts = written(_words_to_ids(parts, level), "ids")
    none = F.array().cast("array<long>")
    table = level.select("lang", "id", "f", F.col("word").cast("string").alias("phrase"), F.col("word").cast("string").alias("last"), none.alias("pre"), none.alias("suf"))
    found = []
    for length in range(2, longest + 1):
        level = _level(parts.select("lang", "ids").mapInArrow(_pair_counts, "lang string, code long, f long"), "code", least)
        pair = level.select("lang", "id", "f", F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(0xFFFFFFFF).alias("b"))
        left = table.select("lang", F.col("id").alias("a"), F.col("phrase").alias("start"), F.concat("pre", F.array("f")).alias("pre"))
        right = table.select("lang", F.col("id").alias("b"), "last", F.concat("suf", F.array("f")).alias("suf"))
        longer = pair.join(left, ["lang", "a"]).join(right, ["lang", "b"])
        longer = written(longer.select("lang", "id", "f", "a", "b", F.concat_ws(" ", "start", "last").alias("phrase"), "last", "pre", "suf"), "phrases")
        if found:
            found[-1] = _inside(found[-1], longer)
        found.append(longer.withColumn("len", F.lit(length)).withColumn("inside", F.lit(False)))
        table = longer
        if length < longest:
            parts = written(_pairs_to_ids(parts, level), "ids")
    every = found[0].select("lang", "len", "phrase", "f", "pre", "suf", "inside")
    for other in found[1:]:
        every = every.union(other.select(every.columns))
    # sizes has a row for each language: no more than the corpus names, and joined like any table.
    return sizes, _scored(every.join(sizes, "lang"))


def _inside(shorter: DataFrame, longer: DataFrame) -> DataFrame:
    """What lies in a phrase of any length lies in one that is one word longer, which is no rarer: those decide."""
    ends = longer.select("lang", F.explode(F.array("a", "b")).alias("id"), "f").groupBy("lang", "id").agg(F.max("f").alias("most"))
    return shorter.join(ends, ["lang", "id"], "left").withColumn("inside", F.coalesce(F.col("most") * 100 >= F.col("f") * 100, F.lit(False))).drop("most")


def _scored(rows: DataFrame) -> DataFrame:
    """With the cut that scores lowest; decimals hold the products, and `div` divides them exactly."""
    rows = rows.withColumn("cut", F.expr("explode(sequence(1, len - 1))")).withColumns({"l": F.expr("pre[cut - 1]"), "r": F.expr("suf[len - cut - 1]")})
    wide = "cast({} as decimal(19, 0))"
    score = f"(1000 * {wide.format('f')} * {wide.format('n')}) div ({wide.format('l')} * {wide.format('r')})"
    lowest = F.min(F.struct(F.expr(score).alias("score"), "cut", "l", "r")).alias("at")
    rows = rows.groupBy("lang", "len", "phrase", F.col("f").alias("a"), "n", "inside").agg(lowest)
    return rows.select("lang", "len", "phrase", "a", "at.l", "at.r", "n", "at.score", "inside")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first `top` candidates of each
    language that aren't inside longer ones; fewer where there are no more."""
    _, candidates = phrases(docs, least, longest)
    kept = written(candidates.where("not inside").drop("inside", "len"), "collocations")
    placed = ranks(kept, "lang", [F.desc("score"), F.desc("a"), F.col("phrase")], "rank").withColumn("rank", F.col("rank") + 1)
    return placed.where(F.col("rank") <= top).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_phrases(spark, sf_dir: str) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first 2000 collocations."""
    from .common import table

    return collocations(table(spark, sf_dir, "documents"))


OP13_SQL = """
WITH lines AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS line
  FROM documents),
pieces AS (
  SELECT lang, row_number() OVER () AS piece, regexp_extract_all(line, '[^\\x20\\x09]+') AS w FROM lines),
spots AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pieces),
counts AS (
  SELECT lang, size, array_to_string(w[i : i + size - 1], ' ') AS phrase, count(*) AS f
  FROM spots, (VALUES (1), (2), (3), (4), (5)) s(size)
  WHERE i + size - 1 <= len(w)
  GROUP BY ALL),
sizes AS (SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE size = 1 GROUP BY lang),
candidates AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS w FROM counts WHERE size > 1 AND f >= 100),
cuts AS (
  SELECT c.*, k, l.f AS l, r.f AS r, n, ((1000::HUGEINT * a * n) // (l.f::HUGEINT * r.f))::BIGINT AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates) c
  JOIN counts l ON l.lang = c.lang AND l.size = k AND l.phrase = array_to_string(c.w[1 : k], ' ')
  JOIN counts r ON r.lang = c.lang AND r.size = c.size - k AND r.phrase = array_to_string(c.w[k + 1 :], ' ')
  JOIN sizes s ON s.lang = c.lang),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
holders AS (
  SELECT lang, a AS most, array_to_string(w[i : i + short - 1], ' ') AS phrase
  FROM (SELECT *, unnest(range(2, size)) AS short FROM candidates), range(1, 5) t(i)
  WHERE i + short - 1 <= size),
kept AS (
  SELECT * FROM lowest x
  WHERE NOT EXISTS (SELECT 1 FROM holders h WHERE h.lang = x.lang AND h.phrase = x.phrase AND 100 * h.most >= 100 * x.a)),
placed AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM placed WHERE rank <= 2000
"""

"""Two tokenizers' tokens of the same text, aligned where both end.

All work inside a task is on Arrow columns.  Lists of token ids are flattened
beside the indices of their parents; segmented cumulative sums of token lengths
give byte offsets; an Acero hash join on the offsets at which tokens end finds
where both tokenizers end one, and those offsets cut the tokens into groups.  A
second join on the groups gives the links, and Table.group_by counts in how many
documents of a slice a pair of ids is linked; Spark adds the slices up.

Neither tokenizer joins what stands before the one space in front of a word with
that space, so both end there: a slice's texts are cut at such spaces, and each
distinct word of the slice is encoded and aligned once.  Slices are written; when
the counts of all are known, documents look up what their words link.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, written
from .tokens import Encoder

#: Bytes of text that are aligned at once.
SLICE_BYTES = 4 << 20
#: Distinct pairs whose counts a task keeps before it hands them on.
KEPT_PAIRS = 1 << 21
#: The most frequent pairs, up to so many, are broadcast with their counts; the others are joined.
HEAD_ROWS = 1_000_000
#: Links of documents that are laid out at once, but for a longer document's.
EXPANDED = 1 << 20
#: Links of a group from which equal tokens of it are counted before they are joined.
LARGE_GROUP = 64
#: ASCII white space, and whether a word may begin with a byte: not white space, nor the first byte of any.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0x85])
_BEGINS = ~np.isin(np.arange(256), [*range(9, 14), *range(28, 33), 0xC2, 0xE1, 0xE2, 0xE3])
#: Fixed value: what the piece tokenizer writes for a space.
_SPACE = "▁"


class Tokenizers:
    """A byte-level BPE file (A) and a piece model with byte fallback (B)."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece

        self._a = Encoder(byte_path)
        self._a.cut = None  # strings of special tokens are plain text
        self._a.tokenizer.encode_special_tokens = True
        self._b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        ranks = self._a.merge.__self__
        entries = {i: s.encode() for s, i in self._a.special.items()}
        self.bytes_a = pa.array([entries[i] if i in entries else ranks.decode_single_token_bytes(i) for i in range(self._a.tokenizer.get_vocab_size())], pa.large_binary())
        pieces = [self._b.id_to_piece(i) for i in range(self._b.get_piece_size())]
        if any(_SPACE in p.lstrip(_SPACE) for p in pieces):
            raise ValueError("pieces that go on after a space")
        self.sizes_a = _lengths(self.bytes_a)
        self.bytes_b = pa.array([bytes([int(p[3:5], 16)]) if self._b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)], pa.large_binary())

    def encode_a(self, words: Words) -> pa.ListArray:
        """All but odd words in one call, as ids never span two words."""
        sizes = np.diff(words.ends, prepend=0)
        strange = (words.raw >= 0xD4) | (words.raw == 0xC2)  # classes of these may differ between libraries, or be blank
        odd = np.diff(np.r_[0, np.cumsum(strange)[words.ends - 1]]) > 0
        odd |= _BLANK[words.raw[words.ends - 1]]
        if not odd.any():
            ids = np.array(self._a.merge(words.raw.tobytes().decode()), np.int32)
            stops = np.searchsorted(np.cumsum(self.sizes_a[ids]), words.ends, "right")
            return pa.ListArray.from_arrays(pa.array(np.r_[0, stops], pa.int32()), pa.array(ids))
        ids = np.array(self._a.merge(words.raw[np.repeat(~odd, sizes)].tobytes().decode()), np.int32)
        stops = np.searchsorted(np.cumsum(self.sizes_a[ids]), np.cumsum(sizes[~odd]), "right")
        counts = np.zeros(len(sizes), np.int64)
        counts[~odd] = np.diff(stops, prepend=0)
        apart = [self._a._plain(words.text(i)) for i in np.flatnonzero(odd).tolist()]
        counts[odd] = [len(x) for x in apart]
        flat = np.zeros(counts.sum(), np.int32)
        of_odd = np.repeat(odd, counts)
        flat[~of_odd] = ids
        flat[of_odd] = np.fromiter(chain.from_iterable(apart), np.int32)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat))

    def encode_b(self, words: Words) -> pa.ListArray:
        """The model itself puts a space first."""
        lists = self._b.encode([words.text(i)[1:] for i in range(len(words.ends))], num_threads=1)
        stops = np.r_[0, np.cumsum([len(x) for x in lists])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(stops), pa.array(np.fromiter(chain.from_iterable(lists), np.int32, stops[-1])))


class Words:
    """Texts that begin with a space, one after the other in UTF-8, and where each ends."""

    def __init__(self, raw: np.ndarray, ends: np.ndarray):
        self.raw, self.ends = raw, ends.astype(np.int64)
        self._stops = [0, *self.ends.tolist()]
        self._bytes = raw.tobytes()

    def text(self, i: int) -> str:
        return self._bytes[self._stops[i] : self._stops[i + 1]].decode()

    def same(self, i: int, other: bytes) -> bool:
        return self._bytes[self._stops[i] : self._stops[i + 1]] == other

    def whole(self) -> bytes:
        return self._bytes


def _lengths(entries: pa.Array) -> np.ndarray:
    return pc.binary_length(entries).to_numpy().astype(np.int64)


class Aligned(NamedTuple):
    """Of each word: tokens, groups, and the groups spelled out; of all: links."""

    good: np.ndarray  # whether both tokenizers give the word's bytes back
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    spelled: list[bytes]
    links: pa.Table  # word, a, b, n (occurrences), by word


def _joined_bytes(ids: pa.Array, entries: pa.Array, stops: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The bytes of all tokens, and where those of each word end."""
    taken = entries.take(ids)
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: len(taken) + 1] if len(taken) else np.zeros(1, np.int64)
    return (bytes(taken.buffers()[2]) if len(taken) else b"")[: ends[-1]], ends[stops]


def align(words: Words, tokenizers: Tokenizers) -> Aligned:
    lists = [tokenizers.encode_a(words), tokenizers.encode_b(words)]
    entries = [tokenizers.bytes_a, tokenizers.bytes_b]
    good = np.ones(len(words.ends), bool)
    for ids, own in zip(lists, entries, strict=True):
        got, ends = _joined_bytes(ids.flatten(), own, ids.offsets.to_numpy())
        if got != words.whole() or not np.array_equal(ends[1:], words.ends):
            good &= [words.same(i, got[s:e]) for i, (s, e) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True))]
    sides = []
    for ids, own in zip(lists, entries, strict=True):
        parent = pc.list_parent_indices(ids).to_numpy()
        flat = pc.list_flatten(ids).to_numpy()
        if not good.all():
            parent, flat = parent[good[parent]], flat[good[parent]]
        sides.append((flat, parent, _offsets(parent, _lengths(own)[flat], words.ends)))
    (a, parent_a, ends_a), (b, parent_b, ends_b) = sides
    # Where both end one: keys are byte offsets in the slice, so they name the word, too.
    both = pa.table({"end": ends_a}).join(pa.table({"end": ends_b}), "end", join_type="inner", use_threads=False)
    cuts = np.sort(both.column("end").to_numpy())
    group_a, group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)
    group_word = np.searchsorted(words.ends, cuts)
    n = len(words.ends)
    return Aligned(
        good,
        np.bincount(parent_a, minlength=n),
        np.bincount(parent_b, minlength=n),
        np.bincount(group_word, minlength=n),
        _spelled(a, group_a, b, group_b, group_word, n),
        _links(a, group_a, b, group_b, group_word),
    )


def _offsets(parent: np.ndarray, lengths: np.ndarray, word_ends: np.ndarray) -> np.ndarray:
    """Where each token ends in the slice: a cumulative sum that starts anew, at its word, in each segment."""
    total = np.cumsum(lengths)
    if len(parent) == 0:
        return total
    first = np.r_[True, parent[1:] != parent[:-1]]
    starts = np.flatnonzero(first)
    word_starts = np.r_[0, word_ends[:-1]][parent[starts]]
    base = np.r_[0, total[starts[1:] - 1]]
    return total + np.repeat(word_starts - base, np.diff(np.r_[starts, len(parent)]))


def _spelled(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, group_word: np.ndarray, n: int) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each word: every number with what follows it is one entry of a table."""
    total = len(a) + len(b)
    out, closes = np.zeros(total, np.int64), np.zeros(total, np.int64)
    groups = len(group_word)
    count_a, count_b = np.bincount(group_a, minlength=groups), np.bincount(group_b, minlength=groups)
    before_b, upto_a = np.cumsum(count_b) - count_b, np.cumsum(count_a)
    place_a, place_b = np.arange(len(a)) + before_b[group_a], np.arange(len(b)) + upto_a[group_b]
    last_a, last_b = np.r_[group_a[1:] != group_a[:-1], True][: len(a)], np.r_[group_b[1:] != group_b[:-1], True][: len(b)]
    ends_word = np.r_[group_word[1:] != group_word[:-1], True][:groups]
    out[place_a], closes[place_a] = a, np.where(last_a, 1, 0)
    out[place_b], closes[place_b] = b, np.where(last_b, np.where(ends_word[group_b], 3, 2), 0)
    high = int(out.max(initial=0)) + 1
    table = pa.array([f"{i}{c}".encode() for c in (",", "|", ";", "") for i in range(high)], pa.large_binary())
    taken = table.take(pa.array(closes * high + out))
    ends = np.frombuffer(taken.buffers()[1], np.int64)[: total + 1] if total else np.zeros(1, np.int64)
    text = bytes(taken.buffers()[2])[: ends[-1]] if total else b""
    per_word = np.zeros(n, np.int64)
    np.add.at(per_word, group_word, count_a + count_b)
    stops = ends[np.r_[0, np.cumsum(per_word)]].tolist()
    return [text[s:e] for s, e in zip(stops[:-1], stops[1:], strict=True)]


def _links(a: np.ndarray, group_a: np.ndarray, b: np.ndarray, group_b: np.ndarray, group_word: np.ndarray) -> pa.Table:
    """(word, a, b, n): of large groups, equal tokens are joined once, with how often they are there."""
    groups = len(group_word)
    large = np.bincount(group_a, minlength=groups) * np.bincount(group_b, minlength=groups) > LARGE_GROUP
    sides = []
    for name, ids, group in (("a", a, group_a), ("b", b, group_b)):
        t = pa.table({"group": group, name: ids, f"n_{name}": np.ones(len(ids), np.int64)})
        if large.any():
            some = pa.array(large[group])
            counted = t.filter(some).group_by(["group", name], use_threads=False).aggregate([(f"n_{name}", "sum")])
            t = pa.concat_tables([t.filter(pc.invert(some)), counted.rename_columns(["group", name, f"n_{name}"])])
        sides.append(t)
    met = sides[0].join(sides[1], "group", join_type="inner", use_threads=False).combine_chunks()
    word = group_word[met.column("group").to_numpy()]
    n = met.column("n_a").to_numpy() * met.column("n_b").to_numpy()
    order = np.argsort(word, kind="stable")
    return pa.table({"word": word[order], "a": met.column("a").to_numpy()[order], "b": met.column("b").to_numpy()[order], "n": n[order]})


class Slice:
    """Some texts, their distinct words, and how those align."""

    def __init__(self, texts: list[str | None], tokenizers: Tokenizers):
        spoken = [b" " + t.encode() if t else b"" for t in texts]
        sizes = np.array([len(t) for t in spoken], np.int64)
        data = b"".join(spoken)
        raw = np.frombuffer(data, np.uint8)
        space = raw == 32
        first = space & np.r_[True, ~space[:-1]][: len(raw)] & np.r_[_BEGINS[raw[1:]], False][: len(raw)]
        doc_starts = np.cumsum(sizes) - sizes
        first[doc_starts[sizes > 0]] = True
        starts = np.flatnonzero(first)
        offsets = np.r_[starts, len(raw)].astype(np.int64) if len(starts) else np.zeros(1, np.int64)
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
        distinct = pa.concat_arrays([words.dictionary])  # from offset zero
        ends = np.frombuffer(distinct.buffers()[1], np.int64)[1 : len(distinct) + 1] if len(distinct) else np.zeros(0, np.int64)
        own = np.frombuffer(distinct.buffers()[2], np.uint8)[: ends[-1]] if len(distinct) else np.zeros(0, np.uint8)
        self.aligned = align(Words(own, ends), tokenizers)
        self.n = len(texts)
        word = words.indices.to_numpy().astype(np.int64)
        # Lists of words by document: the document of each is the index of its parent.
        lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, np.r_[doc_starts, len(raw)]), pa.int32()), pa.array(word))
        doc = pc.list_parent_indices(lists).to_numpy().astype(np.int64)
        if not self.aligned.good.all():
            bad = np.zeros(self.n, bool)
            bad[doc[~self.aligned.good[word]]] = True
            doc, word = doc[~bad[doc]], word[~bad[doc]]
        self.doc, self.word = doc, word
        self.ends = np.searchsorted(doc, np.arange(self.n + 1))
        links = self.aligned.links
        self.codes, self.code = np.unique(links.column("a").to_numpy().astype(np.int64) << 32 | links.column("b").to_numpy(), return_inverse=True)
        self.stops = np.searchsorted(links.column("word").to_numpy(), np.arange(len(ends) + 1))

    def pair_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """In how many of these documents each pair is linked."""
        used = np.unique(self.doc * len(self.stops) + self.word)
        counts = np.zeros(len(self.codes), np.int64)
        # A document's words lie together; some documents' links at a time.
        reached = np.cumsum(np.diff(self.stops)[used % len(self.stops)])
        at = 0
        while at < len(used):
            most = reached[at - 1] + EXPANDED if at else EXPANDED
            end = max(int(np.searchsorted(reached, most)), at + 1)
            end = int(np.searchsorted(used, (used[end - 1] // len(self.stops) + 1) * len(self.stops)))
            doc, word = np.divmod(used[at:end], len(self.stops))
            rows, link = _linked(self.stops, word)
            keys = pa.table({"key": doc[rows] * len(self.codes) + self.code[link]})
            once = keys.group_by("key", use_threads=False).aggregate([]).column("key").to_numpy()
            counts += np.bincount(once % max(len(self.codes), 1), minlength=len(self.codes))
            at = end
        return self.codes, counts


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of slices of about SLICE_BYTES; a longer text is one of its own."""
    first, size, texts = 0, 0, []
    for i, text in enumerate(column):
        text = text.as_py()
        if texts and size + len(text or "") > SLICE_BYTES:
            yield first, texts
            first, size, texts = i, 0, []
        texts.append(text)
        size += len(text or "")
    if texts:
        yield first, texts


_KEPT: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(byte_path: str, piece_path: str) -> Tokenizers:
    """One pair for each Python worker."""
    if (byte_path, piece_path) not in _KEPT:
        _KEPT[byte_path, piece_path] = Tokenizers(byte_path, piece_path)
    return _KEPT[byte_path, piece_path]


def _linked(stops: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into word, link) of all links of these words."""
    sizes = np.diff(stops)[word]
    rows = np.repeat(np.arange(len(word)), sizes)
    return rows, np.arange(len(rows)) + np.repeat(stops[:-1][word] - (np.cumsum(sizes) - sizes), sizes)


def _narrow(codes: np.ndarray) -> type:
    """A type that numbers these codes."""
    return np.uint16 if len(codes) <= 1 << 16 else np.int32


def _segments(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Exact sums of the segments that end before ends[1], ends[2] and so on."""
    totals = np.r_[0, np.cumsum(values)]
    return totals[ends[1:]] - totals[ends[:-1]]


def sliced(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each slice: its documents' ids, counts and digests as lists, and
    as arrays of numbers what its words link, and in how many of its documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = tokenizers(byte_path, piece_path)
        for batch in batches:
            for first, texts in _slices(batch.column(1)):
                s = Slice(texts, pair)
                n = s.aligned.links.column("n").to_numpy()
                counted = [s.aligned.n_a, s.aligned.n_b, s.aligned.n_groups, _segments(n, s.stops)]
                lists = [batch.column(0).slice(first, len(texts)), *(pa.array(_segments(c[s.word], s.ends)) for c in counted), pa.array(_digests(s), pa.string())]
                lists = [pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), pa.concat_arrays([x])) for x in lists]
                codes, f = s.pair_counts()
                odd = np.flatnonzero(n != 1)  # links that are there more than once are few
                arrays = [s.ends, s.word.astype(np.int32), s.stops.astype(np.int32), s.code.astype(_narrow(codes)), np.stack([odd, n[odd]]), codes, f]
                yield pa.RecordBatch.from_arrays([*lists, *(pa.array([x.tobytes()], pa.binary()) for x in arrays)], names=[*LISTS, *ARRAYS])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    kinds = [f"{c} array<{'string' if c == 'groups_sha256' else 'long'}>" for c in LISTS] + [f"{c} binary" for c in ARRAYS]
    path = new_path(docs.sparkSession, "slices")
    found = rows.mapInArrow(run, ", ".join(kinds))
    found.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(found.schema).parquet(path)


def pair_counts(slices: DataFrame) -> DataFrame:
    """(code long, f long): in how many documents the ids code >> 32 of A and code & 0xFFFFFFFF of B are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.Table] = []
        for batch in batches:
            for codes, counts in zip(*batch.columns, strict=True):
                kept.append(pa.table({"code": np.frombuffer(codes.as_py(), np.int64), "f": np.frombuffer(counts.as_py(), np.int64)}))
                if sum(t.num_rows for t in kept) > KEPT_PAIRS:
                    kept = [_added(kept)]
                    if kept[0].num_rows > KEPT_PAIRS // 2:
                        yield from kept.pop().to_batches()
        if kept:
            yield from _added(kept).to_batches()

    counts = slices.select("codes", "f").mapInArrow(run, "code long, f long")
    return counts.where("f > 0").groupBy("code").agg(F.sum("f").alias("f"))


def _added(tables: list[pa.Table]) -> pa.Table:
    t = pa.concat_tables(tables).group_by("code", use_threads=False).aggregate([("f", "sum")])
    return t.rename_columns(["code", "f"]).cast(pa.schema([("code", pa.int64()), ("f", pa.int64())]))


def aligned(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) for every row of docs.

    Null and empty texts, and texts that a tokenizer doesn't give back byte by
    byte, have no tokens: zeros and an empty string.  A pair's count is over
    documents, so repeated rows count each.  The most frequent pairs are looked
    up where the documents are; documents meet the others, if there are such
    with a count above one, in a join.
    """
    slices = sliced(docs, byte_path, piece_path, id_col, text_col)
    counts = written(pair_counts(slices), "pair-counts")
    power_of = F.length(F.bin("f")) - 1
    # A row for each power of two: how many pairs have a count from it to the next.
    by_power = sorted(counts.groupBy(power_of.alias("power")).count().collect(), reverse=True)
    power, held = 64, 0
    for p, n in by_power:
        if held + n > HEAD_ROWS or p == 0:
            break
        power, held = int(p), held + n
    # Without pairs between the head and a count of one, all others count one.
    tail = any(0 < p < power for p, _ in by_power)
    head = counts.where(power_of >= power).toArrow()
    order = np.argsort(head.column("code").to_numpy())
    best = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("f").alias("best")).toArrow()  # as many as A has ids
    most = np.zeros(max(best.column("a").to_pylist(), default=0) + 1, np.int64)
    most[best.column("a").to_numpy()] = best.column("best").to_numpy()
    known = docs.sparkSession.sparkContext.broadcast((head.column("code").to_numpy()[order], head.column("f").to_numpy()[order], most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, f, most = known.value
        for batch in batches:
            for *lists, ends, word, stops, code, n, codes in zip(*batch.columns, strict=True):
                ends, odd, codes = (np.frombuffer(x.as_py(), np.int64) for x in (ends, n, codes))
                word, stops = (np.frombuffer(x.as_py(), np.int32) for x in (word, stops))
                code = np.frombuffer(code.as_py(), _narrow(codes))
                n = np.ones(len(code), np.int64)
                n[odd[: len(odd) // 2]] = odd[len(odd) // 2 :]
                at = np.minimum(np.searchsorted(keys, codes), max(len(keys) - 1, 0))
                found = keys[at] == codes if len(keys) else np.zeros(len(codes), bool)
                count = np.where(found, f[at] if len(keys) else 0, 0 if tail else 1)
                top = (count == most[codes >> 32]) & (count > 0)
                numbers = [_segments(_segments(x, stops)[word], ends) for x in (n * top[code], n * count[code])]
                rest = _tails(ends, word, stops, code, n, codes, ~found) if tail else pa.nulls(len(ends) - 1, _TAIL)
                yield pa.RecordBatch.from_arrays([*(x.values for x in lists), *map(pa.array, numbers), rest], names=[*LISTS, "n_best", "count_sum", "rest"])

    numbers = ["n_a", "n_b", "n_groups", "n_links"]
    schema = f"id long, {', '.join(f'{n} long' for n in numbers)}, groups_sha256 string, n_best long, count_sum long, rest array<struct<code long, n long>>"
    found = slices.select(*LISTS, *ARRAYS[:-1]).mapInArrow(run, schema)
    return (_with_rest(found, counts) if tail else found).select("id", *numbers, "n_best", "count_sum", "groups_sha256")


LISTS = ("id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
ARRAYS = ("ends", "words", "stops", "link", "n", "codes", "f")
_TAIL = pa.list_(pa.struct([("code", pa.int64()), ("n", pa.int64())]))


def _digests(s: Slice) -> list[str]:
    ends, words, spelled = s.ends.tolist(), s.word.tolist(), s.aligned.spelled
    return [hashlib.sha256(b";".join([spelled[w] for w in words[b:e]])).hexdigest() if e > b else "" for b, e in zip(ends[:-1], ends[1:], strict=True)]


def _tails(ends: np.ndarray, word: np.ndarray, stops: np.ndarray, code: np.ndarray, n: np.ndarray, codes: np.ndarray, rare: np.ndarray) -> pa.Array:
    """Each document's links of pairs that weren't looked up: (code, n)."""
    rows, link = _linked(stops, word)
    doc = np.repeat(np.arange(len(ends) - 1), np.diff(ends))[rows]
    some = rare[code[link]]
    t = pa.table({"doc": doc[some], "code": code[link][some], "n": n[link][some]}).group_by(["doc", "code"], use_threads=False).aggregate([("n", "sum")])
    doc, code, n = (t.column(c).to_numpy() for c in ("doc", "code", "n_sum"))
    order = np.argsort(doc, kind="stable")
    values = pa.StructArray.from_arrays([pa.array(codes[code[order]]), pa.array(n[order])], names=["code", "n"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[order], np.arange(len(ends))), pa.int32()), values)


def _with_rest(found: DataFrame, counts: DataFrame) -> DataFrame:
    found = written(found.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = found.select("row", F.explode("rest").alias("link")).select("row", "link.code", "link.n", F.shiftright("link.code", 32).alias("a"))
    best = counts.groupBy(F.shiftright("code", 32).alias("a")).agg(F.max("f").alias("best"))
    added = links.join(counts, "code").join(best, "a").groupBy("row")
    added = added.agg(F.sum(F.col("n") * F.col("f")).alias("more"), F.sum(F.when(F.col("f") == F.col("best"), F.col("n")).otherwise(0)).alias("tops"))
    both = found.join(added, "row", "left")
    return both.withColumns({"count_sum": F.col("count_sum") + F.coalesce("more", F.lit(0)), "n_best": F.col("n_best") + F.coalesce("tops", F.lit(0))})


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document."""
    import public_tokenizers

    from .common import table

    paths = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return aligned(table(spark, sf_dir, "documents"), *paths).withColumnRenamed("id", "doc_id")

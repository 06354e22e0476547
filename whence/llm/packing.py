"""Packing of documents into training sequences by minimum bin slack.

Each partition packs its own documents, so nothing is shuffled: a document
gives full pieces of one sequence each, and a rest.  The rests of a window are
a multiset of lengths; a subset-sum program over bit sets finds the choice that
comes closest to the capacity, and going back through the saved sets gives how
many rests of each length it takes.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

CAPACITY = 2048
END = 1
#: Rests that wait before their window is packed; it bounds a task's memory.
WINDOW = 4096
#: Bytes of text that are encoded at once.
SLICE_BYTES = 4 << 20


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """Of the lengths (each at most counts[length] times) the multiset whose
    sum is largest, at most capacity.  The longest length is always in it."""
    first = max(counts)
    chosen = defaultdict(int, {first: 1})
    room = capacity - first
    reach, mask, steps = 1, (1 << room + 1) - 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length] - (length == first), room // length)
        times = 1
        while left > 0 and not reach >> room & 1:  # 1, 2, 4, ... and the rest make any count
            times = min(times, left)
            steps.append((length, times, reach))
            reach |= reach << length * times & mask
            left -= times
            times *= 2
        if reach >> room & 1:
            break
    at = reach.bit_length() - 1
    for length, times, before in reversed(steps):
        if not before >> at & 1:
            chosen[length] += times
            at -= length * times
    return dict(chosen)


class Packer:
    """Takes pieces and places them: (document, start, length, sequence number,
    offset), the document being whatever came with the piece."""

    def __init__(self, capacity: int = CAPACITY, window: int = WINDOW):
        self.capacity, self.window = capacity, window
        self.waiting: dict[int, list[tuple]] = defaultdict(list)
        self.n = self.tokens = self.sequences = 0

    def full(self, doc, length: int) -> Iterator[tuple]:
        """Pieces of whole sequences; length is a multiple of the capacity."""
        for at in range(0, length, self.capacity):
            yield doc, at, self.capacity, self._next(), 0

    def rest(self, doc, start: int, length: int) -> Iterator[tuple]:
        """A piece under the capacity; gives what its window packs, if full."""
        self._wait(doc, start, length)
        if self.n >= self.window:
            yield from self._pack(self.window // 4)

    def finish(self) -> Iterator[tuple]:
        """Fills all but the last sequence by cutting; the tokens of the last
        go to sequences whose lengths are powers of two, which need no padding."""
        yield from self._pack(0)
        pieces = [(doc, start, k) for k in sorted(self.waiting, reverse=True) for doc, start in self.waiting[k]]
        self.waiting.clear()
        while self.tokens:
            size = min(self.capacity, 1 << self.tokens.bit_length() - 1)
            number, offset = self._next(), 0
            while offset < size:
                doc, start, length = pieces.pop()
                take = min(length, size - offset)
                yield doc, start, take, number, offset
                offset += take
                if take < length:
                    pieces.append((doc, start + take, length - take))
            self.tokens -= size
        self.n = 0

    def _next(self) -> int:
        self.sequences += 1
        return self.sequences - 1

    def _wait(self, doc, start: int, length: int) -> None:
        self.waiting[length].append((doc, start))
        self.n += 1
        self.tokens += length

    def _take(self, length: int) -> tuple:
        doc, start = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.n -= 1
        self.tokens -= length
        return doc, start

    def _pack(self, keep: int) -> Iterator[tuple]:
        while self.n > keep and self.tokens >= self.capacity:
            counts = {k: len(v) for k, v in self.waiting.items()}
            use = fill(counts, self.capacity)
            slack = self.capacity - sum(k * n for k, n in use.items())
            if slack and keep:
                return  # later rests may fit
            for _ in range(1 if slack else min(counts[k] // n for k, n in use.items())):
                number, offset = self._next(), 0
                for length, n in use.items():
                    for _ in range(n):
                        yield *self._take(length), length, number, offset
                        offset += length
                if slack:  # nothing fits: cut the shortest piece that is longer
                    length = min(k for k in self.waiting if k > slack)
                    doc, start = self._take(length)
                    yield doc, start, slack, number, offset
                    self._wait(doc, start + slack, length - slack)


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = CAPACITY,
    end: int = END,
    window: int = WINDOW,
    with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset and, if asked for, ids array<int>.

    A null or empty text is the end id alone.  Rows with a repeated or null id
    are documents of their own.  No table: no row.  Each id of each row lies in
    exactly one piece; sequence_id is unique across partitions.
    """
    step = capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(step, window)
        base = TaskContext.get().partitionId() << 33
        tail = end.to_bytes(4, "little")
        rows: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols, pieces, ends = [[] for _ in range(7)], [], [0]
            for (doc_id, n, ids, at), start, length, number, offset in rows:
                own = memoryview(ids)[4 * (start - at) : 4 * (start - at + length)]
                for c, v in zip(cols, (doc_id, start, length, zlib.crc32(own), n, base + number, offset), strict=True):
                    c.append(v)
                if with_ids:
                    pieces.append(own)
                    ends.append(ends[-1] + length)
            arrays = [pa.array(c, pa.int64()) for c in cols]
            if with_ids:
                values = pa.Array.from_buffers(pa.int32(), ends[-1], [None, pa.py_buffer(b"".join(pieces))])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values))
            return pa.RecordBatch.from_arrays(arrays, names=[x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids)

        for batch in batches:
            ids_in, texts_in = batch.column(0), batch.column(1)
            at = 0
            while at < batch.num_rows:
                to, size = at, 0
                while to < batch.num_rows and (to == at or size < SLICE_BYTES):
                    size += len(texts_in[to].as_buffer()) if texts_in[to].is_valid else 0
                    to += 1
                texts = [t or "" for t in texts_in.slice(at, to - at).to_pylist()]
                for doc_id, ids in zip(ids_in.slice(at, to - at).to_pylist(), enc.encode(texts), strict=True):
                    ids += tail
                    n = len(ids) // 4
                    whole = n - n % step
                    rows += packer.full((doc_id, n, ids, 0), whole)
                    if whole < n:  # what waits holds its own ids only
                        rows += packer.rest((doc_id, n, ids[4 * whole :], whole), whole, n - whole)
                if rows:
                    yield batch_of(rows)
                    rows = []
                at = to
        if last := list(packer.finish()):
            yield batch_of(last)

    source = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return source.mapInArrow(run, SCHEMA + (", ids array<int>" if with_ids else ""))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents, with their ids."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op7_packing(spark, sf_dir: str) -> DataFrame:
    """The pieces of all documents, without their ids."""
    import public_tokenizers

    from .common import table

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), with_ids=False)

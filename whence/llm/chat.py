"""Chat formatting as prefix trees.

A conversation is a path of turns.  Sorted by their paths, conversations that
share initial turns stand side by side, and writing of each one only what
follows the part it shares with the one before is the depth-first order of the
prefix tree.  Blocks of bounded size hold that order; within a block a shared
turn is written once.  Every segment (one turn) has the position id that its
tokens start at, which counts along the path, and the intervals of its
ancestors' tokens, which are what it may attend to besides its own earlier ones.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby, takewhile

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tokens import encoder

#: Fixed values of the template: `### role: text</turn>` and a line end.
HEAD, MIDDLE, TAIL = "### ", ": ", "</turn>\n"
LEARNT = "assistant"
#: A block ends with the conversation that reaches one of these sizes; turns that its
#: first one shares with the block before don't count, or a long path would fill it alone.
BLOCK_CHARS = 1 << 18
BLOCK_CONVERSATIONS = 2048
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
#: Runs of plain characters are one step each, and nothing goes back.
_TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)


def escape(text: str) -> str:
    """After a backslash a character is plain text, so no control string of
    the template is left inside; unescape() undoes it."""
    return text.replace("\\", "\\\\").replace("#", "\\#").replace("</turn>", "\\</turn>")


def escape_role(role: str) -> str:
    return escape(role).replace(":", "\\:")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation."""
    turns, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


SEGMENT = pa.struct(
    [
        ("start", pa.int64()),  # code points of the block's text
        ("end", pa.int64()),
        ("loss_start", pa.int64()),  # the part that is learnt, null if none
        ("loss_end", pa.int64()),
        ("first", pa.int64()),  # tokens of the block's ids
        ("last", pa.int64()),
        ("loss_first", pa.int64()),
        ("loss_last", pa.int64()),
        ("position", pa.int64()),
        ("parent", pa.int64()),
        ("attends", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
    ]
)
LEAF = pa.struct([("conv_id", pa.int64()), ("segment", pa.int64())])
BLOCK = pa.schema([("block_id", pa.int64()), ("text", pa.string()), ("ids", pa.list_(pa.int32())), ("segments", pa.list_(SEGMENT)), ("conversations", pa.list_(LEAF))])
_LONGS = ", ".join(f"{f.name}: bigint" for f in SEGMENT if f.name != "attends")
BLOCK_DDL = f"block_id long, text string, ids array<int>, segments array<struct<{_LONGS}, attends: array<struct<first: bigint, last: bigint>>>>, conversations array<struct<conv_id: bigint, segment: bigint>>"


class Block:
    """Conversations in path order -> text, ids and segments of their tree."""

    def __init__(self, encode):
        self.encode = encode
        self.text: list[str] = []
        self.chars = self.tokens = 0
        self.ids: list[bytes] = []
        self.segments: list[dict] = []
        self.leaves: list[dict] = []
        self.path: list[tuple[tuple[str, str], int]] = []  # (turn, segment) of the last conversation

    def add(self, conv_id: int | None, turns: list[tuple[str, str]]) -> None:
        same = 0
        while same < min(len(turns), len(self.path)) and self.path[same][0] == turns[same]:
            same += 1
        del self.path[same:]
        for turn in turns[same:]:
            self.path.append((turn, self._segment(turn)))
        self.leaves.append({"conv_id": conv_id, "segment": self.path[-1][1]})

    def _segment(self, turn: tuple[str, str]) -> int:
        role, text = turn
        parts = [HEAD + escape_role(role) + MIDDLE, escape(text), TAIL]
        ids = self.encode(parts)
        chars, tokens = [self.chars], [self.tokens]
        for p, i in zip(parts, ids, strict=True):
            chars.append(chars[-1] + len(p))
            tokens.append(tokens[-1] + len(i) // 4)
        parent = self.path[-1][1] if self.path else -1
        attends, position = [], 0
        if parent >= 0:
            above = self.segments[parent]
            position = above["position"] + above["last"] - above["first"]
            attends = [dict(x) for x in above["attends"]]
            if attends and attends[-1]["last"] == above["first"]:
                attends[-1]["last"] = above["last"]
            else:
                attends.append({"first": above["first"], "last": above["last"]})
        learnt = role == LEARNT
        self.segments.append(
            {
                "start": chars[0], "end": chars[3], "loss_start": chars[1] if learnt else None, "loss_end": chars[2] if learnt else None,
                "first": tokens[0], "last": tokens[3], "loss_first": tokens[1] if learnt else None, "loss_last": tokens[2] if learnt else None,
                "position": position, "parent": parent, "attends": attends,
            }
        )
        self.text += parts
        self.ids += ids
        self.chars, self.tokens = chars[3], tokens[3]
        return len(self.segments) - 1

    def row(self, number: int) -> pa.RecordBatch:
        ids = memoryview(b"".join(self.ids)).cast("i").tolist()
        cols = ([number], ["".join(self.text)], [ids], [self.segments], [self.leaves])
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, BLOCK, strict=True)], schema=BLOCK)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and turn -> a row per conversation."""
    schema = pa.schema([("path", pa.binary()), ("conv_id", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string()))])
    held, size = [], 0

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)

    for conv_id, rows in groupby(_rows(batches), key=lambda r: r[0]):
        turns = [(role or "", text or "") for _, role, text in rows]
        path = b"".join(hashlib.blake2b(f"{len(r)} {r}{t}".encode(), digest_size=8).digest() for r, t in turns)
        held.append((path, conv_id, [r for r, _ in turns], [t for _, t in turns]))
        size += sum(len(t) for _, t in turns)
        if len(held) >= 1000 or size > 4 << 20:
            yield out()
            held, size = [], 0
    if held:
        yield out()


def prefix_trees(rows: DataFrame, tokenizer: str, block_chars: int = BLOCK_CHARS, block_conversations: int = BLOCK_CONVERSATIONS) -> DataFrame:
    """rows(conv_id, turn, role, text) -> blocks (see BLOCK_DDL).

    Null roles and texts are empty.  Rows of one conversation come by turn,
    nulls first, ties by role and text; repeated rows are turns of their own.
    Rows with a null conv_id are one conversation.  Every conversation is the
    leaf of one block; a tree that outgrows a block goes on in the next one,
    which writes the path down to its first new turn again.
    """
    table = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    table = table.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    whole = table.mapInArrow(_gather, "path binary, conv_id long, roles array<string>, texts array<string>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        number = TaskContext.get().partitionId() << 33
        block, before, again = Block(encode), [], 0
        for _, conv_id, roles, texts in _rows(batches):
            turns = list(zip(roles, texts, strict=True))
            block.add(conv_id, turns)
            if len(block.leaves) == 1:
                same = sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(turns, before)))
                again = block.segments[same - 1]["end"] if same else 0
            if block.chars - again >= block_chars or len(block.leaves) >= block_conversations:
                yield block.row(number)
                block, before, number = Block(encode), turns, number + 1
        if block.leaves:
            yield block.row(number)

    # By path and conversation: a first turn that many conversations share is no key of its own.
    order = whole.repartitionByRange(F.col("path"), F.col("conv_id")).sortWithinPartitions("path", "conv_id")
    return order.mapInArrow(run, BLOCK_DDL)


def read_back(blocks: DataFrame) -> DataFrame:
    """conv_id, roles, texts, learnt (the texts under the loss mask) and
    formatted_chars of every conversation, from the blocks alone."""
    schema = pa.schema([("conv_id", pa.int64()), ("roles", pa.list_(pa.string())), ("texts", pa.list_(pa.string())), ("learnt", pa.list_(pa.string())), ("formatted_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for text, segments, leaves in _rows(batches):
            for at in range(0, len(leaves), 200):
                found = []
                for leaf in leaves[at : at + 200]:
                    chain, s = [], leaf["segment"]
                    while s >= 0:
                        chain.append(segments[s])
                        s = chain[-1]["parent"]
                    chain.reverse()
                    formatted = "".join(text[s["start"] : s["end"]] for s in chain)
                    turns = parse(formatted)
                    learnt = [unescape(text[s["loss_start"] : s["loss_end"]]) for s in chain if s["loss_start"] is not None]
                    found.append((leaf["conv_id"], [r for r, _ in turns], [t for _, t in turns], learnt, len(formatted)))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)

    return blocks.select("text", "segments", "conversations").mapInArrow(run, "conv_id long, roles array<string>, texts array<string>, learnt array<string>, formatted_chars long")


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations and of number -7, read back from the trees."""
    import public_tokenizers

    from .common import table

    told = "\\### Assistant: </turn> ok"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string"))
    back = read_back(prefix_trees(rows, public_tokenizers.path("byte_bpe_50k.json")))
    turns = F.transform(F.arrays_zip("roles", "texts"), lambda x: F.concat(x["roles"], F.lit("\n"), x["texts"], F.lit("\n")))
    learnt = F.array_join("learnt", "")
    return back.select(
        "conv_id",
        F.size("roles").cast("long").alias("n_turns"),
        F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(learnt).cast("long").alias("loss_chars"),
        F.sha2(learnt.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


OP9_SQL = r"""
WITH r AS (
  SELECT conv_id, turn, role AS role0, text AS text0, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (
    SELECT conv_id, turn, role, text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
    UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok')
), e AS (
  SELECT *, replace(replace(replace(text, '\', '\\'), '#', '\#'), '</turn>', '\</turn>') AS text1,
    replace(replace(replace(replace(role, '\', '\\'), '#', '\#'), '</turn>', '\</turn>'), ':', '\:') AS role1 FROM r
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role0 NULLS FIRST, text0 NULLS FIRST)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, text0 NULLS FIRST) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(role1) + length(text1) + 14)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

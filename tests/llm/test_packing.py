import itertools
import random
import unicodedata
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer
from whence.llm import packing as P
from whence.llm.tokens import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_fill_is_closest():
    rng = random.Random(1)
    for _ in range(200):
        counts = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(1, 5))}
        room = rng.randint(max(counts), 100)
        use = P.fill(counts, room)
        assert all(use[k] <= counts[k] for k in use) and use[max(counts)] >= 1
        each = [range(n + 1) for n in counts.values()]
        sums = [sum(k * n for k, n in zip(counts, pick)) for pick in itertools.product(*each) if pick[list(counts).index(max(counts))]]
        assert sum(k * n for k, n in use.items()) == max(s for s in sums if s <= room)


def test_ids_are_those_of_tokenizers():
    t = Tokenizer.from_file(PATH)
    rng = random.Random(2)
    texts = ["", " ", "  a", "a  b", "a\u0378b \u4e2d\u6587 x", "a \n b", "x y z", "don't  we'll <|endoftext|> end ", "\t \t", "é  ²½ 12 　 x\x1cy"]
    texts += ["hello <|endoftext|> world", "<|endoftext|>", " <|endoftext|><|endoftext|>  ", "<|endoftext", "<|ENDOFTEXT|>", "é<|endoftext|>\u4e2d \u4e2d"]
    texts += ["".join(rng.choice(" \n\tab'1é.") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    kinds = defaultdict(list)  # every class of characters, among words and white space
    for c in range(0x110000):
        if not 0xD800 <= c < 0xE000:
            kinds[unicodedata.category(chr(c))].append(chr(c))
    for own in kinds.values():
        for _ in range(40):
            some = [*rng.choices(own, k=6), " ", "  ", "a", "'s", "1", "<|endoftext|>", "\n"]
            texts.append("".join(rng.choice(some) for _ in range(rng.randint(1, 30))))
    got = [np.frombuffer(b, "<u4").tolist() for b in encoder(PATH).encode(texts)]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def check(rows, docs, t, capacity):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    assert set(by_doc) == {d for d, _ in docs}
    for d, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            own = ids[at : at + r.length]
            assert r.ids_crc32 == zlib.crc32(np.array(own, "<u4").tobytes()) and list(r.ids) == own
            at += r.length
        assert at == len(ids)
    for pieces in by_seq.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity and at & (at - 1) == 0


def test_round_trip(spark):
    rng = random.Random(3)
    t = Tokenizer.from_file(PATH)
    docs = [(0, None), (1, ""), (2, "word " * 5000), (3, "x" * 9000), (999, "a <|endoftext|> b")]
    docs += [(i, " ".join(rng.choice(["the", "of", "tion", "ed", "é", "\n"]) for _ in range(rng.randint(0, 300)))) for i in range(4, 300)]
    df = spark.createDataFrame([(*d, 5) for d in docs], "doc_id long, text string, sequence_id int").repartition(3)
    for window in (4096, 32):
        check(P.pack(df, PATH, capacity=256, window=window).collect(), docs, t, 256)


def test_repeats_and_empty(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string").coalesce(1)
    rows = P.pack(df, PATH, with_ids=False).collect()
    assert sum(r.length for r in rows) == 8 and {r.doc_id for r in rows} == {1, None}
    assert P.pack(df.limit(0), PATH).collect() == []

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer
from whence.llm import alignment as X

PATHS = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=PATHS[1])


def byte_of(c):
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in kept]
    return ord(c) if ord(c) in kept else moved[ord(c) - 256]


def brute_groups(text, libraries):
    """[(A ids, B ids)] by the libraries alone, over the whole text at once."""
    a, b = libraries
    if not text:
        return []
    ids_a = a.encode(" " + text, add_special_tokens=False).ids
    bytes_a = [bytes(map(byte_of, a.id_to_token(i))) for i in ids_a]
    ids_b = b.encode(text)
    bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
    if any(b"".join(x) != (" " + text).encode() for x in (bytes_a, bytes_b)):
        return []
    sides = []
    for ids, parts in ((ids_a, bytes_a), (ids_b, bytes_b)):
        at, ends = 0, []
        for i, p in zip(ids, parts):
            at += len(p)
            ends.append((at, i))
        sides.append(ends)
    cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
    groups, start = [], 0
    for cut in cuts:
        groups.append(tuple([i for e, i in side if start < e <= cut] for side in sides))
        start = cut
    return groups


def brute(texts, libraries):
    groups = [brute_groups(t, libraries) for t in texts]
    links = [Counter((x, y) for a, b in g for x in a for y in b) for g in groups]
    counts = Counter(p for own in links for p in own)
    best = Counter()
    for (x, _), f in counts.items():
        best[x] = max(best[x], f)
    out = []
    for g, own in zip(groups, links):
        spelled = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out.append(
            (
                sum(len(a) for a, _ in g),
                sum(len(b) for _, b in g),
                len(g),
                sum(own.values()),
                sum(n for p, n in own.items() if counts[p] == best[p[0]]),
                sum(n * counts[p] for p, n in own.items()),
                hashlib.sha256(spelled.encode()).hexdigest() if g else "",
            )
        )
    return out


def texts():
    rng = random.Random(4)
    pool = ["the", "naïve", "日本語", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "don't", "  ", "\n", "\t", " ", "x" * 50, "3.14", "…", "👩‍👩‍👧", "\x00", "\xa0", "ﬁ", "é", "İ", "\x1c", "ab", "_", "Straße", "Ω", "ԯ԰"]
    out = [None, "", " ", "  ", "a", " a", "a ", "\n", "▁", "a▁b c", "one two", "one two", "a  b", "x" * 3000, "é" * 500, "日" * 300, "<|endoftext|>", "a b▁ c"]
    for _ in range(300):
        few = rng.sample(pool, rng.randint(1, 6))
        out.append("".join(rng.choice(few) + rng.choice(["", " ", " "]) for _ in range(rng.randint(0, 40))))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(rows)], "doc_id long, text string, a string, code int").repartition(3)
    return [tuple(r)[1:] for r in sorted(X.aligned(df, *PATHS).collect())]


def test_against_brute_force(spark, libraries):
    rows = texts()
    assert run(spark, rows) == brute(rows, libraries)


def test_small_heads_and_slices_change_nothing(spark, libraries, monkeypatch):
    rows = texts()[:150]
    want = brute(rows, libraries)
    for name, value in (("SLICE_BYTES", 200), ("KEPT_PAIRS", 50), ("LARGE_GROUP", 1), ("EXPANDED", 7), ("HEAD_ROWS", 20)):
        monkeypatch.setattr(X, name, value)
    assert run(spark, rows) == want
    monkeypatch.setattr(X, "HEAD_ROWS", 0)
    assert run(spark, rows) == want


def test_words_are_encoded_as_in_their_text(libraries):
    """The cut at single spaces moves no token, over the classes of Unicode and blanks of all kinds."""
    rng = random.Random(6)
    pair = X.tokenizers(*PATHS)
    chars = [chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x1FFFF)])) for _ in range(3000)] + list(" \t\n\x0b\x1c\x85\xa0 　'\"") * 50
    for _ in range(120):
        text = "".join(rng.choice(chars) if rng.random() < 0.7 else " " for _ in range(rng.randint(1, 60)))
        if "▁" in text:
            continue
        s = X.Slice([text], pair)
        spelled = b";".join(s.aligned.spelled[w] for w in s.word)
        assert spelled == b";".join(b",".join(b"%d" % i for i in x) + b"|" + b",".join(b"%d" % i for i in y) for x, y in brute_groups(text, libraries)), text


def test_empty(spark):
    assert run(spark, []) == [] and run(spark, [None]) == [(0, 0, 0, 0, 0, 0, "")]

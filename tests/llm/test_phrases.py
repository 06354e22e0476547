import random
import re
from collections import Counter

import numpy as np
import pytest
from whence.llm import phrases as P


def brute(rows, least, longest, top):
    """Every phrase of every piece, in plain Python."""
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", text):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            for size in range(1, longest + 1):
                for at in range(len(words) - size + 1):
                    key = (lang, tuple(words[at : at + size]))
                    f[key] = f.get(key, 0) + 1
    candidates = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    held = {}
    for (lang, words), a in candidates.items():
        for size in range(2, len(words)):
            for at in range(len(words) - size + 1):
                key = (lang, words[at : at + size])
                held[key] = max(held.get(key, 0), a)
    out = {}
    for (lang, words), a in candidates.items():
        if 100 * held.get((lang, words), 0) >= 100 * a:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = f[lang, words[:k]], f[lang, words[k:]]
            cuts.append((1000 * a * n[lang] // (left * right), k, left, right))
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(words).encode(), left, right))
    rows = []
    for lang, found in out.items():
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(rows)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = ["a", "b", "New", "york", "É", "é", "x" * 300, "\x1c", "\x00", "u　v", "'s", "-", "\xa0"]
    joins = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", "!?", ":", ";"]
    rows = []
    for _ in range(n):
        text = "".join(rng.choice(words[: rng.choice([2, 4, 13])]) + rng.choice(joins) for _ in range(rng.randint(0, 60)))
        rows.append((rng.choice(["en", "de", None, ""]), text))
    return rows + [("en", None), (None, ""), ("fr", "NEW york new York " * 3000), ("en", " \t\n"), rows[0], rows[0]]


COLUMNS = "lang string, text string, code string, f string"


def run(spark, rows, least, longest=5, top=2000):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], COLUMNS).repartition(3)
    return sorted(map(tuple, P.collocations(df, least, longest, top).collect()))


def test_against_brute_force(spark):
    rows = corpus(1)
    want = brute(rows, 20, 5, 60)
    assert run(spark, rows, 20, top=60) == want
    assert len({r[0] for r in want}) == 5 and max(len(r[2].split(" ")) for r in want) == 5


def test_parts_tiles_and_joins_change_nothing(spark, monkeypatch):
    """Tiny tiles and parts, counts handed on early, and levels that are too large to broadcast."""
    rows = corpus(2, 120)
    want = brute(rows, 10, 4, 2000)
    for name, value in (("PART_BYTES", 500), ("SIDE", 2), ("DENSE", 3), ("KEPT_PAIRS", 16), ("SENT_ROWS", 3), ("BROADCAST_ROWS", 0)):
        monkeypatch.setattr(P, name, value)
    assert run(spark, rows, 10, 4) == want


def test_tiles():
    rng = np.random.default_rng(3)
    tiles, want = P.Tiles(), Counter()
    for _ in range(4):
        ids = np.minimum(rng.geometric(0.004, 60_000) - 2, 3000).astype(np.int32)
        want.update((a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist()) if a >= 0 and b >= 0)
        tiles.add(ids)
    assert tiles.dense
    codes, counts = tiles.drain()
    assert dict(zip(((c >> 32, c & 0xFFFFFFFF) for c in codes.tolist()), counts.tolist())) == want and len(codes) == len(want)


def test_products_beyond_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([("en", 2, "a b", big, [big * 3], [big * 5], False, big * 90)], "lang string, len int, phrase string, f long, pre array<long>, suf array<long>, inside boolean, n long")
    (r,) = P._scored(df).collect()
    assert r.score == 1000 * big * (big * 90) // (big * 3 * big * 5)


def test_empty(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [("en", "one"), (None, None)], 1) == []


@pytest.mark.parametrize("text", [b"", b" ", b"A b.c\tD", b"..a", b"a\nb  c!"])
def test_numbering(text):
    ids, words = P.numbered([text])
    pieces = [re.findall(b"[^\x20\x09]+", p) for p in re.split(b"[.,;:!?\x0a-\x0d]", text.lower())]
    got, piece = [], []
    for i in [*ids.tolist(), -1]:
        if i < 0:
            got.append(piece)
            piece = []
        else:
            piece.append(words[i])
    assert [p for p in got if p] == [p for p in pieces if p]

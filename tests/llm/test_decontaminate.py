import random
import re
from collections import Counter

import numpy as np
from whence.llm import decontaminate as D
from whence.llm.common import table


def brute(docs, items):
    """Every window of every item's length, without fingerprints."""
    out = {}
    for d, text in docs:
        own = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (text or "").lower())
        for i, item in items:
            want = re.findall(r"[0-9a-z\x80-\U0010ffff]+", (item or "").lower())
            if not want:
                continue
            k = min(5, len(want))
            goal = Counter(tuple(want[j : j + k]) for j in range(len(want) - k + 1))
            best = 0
            for s in range(max(0, len(own) - len(want)) + 1):
                w = own[s : s + len(want)]
                seen = Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1))
                best = max(best, sum(min(n, seen[g]) for g, n in goal.items()) / goal.total())
            if best >= 0.8 - 1e-9:
                out[d, i] = best
    return out


def cases(seed=1):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(12, 60)))) for i in range(40)]
    items += [(50, None), (51, " . "), (52, "two words"), (53, items[0][1]), (54, "same same same same same same same same same same same same")]
    docs = [(0, None), (1, ""), (2, "two"), (3, "Two, WORDS!"), (4, "same " * 1500)]
    for d in range(5, 150):
        own = say(rng.randint(0, 100))
        for _ in range(rng.randint(0, 2)):
            part = rng.choice(items[:40])[1].split()
            for _ in range(rng.randint(0, 3)):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            at = rng.randint(0, len(own))
            own[at:at] = [w.upper() + rng.choice(["", ",", "."]) for w in part[rng.randint(0, 3) :]]
        docs.append((d, " ".join(own)))
    return docs, items


def test_against_brute_force(spark):
    docs, items = cases()
    want = brute(docs, items)
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, similarity double, item_id string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = D.find(df, bench).collect()
    texts = dict(docs)
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == {k: round(v, 9) for k, v in want.items()}
    assert len(want) > 40
    for r in got:
        part = D.words(texts[r.doc_id][r.start : r.end])
        item = D.words(dict(items)[r.item_id])
        k = min(5, len(item))
        assert abs(D.similarity(Counter(D.grams(part, k)), Counter(D.grams(item, k))) - r.similarity) < 1e-9
    kept = {r.doc_id for r in D.clean(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_many_indexes_lose_nothing(spark, monkeypatch):
    docs, items = cases(2)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    once = sorted(map(tuple, D.find(df, bench).collect()))
    monkeypatch.setattr(D, "INDEX_ITEMS", 20)
    assert sorted(map(tuple, D.find(df, bench).collect())) == once


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 2**63, 50).astype(np.uint64)
    blocks = D.Blocks(prints)
    near = [int(rng.choice(prints)) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 20), replace=False)) for _ in range(300)]
    got = set(zip(*(a.tolist() for a in blocks.near(np.array(near, np.uint64))), strict=True))
    assert got == {(r, i) for r, f in enumerate(near) for i, p in enumerate(prints) if (int(p) ^ f).bit_count() <= D.RADIUS}


def test_prints_are_majorities():
    rng = np.random.default_rng(4)
    h = rng.integers(0, 2**63, 700).astype(np.uint64)
    for size in {D.window_size(n) for n in range(1, 800)}:
        got = D.Votes(h).prints(size, slice(0, None, 7))
        for row, s in enumerate(range(0, len(h) - size + 1, 7)):
            own = h[s : s + size].tolist()
            assert int(got[row]) == sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in own) > size)


def test_fingerprints_choose_and_find_nine_in_ten():
    """Edited items among other words: most that are similar are candidates, and little else is."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 6))) for _ in range(2000)]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(say(rng.randint(12, 120)))) for i in range(60)]
    index = D.Index(items)
    docs, want = [], []
    for _ in range(1500):
        i = rng.randrange(60)
        part = items[i][1].split()
        n = max(1, len(part) // 5)
        how = rng.randrange(3)
        if how == 0:
            for _ in range(rng.randint(1, max(1, len(part) // 20))):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
        elif how == 1:
            part = part[rng.randint(0, n) :]
        else:
            at = rng.randint(0, len(part) - n)
            part[at : at + n] = say(n)
        doc = [w.encode() for w in say(rng.randint(0, 200)) + part + say(rng.randint(0, 200))]
        k = min(5, index.sizes[i])
        best = index._verified(D.grams(doc, k), len(doc), k, i)
        if best and best[0] < 0.85:
            docs.append(doc)
            want.append(i)
    near = index.candidates(docs)
    assert len(want) > 200 and sum(i in found for i, found in zip(want, near, strict=True)) >= 0.9 * len(want)
    assert sum(map(len, near)) < 1.1 * len(docs)


def test_empty(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find(docs, none).collect() == [] and D.clean(docs, none).count() == 1
    assert D.find(docs.limit(0), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_whole_passages_of_the_tables(spark):
    d = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in table(spark, d, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in table(spark, d, "benchmark").collect()]
    inside = {(i, k) for i, t in docs for k, b in items if b in t}
    got = {(r.doc_id, r.item_id) for r in D.op10_decontaminate(spark, d).collect()}
    assert inside <= got and inside

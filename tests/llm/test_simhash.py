import random

import numpy as np
import xxhash
from whence.llm import simhash as S
from whence.llm.components import connected_components


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [words[i : i + 4] for i in range(len(words) - 3)] or [words]
    hashes = [xxhash.xxh64_intdigest(b" ".join(g), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    root = {i: i for i in ids}
    changed = True
    while changed:
        changed = False
        for i, f in zip(ids, fps):
            for j, g in zip(ids, fps):
                if bin(f ^ g).count("1") <= 4 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return root


def test_golay_code_is_perfect():
    index = S.decode(np.arange(1 << 23, dtype=np.int64))
    assert (np.bincount(index, minlength=4096) == 2048).all()
    assert (np.bitwise_count(S._errors()) <= 3).all() and len(np.unique(S._errors())) == 2048


def test_keys_meet_within_the_radius():
    rng = random.Random(1)
    for n in range(400):
        f = rng.getrandbits(64)
        g = f
        for b in rng.sample(range(64), n % 5):
            g ^= 1 << b
        _, a = S.fuzzy_keys(np.array([f], np.uint64))
        _, b = S.fuzzy_keys(np.array([g], np.uint64))
        assert set(a) & set(b)


def docs(rng):
    base = [" ".join(rng.choice("abcdefghijklmnop") * rng.randint(1, 3) for _ in range(rng.randint(3, 120))) for _ in range(40)]
    texts = [None, "", " \n\t ", "one", "One", "two words", "x" * 200_000, "é É", "word " * 30_000]
    for t in base:
        texts += [t, t.upper(), t + " tail", t.replace("a", "b", 1)]
    return list(enumerate(texts)) + [(3, "one"), (None, "one"), (None, "lonely text that nobody shares at all")]


def test_against_brute_force(spark):
    rows = docs(random.Random(2))
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, fp long, component string")
    got = S.near_duplicates(df).collect()
    assert len(got) == len(rows)
    assert sorted((r.id, r.fp) for r in got if r.id is not None) == sorted((i, int(np.uint64(brute_fingerprint(t)).astype(np.int64))) for i, t in rows if i is not None)
    known = [(i, brute_fingerprint(t)) for i, t in rows if i is not None]
    root = brute_components([i for i, _ in known], [f for _, f in known])
    assert {r.id: r.component for r in got if r.id is not None} == root
    assert sorted([r.component for r in got if r.id is None], key=str) == [3, None]


def test_split_lists_lose_no_link(spark, monkeypatch):
    rng = np.random.default_rng(3)
    fps = [int(f) for f in rng.integers(0, 1 << 62, 30)]
    fps += [fps[0] ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 63, (250, 2))]
    fps = sorted(set(fps))
    df = spark.createDataFrame(list(enumerate(fps)), "rep long, fp long")
    whole = {tuple(r) for r in connected_components(S.links(df)).collect()}
    monkeypatch.setattr(S, "BLOCK", 20)
    split = {tuple(r) for r in connected_components(S.links(df)).collect()}
    root = brute_components(range(len(fps)), fps)
    linked = {k: v for k, v in root.items() if list(root.values()).count(v) > 1}
    assert whole == split == set(linked.items())


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == []


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 100), (7, 7), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {i: 0 for i in range(51)} | {100: 100, 101: 100}


def test_rows_without_ids_link_others(spark, monkeypatch):
    a, null, b, alone, other = 0, 0b1111, 0b11111111, 0xFF << 40, 0xFFFF << 20
    rows = [(7, 0, a), (None, 0, null), (5, 0, b), (None, 0, alone), (9, 0, other), (None, 0, other)]
    monkeypatch.setattr(S, "fingerprints", lambda docs, *_: docs)
    got = S.near_duplicates(spark.createDataFrame(rows, "id long, mark long, fp long")).collect()
    assert sorted((r.fp, r.component) for r in got) == sorted([(a, 5), (null, 5), (b, 5), (alone, None), (other, 9), (other, 9)])


def test_ids_with_several_texts(spark):
    """Unlike fingerprints under one id stay apart, in chains, too; brute force over rows."""
    rng = random.Random(8)
    rows = []
    for _ in range(40):
        f = rng.getrandbits(62)
        for _ in range(rng.randint(1, 5)):
            rows.append((rng.choice([None, *range(12)]), f))
            for b in rng.sample(range(62), rng.randint(0, 3)):
                f ^= 1 << b
    root = brute_components(range(len(rows)), [f for _, f in rows])
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root[i]] = min(least.get(root[i], d), d)
    df = spark.createDataFrame([(d, 0, f) for d, f in rows], "id long, mark long, fp long").repartition(3)
    found = S.fingerprints
    S.fingerprints = lambda docs, *_: docs
    try:
        got = S.near_duplicates(df).collect()
    finally:
        S.fingerprints = found
    assert sorted((str(r.id), r.fp, str(r.component)) for r in got) == sorted((str(d), f, str(least.get(root[i]))) for i, (d, f) in enumerate(rows))


def test_stage_keeps_unlike_texts_of_one_id(spark):
    rng = random.Random(5)
    a, b = ([rng.choice("abcdefghijklmnopqrstuvwxyz") * rng.randint(1, 4) + str(rng.randint(0, 99)) for _ in range(200)] for _ in range(2))
    near = [*a[:100], "other", *a[101:]]
    rows = [(5, " ".join(a)), (5, " ".join(b)), (3, " ".join(near)), (7, " ".join(b)), (7, " ".join(b)), (9, " ".join(near[:-1])), (9, " ".join(a[1:]))]
    kept = S.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, kept)) == sorted([rows[2], rows[1]])
    # Two near copies under the smallest id: one of them stays.
    rows = [(1, " ".join(a)), (1, " ".join(near)), (2, " ".join(near))]
    kept = S.stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    assert len(kept) == 1 and kept[0].doc_id == 1


def brute_copies(texts):
    """Every pair of texts by all its fingerprints: {id: smallest id reachable}."""
    ids = list(texts)
    prints = [S.copy_prints(texts[i].encode()) for i in ids]
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    n = S.WORD_PRINTS
    for k, a in enumerate(prints):
        for m, b in enumerate(prints[:k]):
            if min(map(bits, a[:n], b[:n])) <= S.RADIUS and sum(map(bits, a[n:], b[n:])) <= S.PAIR_BITS:
                x, y = sorted((find(ids[k]), find(ids[m])))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_copies(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    docs, groups = [], []
    for g in range(60):
        base = [rng.choice(words) for _ in range(rng.randint(60, 600))]
        for c in range(rng.randint(1, 4)):
            own = list(base)
            for _ in range(len(own) // 40 if c else 0):  # about one word in forty: shingles of five are alike to 0.8
                own[rng.randrange(len(own))] = rng.choice(words)
            groups.append((len(docs), g))
            docs.append((len(docs), " ".join(own)))
    first = {}
    for d, g in groups:
        first.setdefault(g, d)
    docs += [(1000, "a b c d"), (1001, "d c b a"), (1002, " ".join(sorted(docs[0][1].split())))]  # the same words, other texts
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.id: r.component for r in S.near_copies(df).collect()}
    assert got == brute_copies(dict(docs))
    assert got[1000] == 1000 and got[1001] == 1001 and got[1002] == 1002
    copies = [(d, g) for d, g in groups if d != first[g]]
    assert sum(got[d] == first[g] for d, g in copies) >= 0.9 * len(copies)
    assert all(got[d] in [x for x, y in groups if y == g] for d, g in groups)
    kept = S.stage(spark, df, "").collect()
    assert sorted(r.doc_id for r in kept) == sorted(set(got.values()))

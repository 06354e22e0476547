import random
from collections import Counter

import duckdb
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from whence.llm import chat as C

PATH = public_tokenizers.path("byte_bpe_50k.json")
nasty = st.text(alphabet=list("\\#</turn>: \nAé"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(nasty, nasty), max_size=4))
def test_escapes_are_reversible(turns):
    text = "".join(C.HEAD + C.escape_role(r) + C.MIDDLE + C.escape(t) + C.TAIL for r, t in turns)
    assert C.parse(text) == turns
    assert not any("</turn>" in C.escape(t).replace("\\</turn>", "") for _, t in turns)


def conversations(rng):
    first = "the first turn that everybody shares"
    rows = []
    for c in range(60):
        texts = [first if c % 3 else f"own {c}"] + [rng.choice(["a", "b </turn>", "### user: x", "\\", ""]) for _ in range(rng.randint(0, 5))]
        rows += [(c, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)]
    rows += [(100 + c, i, r, first) for c in range(30) for i, r in enumerate(("system", "user", "assistant"))]
    rows += [(200, i, "user", f"{i} " * 50) for i in range(300)]
    rows += [(300, None, None, None), (300, 1, "assistant", None), (300, 1, "assistant", None), (None, 0, "user", "no id"), (301, 0, "assistant", "é" * 100_000), (302, 5, "a: b", "x"), (302, 5, "a", "y")]
    rng.shuffle(rows)
    return rows


def by_conversation(rows):
    key = lambda r: tuple((x is not None, x) for x in r[1:])
    out = {}
    for r in sorted(rows, key=key):
        out.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    return out


def test_trees(spark):
    rows = conversations(random.Random(1))
    want = by_conversation(rows)
    t = Tokenizer.from_file(PATH)
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, path string").repartition(5)
    for sizes in ((C.BLOCK_CHARS, C.BLOCK_CONVERSATIONS), (200, 7)):
        trees = C.prefix_trees(df, PATH, *sizes)
        back = trees.transform(C.read_back).collect()
        assert {r.conv_id: list(zip(r.roles, r.texts)) for r in back} == want and len(back) == len(want)
        assert all(list(r.learnt) == [x for role, x in zip(r.roles, r.texts) if role == "assistant"] for r in back)
        for b in trees.collect():
            paths = Counter()
            for i, s in enumerate(b.segments):
                chain, p = [], s.parent
                while p >= 0:
                    chain.append(p)
                    p = b.segments[p].parent
                seen = [x for a in s.attends for x in range(a.first, a.last)]
                assert seen == [x for p in reversed(chain) for x in range(b.segments[p].first, b.segments[p].last)]
                assert s.position == len(seen) and s.parent < i
                assert t.decode(b.ids[s.first : s.last]) == b.text[s.start : s.end]
                if s.loss_first is not None:
                    assert t.decode(b.ids[s.loss_first : s.loss_last]) == b.text[s.loss_start : s.loss_end]
                paths[tuple(b.text[b.segments[p].start : b.segments[p].end] for p in [*reversed(chain), i])] += 1
            assert max(paths.values()) == 1  # a shared turn is written once


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.read_back(C.prefix_trees(df, PATH)).collect() == []


def test_sql_agrees(spark, tmp_path):
    rows = conversations(random.Random(2))
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    for d, files in ((str(tmp_path), "/*.parquet"), ("/root/testdata/sf0.001", "")):
        con = duckdb.connect()
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet{files}'")
        want = con.execute(C.OP9_SQL).fetchall()
        assert sorted(map(tuple, C.op9_chat(spark, d).collect()), key=str) == sorted(want, key=str)


def test_a_long_shared_path_is_merged(spark):
    import public_tokenizers
    from whence.llm import chat

    shared = "long " * 100
    rows = [(i, t, "user", shared if t == 0 else f"own {i}") for i in range(40) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1)
    blocks = chat.prefix_trees(df, public_tokenizers.path("byte_bpe_50k.json"), block_chars=400)
    assert blocks.select("text").toPandas()["text"].str.count(shared.strip()).sum() < 20
    assert {(r.conv_id, tuple(r.texts)) for r in chat.read_back(blocks).collect()} == {(i, (shared, f"own {i}")) for i in range(40)}


def test_long_turns_take_little_memory():
    import tracemalloc

    text = "a < b \\ c # " * 400_000
    whole = f"### user: {C.escape(text)}</turn>\n"
    tracemalloc.start()
    assert C.parse(whole) == [("user", text)]
    assert tracemalloc.get_traced_memory()[1] < 40 * len(whole)
    tracemalloc.stop()

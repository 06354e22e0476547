from collections import defaultdict

import corpus_pipeline as P
import numpy as np
import public_tokenizers
from test_decontaminate import brute as leaks
from test_simhash import brute_copies
from tokenizers import Tokenizer
from whence.llm import decontaminate, packing, quality, simhash, toxicity
from whence.llm.common import table, written

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark):
    """Each stage against what its operator, or a brute-force form of it, says
    about the same rows."""
    docs = table(spark, SF, "documents")
    columns = docs.columns
    kept = {r.doc_id: r.text for r in docs.collect()}

    model = quality.train(docs, table(spark, SF, "labels"))
    want = {r.doc.doc_id for r in quality.score(docs, model).collect() if r.posterior >= quality.KEEP}
    docs = written(P.STAGES[0][1](spark, docs, SF), "t1")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want and 0 < len(want) < len(kept)

    texts = {r.doc_id: r.text for r in docs.collect()}
    severity = toxicity.train(docs, table(spark, SF, "labels")).severity(texts.values())
    want = {d for d, p in zip(texts, severity["p1"]) if p < toxicity.REJECT}
    docs = written(P.STAGES[1][1](spark, docs, SF), "t2")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == want

    texts = {r.doc_id: r.text for r in docs.collect()}
    root = brute_copies(texts)
    docs = written(P.STAGES[2][1](spark, docs, SF), "t3")
    assert docs.columns == columns and sorted(r.doc_id for r in docs.collect()) == sorted(set(root.values()))

    texts = {r.doc_id: r.text for r in docs.collect()}
    items = [tuple(r) for r in table(spark, SF, "benchmark").collect()]
    held = {d for d, _ in leaks(list(texts.items()), items)}
    docs = written(P.STAGES[3][1](spark, docs, SF), "t4")
    assert docs.columns == columns and {r.doc_id for r in docs.collect()} == set(texts) - held

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = defaultdict(list)
    for r in P.STAGES[4][1](spark, docs, SF).collect():
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(texts) - held
    for d, rows in pieces.items():
        ids = [i for r in sorted(rows, key=lambda r: r.start) for i in r.ids]
        assert ids == [*t.encode(texts[d], add_special_tokens=False).ids, 1]

    whole = P.run(spark, SF).collect()
    assert {r.doc_id for r in whole} == set(pieces)


def test_odd_rows_in_every_stage(spark):
    long = "Calm words are here. " * 20_000
    rows = [(1, None, "en", "a"), (2, "", "en", None), (3, long, None, "a"), (3, long, None, "a"), (3, "another text with the id three", "en", "a"), (None, "no id", "en", "a"), (None, "no id", "en", "a"), (None, None, None, None), (9, "no id at all, but this one has", "en", "b")]
    docs = spark.createDataFrame([(*r, 5, "x", 1.0) for r in rows], "doc_id long, text string, lang string, source string, id int, doc string, mark double")
    for _, stage in P.STAGES[:4]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        if stage is simhash.stage:
            assert sorted(((r.doc_id, (r.text or "")[:7]) for r in out.collect()), key=str) == sorted([(1, ""), (3, "Calm wo"), (3, "another"), (None, "no id"), (9, "no id a")], key=str)
        elif stage is decontaminate.stage:
            assert out.count() == len(rows)
        else:
            out.collect()
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert packing.stage(spark, docs, SF).selectExpr("count(distinct doc_id)").first()[0] == 4
    assert np.isfinite(quality.score(docs, quality.train(docs, table(spark, SF, "labels"))).toPandas()["posterior"]).all()

import numpy as np
import pytest
from whence.llm import toxicity as X
from whence.llm.common import table


def test_fit_maximises_the_likelihood():
    rng = np.random.default_rng(1)
    true, cuts = np.array([1.5, -2.0, 0.7, 0.0, 3.0]), np.array([0.5, 1.5, 3.0])
    x = rng.random((4000, 5)) < 0.4
    latent = x @ true + np.log(1 / rng.random(4000) - 1)
    grades = (latent[:, None] > cuts).sum(axis=1)
    w, th = X.fit([dict.fromkeys(np.flatnonzero(r), 1.0) for r in x], grades, 5)
    assert np.abs(w - true).max() < 0.35 and np.abs(th - cuts).max() < 0.35 and (np.diff(th) > 0).all()
    p = 1 / (1 + np.exp(th - (x @ w)[:, None]))
    assert p.mean(axis=0) == pytest.approx([(grades > k).mean() for k in range(3)], abs=0.02)


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = X.train(docs, labels.where("doc_id % 2 = 0"))
    rest = docs.join(labels.where("doc_id % 2 = 1"), "doc_id").toPandas()
    out = model.severity(rest["text"])
    toxic = out["p1"] >= X.REJECT
    assert toxic[rest.toxic == 0].mean() < 0.005 and toxic[rest.toxic == 1].mean() > 0.9
    assert (out["p1"] >= out["p2"]).all() and (out["p2"] >= out["p3"]).all()
    marks = [sum(any(model.weights.get(k, 0) > 0.5 for k in X.keys(w)) for w in X.words(t)) / len(X.words(t)) for t in rest["text"][toxic]]
    assert np.corrcoef(out["severity"][toxic], np.minimum(marks, 0.05))[0, 1] > 0.5


def brute_choice(rows):
    """Every word and stem of the labelled texts, one document after the other."""
    toxic, other, n = {}, {}, [0, 0]
    for text, label in rows:
        n[label > 0] += 1
        own = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        for k in {x for w in own for x in [w, *(w[:m] + "*" for m in (4, 5, 6, 7) if len(w) >= m)]}:
            held = sum(w == k or (k[-1] == "*" and len(w) >= len(k) - 1 and w.startswith(k[:-1])) for w in own)
            if min(5.0, 100 * held / max(100, len(own))) >= 0.75:
                side = toxic if label else other
                side[k] = side.get(k, 0) + 1
    out = []
    o, t = n
    for k in toxic.keys() | other.keys():
        a, b = toxic.get(k, 0), other.get(k, 0)
        if a + b < 3:
            continue
        cells = [(a, (a + b) * t / (t + o)), (b, (a + b) * o / (t + o)), (t - a, (t + o - a - b) * t / (t + o)), (o - b, (t + o - a - b) * o / (t + o))]
        ratio = 2 * sum(x * np.log(x / e) for x, e in cells if x)
        s = np.sqrt(max(ratio, 0)) * np.sign(a / t - b / o)
        if abs(s) >= 3.5:
            out.append((k, s))
    return sorted(out, key=lambda x: (-abs(x[1]), x[0]))


def test_chosen_words_against_brute_force(spark):
    rng = np.random.default_rng(2)
    calm = ["gentle", "gently", "river", "walk", "Übung", "a1b", "it's", "sun"]
    foul = ["idiot", "idiots", "moron", "scum", "Übel"]
    rows = [(None, 0.0), ("", 1.0)]
    for i in range(300):
        label = float(i % 3 == 0)
        pool = calm + foul * (3 if label else 0) + (["moron"] if i % 10 == 0 else [])
        rows.append((" ".join(rng.choice(pool, rng.integers(1, 250))), label))
    got = X.choose_words(spark.createDataFrame(rows, "text string, label double").repartition(3))
    want = brute_choice(rows)
    assert [s for _, s in got] == pytest.approx([s for _, s in want]) and dict(got) == pytest.approx(dict(want)) and len(got) > 8


def test_severity_orders_labels_as_well_as_the_first_threshold(spark):
    """Held out: the area under the curve by expected severity and by the chance of any toxicity."""
    d = "/root/testdata/sf0.1"
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    model = X.train(docs, labels.where("doc_id % 3 = 0"))
    rest = docs.join(labels.where("doc_id % 3 = 1"), "doc_id").toPandas()
    out = model.severity(rest["text"])

    def area(score):
        rank = score.rank()
        n, t = len(rank), int(rest.toxic.sum())
        return (rank[rest.toxic == 1].sum() - t * (t + 1) / 2) / (t * (n - t))

    assert area(out["severity"]) >= area(out["p1"]) - 1e-9 > 0.95


def test_any_rows(spark):
    docs = [(1, None), (2, ""), (3, "calm words " * 50_000), (3, "calm"), (3, "calm"), (None, "calm idiot")]
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs], "doc_id long, text string, s double, doc string")
    labels = spark.createDataFrame([(1, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        out = X.score(df, X.train(df, some)).collect()
        assert len(out) == 6 and all(r.s.p1 < X.REJECT for r in out)
    none = X.score(df.limit(0), X.train(df.limit(0), labels))
    assert none.collect() == [] and none.select("doc.*").columns == df.columns


def test_every_document_once(spark):
    d = "/root/testdata/sf0.01"
    out = X.op2_toxicity(spark, d).toPandas()
    assert sorted(out["doc_id"]) == sorted(table(spark, d, "documents").toPandas()["doc_id"])
    seen = out.merge(table(spark, d, "labels").toPandas(), on="doc_id")
    bad = seen[seen.toxic_y == 1]
    assert seen[seen.toxic_y == 0].toxic_x.mean() < 0.01 and bad.toxic_x.mean() > 0.8

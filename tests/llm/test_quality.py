import numpy as np
import pytest
from pyspark.sql import functions as F
from whence.llm import quality as Q
from whence.llm.common import table


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1"
    rows = Q.labelled(table(spark, d, "documents"), table(spark, d, "labels"), "quality").toPandas()
    x, y = np.array([Q.features(t) for t in rows["text"]]), rows["label"].to_numpy()
    half = np.arange(len(y)) % 2 == 0
    good = Q.fit(x[half], y[half]).good(x[~half]) >= 0.5
    assert good[y[~half] == 1].mean() > 0.995 and good[y[~half] == 0].mean() < 0.03


def kappa(groups):
    n = np.array([g[0] for g in groups], float)
    r, p = np.array([g[1] for g in groups]), np.array([g[2] for g in groups])
    free = n.sum() - (n**2).sum() / n.sum() - (len(n) - 1)
    rho = ((n * (r - p) ** 2 / (p * (1 - p))).sum() - (len(n) - 1)) / free if free > 0 else 0
    return 1 / min(max(rho, 1e-5), 0.99) - 1


def rates(worth):
    """By path and host, in plain Python: (prior, host kappa, kappa, host rates, path rates)."""
    inside = lambda x: min(max(x, Q.EDGE), 1 - Q.EDGE)
    by_path, by_host = {}, {}
    for (h, p), w in worth:
        by_path.setdefault((h, p), []).append(w)
        by_host.setdefault(h, []).append(w)
    prior = inside(sum(w for _, w in worth) / len(worth))
    kh = kappa([(len(x), sum(x) / len(x), prior) for x in by_host.values()])
    host = {h: inside((kh * prior + sum(x)) / (kh + len(x))) for h, x in by_host.items()}
    kp = kappa([(len(x), sum(x) / len(x), host[h]) for (h, _), x in by_path.items()])
    return prior, kh, kp, host, {k: inside((kp * host[k[0]] + sum(x)) / (kp + len(x))) for k, x in by_path.items()}, by_path, by_host


def odds(good, base, site):
    o = good / (1 - good) * (1 - base) / base * site / (1 - site)
    return o / (1 + o)


def brute(rows, rounds=Q.ROUNDS):
    """Posterior of each (site, good), and what the sites are."""
    found = rates(rows)
    base = found[0]
    told = dict.fromkeys(found[4], base)
    worth = rows
    for _ in range(rounds):
        told = found[4]
        worth = [(k, odds(g, base, told[k])) for k, g in rows]
        found = rates(worth)
        if max(abs(found[4][k] - told[k]) for k in told) < Q.SETTLED:
            break
    prior, kh, kp, _, _, by_path, by_host = found
    out = []
    for (k, g), (_, w) in zip(rows, worth):
        host = min(max((kh * prior + sum(by_host[k[0]]) - w) / (kh + len(by_host[k[0]]) - 1), Q.EDGE), 1 - Q.EDGE)
        rate = min(max((kp * host + sum(by_path[k]) - w) / (kp + len(by_path[k]) - 1), Q.EDGE), 1 - Q.EDGE)
        out.append(odds(g, base, rate))
    return out, found


def test_sites_by_hand(spark):
    rows = [("a", "x", 0.9), ("a", "x", 0.8), ("a", "y", 0.1), ("b", "", 0.9), ("c", "z", 0.2), ("c", "z", 0.1), ("c", "z", 0.15)]
    df = spark.createDataFrame(rows, "host string, path string, good double")
    for rounds in (0, 1, 4):
        got = {(r.host, r.path): r for r in Q.sites(df, rounds).collect()}
        want, (prior, kh, kp, host, path, *_) = brute([((h, p), g) for h, p, g in rows], rounds)
        for k, r in got.items():
            assert (r.prior, r.host_kappa, r.kappa, r.host_rate, r.path_rate) == pytest.approx((prior, kh, kp, host[k[0]], path[k]))
        out = Q.judged(df, Q.sites(df, rounds)).collect()
        assert sorted(r.posterior for r in out) == pytest.approx(sorted(want))


def test_own_evidence_says_nothing_of_the_site(spark):
    """A lone document's site is the others' sites: its own evidence moves neither level."""
    rest = [(f"h{i}", "p", 0.9 if i % 2 else 0.2) for i in range(20) for _ in range(5)]
    seen = []
    for own in (0.01, 0.5, 0.99):
        df = spark.createDataFrame([*rest, ("lone", "q", own)], "host string, path string, good double")
        (r,) = Q.judged(df, Q.sites(df, 0)).where("host = 'lone'").collect()
        base = (sum(g for *_, g in rest) + own) / 101
        site = r.posterior / (1 - r.posterior) * (1 - own) / own * base / (1 - base)
        seen.append(site / (1 + site) - base)
    assert max(seen) - min(seen) < 1e-9


def test_sites_decide_where_texts_are_weak(spark):
    """Held-out verdicts and loss with sites and without, texts telling little and sites much."""
    rng = np.random.default_rng(5)
    rows, truth = [], []
    for h in range(60):
        for p in range(2):
            rate = rng.choice([0.08, 0.92])
            for _ in range(rng.integers(3, 60)):
                y = rng.random() < rate
                z = rng.normal(0.5 if y else -0.5)  # the logit of good is 2 * 0.5 * z: calibrated at even odds
                rows.append((f"h{h}", f"p{p}", float(1 / (1 + np.exp(-z))), len(truth)))
                truth.append(y)
    truth = np.array(truth)
    df = spark.createDataFrame(rows, "host string, path string, good double, id long")
    out = {r.id: r.posterior for r in Q.judged(df, Q.sites(df)).collect()}
    alone, beside = np.array([r[2] for r in rows]), np.array([out[i] for i in range(len(rows))])
    loss = lambda p: -np.where(truth, np.log(p), np.log(1 - p)).mean()
    right = lambda p: ((p >= Q.KEEP) == truth).mean()
    assert right(beside) > right(alone) + 0.08 and loss(beside) < 0.8 * loss(alone)
    assert ((alone >= Q.KEEP) != (beside >= Q.KEEP)).mean() > 0.15
    once = {r.id: r.posterior for r in Q.judged(df, Q.sites(df, 0)).collect()}
    assert loss(np.array([once[i] for i in range(len(rows))])) > loss(beside)  # the rounds help, too


def test_tempered_where_the_fit_is_too_sure(spark):
    rng = np.random.default_rng(3)
    x = np.c_[np.ones(60), rng.normal(size=(60, len(Q.NAMES) - 1))]
    y = (x[:, 1] + rng.normal(size=60) > 0).astype(float)
    new = np.c_[np.ones(4000), rng.normal(size=(4000, len(Q.NAMES) - 1))]
    said = (new[:, 1] + rng.normal(size=4000) > 0).astype(float)
    loss = lambda m: -np.log(np.where(said == 1, m.good(new), 1 - m.good(new))).mean()
    assert loss(Q.tempered(x, y)) < loss(Q.fit(x, y))


def test_sparse_sites_are_shrunk(spark):
    rows = [(f"h{i}", "p", 0.9) for i in range(50) for _ in range(20)] + [(f"bad{i}", "p", 0.1) for i in range(50) for _ in range(20)] + [("new", "p", 0.1)]
    got = {r.host: r for r in Q.sites(spark.createDataFrame(rows, "host string, path string, good double")).collect()}
    assert got["bad1"].path_rate < got["new"].path_rate < got["new"].prior


def test_any_rows(spark):
    docs = [(1, None, None, None), (2, "", "en", ""), (3, "a b " * 50_000, "en", "host/path/x"), (3, "a b", "en", "host"), (3, "a b", "en", "host"), (None, "Some words.", "fr", "host")]
    df = spark.createDataFrame([(*d, 1, 0.5) for d in docs], "doc_id long, text string, lang string, source string, host int, good double")
    labels = spark.createDataFrame([(1, 0, 0), (3, None, 1), (None, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")
    out = Q.score(df, Q.train(df, labels)).collect()
    assert len(out) == 6 and all(0 < r.posterior < 1 for r in out)
    none = Q.score(df.limit(0), Q.train(df, labels.limit(0)))
    assert none.collect() == [] and none.select("doc.*").columns == df.columns


def test_every_document_once(spark):
    d = "/root/testdata/sf0.01"
    out = Q.op1_quality(spark, d).toPandas()
    assert sorted(out["doc_id"]) == sorted(table(spark, d, "documents").toPandas()["doc_id"])
    seen = out.merge(table(spark, d, "labels").toPandas(), on="doc_id")
    assert seen[seen.quality == 1].keep.mean() > 0.99 and seen[seen.quality == 0].keep.mean() < 0.05


def test_posterior_by_hand(spark):
    """Every document's posterior from its own evidence and the rate of the others at its site."""
    d = "/root/testdata/sf0.001"
    docs = table(spark, d, "documents")
    model = Q.train(docs, table(spark, d, "labels"))
    site = dict(zip(("host", "path"), Q._site(F.col("doc.source"), F.col("doc.lang"))))
    out = Q.score(docs, model).withColumns(site).select("doc.doc_id", "doc.text", "host", "path", "good", "posterior").collect()
    for r in out:
        assert r.good == pytest.approx(min(max(float(model.good(np.array([Q.features(r.text)]))[0]), 1e-9), 1 - 1e-9), abs=1e-8)
    want, _ = brute([((r.host, r.path), r.good) for r in out])
    assert [r.posterior for r in out] == pytest.approx(want, abs=1e-6)

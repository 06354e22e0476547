"""Severity of toxicity by ordinal regression.

A cumulative-link model: P(grade < k) = sigmoid(threshold_k - w.x), with one
weight for each feature whatever the threshold.  Features are words and their
first four to seven letters, as stems; x says how often a text holds the chosen
ones in a hundred words.  They are chosen by grouped counts over labelled
documents: those that differ most between toxic and other documents.

Labels say toxic or not.  The grade of a labelled toxic document is 1, 2 or 3
by how many in a hundred of its words fit a feature of toxic documents, chosen
from the other half of the labelled ones: no document grades itself.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import written
from .quality import labelled

GRADES = 3
#: About this many labelled documents at most are fitted.
FIT_ROWS = 20_000
#: Features of the model at most, the documents that must hold one, the least root
#: of the likelihood ratio against an equal share in both classes, and from what x
#: on a document counts as holding it.
WORDS, LEAST, SIGMAS, HOLDS = 2000, 3, 3.5, 0.75
#: x is at most this.
MOST = 5.0
#: Marked words in a hundred from which on the grade is 2 and 3.
STEPS = (3.0, 5.0)
RIDGE = 0.02
#: A document goes if its grade is 1 or more with at least this probability.
REJECT = 0.5
STEMS = (4, 5, 6, 7)
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    """The words in lower case; none of a null text."""
    return _WORD.findall((text or "").lower())


def keys(word: str) -> list[str]:
    """A word's features: itself, and stems, which end in a star."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


def features(own: list[str], known=None) -> dict[str, int]:
    """How many of the words fit each feature (of those known)."""
    found: dict[str, int] = {}
    for word, n in Counter(own).items():
        for k in keys(word):
            if known is None or k in known:
                found[k] = found.get(k, 0) + n
    return found


def share(found: dict[str, int], n: int) -> dict[str, float]:
    """x of each feature: its words in a hundred; a shorter text counts as a hundred."""
    return {k: min(MOST, 100 * c / max(100, n)) for k, c in found.items()}


@dataclass
class Model:
    weights: dict[str, float]
    thresholds: np.ndarray  # ascending, one below each grade

    def severity(self, texts) -> pd.DataFrame:
        """P(grade >= k) for k = 1, 2, 3 and their sum, the expected grade."""
        starts = {k.rstrip("*")[:4] for k in self.weights}
        s = []
        for text in texts:
            own = words(text)
            found = features([w for w in own if w[:4] in starts], self.weights)
            s.append(sum(self.weights[k] * x for k, x in share(found, len(own)).items()))
        s = np.array(s, float)
        above = 1 / (1 + np.exp(np.clip(self.thresholds - s[:, None], -500, 500)))
        out = pd.DataFrame(above, columns=[f"p{k + 1}" for k in range(GRADES)])
        return out.assign(severity=above.sum(axis=1))


def choose_words(sample: DataFrame) -> list[tuple[str, float]]:
    """(feature, signed root of its likelihood ratio), the largest first."""

    def run(batches):
        for pdf in (b[at : at + 500] for b in batches for at in range(0, len(b), 500)):  # bounds the words held
            toxic, other = Counter(), Counter()
            for text, label in zip(pdf["text"], pdf["label"], strict=True):
                own = words(text)
                (toxic if label else other).update(k for k, x in share(features(own), len(own)).items() if x >= HOLDS)
            all_words = list(toxic | other)
            yield pd.DataFrame({"word": all_words, "toxic": [toxic[w] for w in all_words], "other": [other[w] for w in all_words]})

    n = {r["label"] > 0: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    t, o = n.get(True, 0), n.get(False, 0)
    if not t or not o:
        return []
    counts = sample.mapInPandas(run, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    a, b = F.col("toxic").cast("double"), F.col("other").cast("double")

    def part(seen, expected):
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    t_share = t / (t + o)
    ratio = part(a, (a + b) * t_share) + part(b, (a + b) * (1 - t_share)) + part(t - a, (t + o - a - b) * t_share) + part(o - b, (t + o - a - b) * (1 - t_share))
    sigmas = F.signum(a / t - b / o) * F.sqrt(F.greatest(2 * ratio, F.lit(0.0)))
    found = counts.where(a + b >= LEAST).select("word", sigmas.alias("sigmas")).where(F.abs("sigmas") >= SIGMAS)
    return [tuple(r) for r in found.orderBy(F.abs("sigmas").desc(), "word").limit(WORDS).collect()]


def grade(label: float, marked: float) -> int:
    return 0 if not label else 1 + sum(marked >= s for s in STEPS)


def fit(rows: list[dict[int, float]], grades: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) that maximise the ridge likelihood.  rows: x by
    feature number.  Gradient steps with momentum; the thresholds are the first
    and the logarithms of the gaps that follow."""
    n = len(rows)
    w, cut = np.zeros(n_words), np.array([1.0, 0.0, 0.0])
    if n == 0:
        return w, np.cumsum(np.r_[20.0, np.exp(cut[1:])])
    doc = np.repeat(np.arange(n), [len(r) for r in rows])
    word = np.array([i for r in rows for i in r], np.int64)
    x = np.array([v for r in rows for v in r.values()], float)

    def at(w, cut):
        th = np.cumsum(np.r_[cut[0], np.exp(cut[1:])])
        s = np.bincount(doc, w[word] * x, n)
        bounds = np.concatenate([[-np.inf], th, [np.inf]])
        with np.errstate(over="ignore"):
            up, low = (1 / (1 + np.exp(-(bounds[g] - s))) for g in (grades + 1, grades))
        p = np.maximum(up - low, 1e-12)
        du, dl = up * (1 - up) / p, low * (1 - low) / p
        gs = -(du - dl)  # of the log-likelihood, by the score
        gt = np.array([du[grades == k].sum() - dl[grades == k + 1].sum() for k in range(GRADES)])
        gc = np.array([gt.sum(), *(gt[k:].sum() * np.exp(cut[k]) for k in range(1, GRADES))])
        value = np.log(p).sum() - RIDGE / 2 * (w @ w) - 0.005 * (cut @ cut)
        return value, np.bincount(word, gs[doc] * x, n_words) - RIDGE * w, gc - 0.01 * cut

    # Adam, whose steps don't depend on how often a word occurs.
    m = np.zeros(n_words + GRADES)
    v = np.zeros(n_words + GRADES)
    for i in range(1, 601):
        _, gw, gc = at(w, cut)
        g = np.r_[gw, gc]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.05 * min(1, 3 - i / 200) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-8)
        w, cut = w + step[:n_words], cut + step[n_words:]
    return w, np.cumsum(np.r_[cut[0], np.exp(cut[1:])])


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    """The model of a bounded sample of labelled documents, equal texts counted
    once.  Without toxic or without other ones it finds nothing toxic."""
    sample = written(labelled(docs, labels, "toxic", most).groupBy(F.xxhash64("text").alias("h")).agg(F.first("text").alias("text"), F.max("label").alias("label")).withColumn("half", F.pmod("h", F.lit(2))).drop("h"), "sample")
    chosen = choose_words(sample)
    number = {w: i for i, (w, _) in enumerate(chosen)}
    other = [{w for w, s in choose_words(sample.where(F.col("half") != h)) if s > 0} for h in (0, 1)]

    def run(batches):
        for pdf in batches:
            numbers, values, grades = [], [], []
            for text, label, half in zip(pdf["text"], pdf["label"], pdf["half"], strict=True):
                own = words(text)
                x = sorted((number[k], v) for k, v in share(features(own, number), len(own)).items())
                marked = sum(any(k in other[half] for k in keys(w)) for w in own)
                numbers.append([i for i, _ in x])
                values.append([v for _, v in x])
                grades.append(grade(label, 100 * marked / max(100, len(own))))
            yield pd.DataFrame({"i": numbers, "x": values, "grade": grades})

    rows = sample.mapInPandas(run, "i array<int>, x array<double>, grade int").toPandas()
    fitted = sorted((tuple(i), tuple(x), g) for i, x, g in zip(rows["i"], rows["x"], rows["grade"], strict=True))
    weights, thresholds = fit([dict(zip(i, x, strict=True)) for i, x, _ in fitted], np.array([g for *_, g in fitted], int), len(chosen))
    return Model({w: float(weights[i]) for w, i in number.items()}, thresholds)


def severity(model: Model):
    """A column function: text -> struct of p1, p2, p3 and severity."""

    @F.pandas_udf("p1 double, p2 double, p3 double, severity double")
    def score(texts: pd.Series) -> pd.DataFrame:
        return model.severity(texts)

    return score


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc (all columns of docs) and s: p1, p2, p3, severity.  One row per row,
    whatever its nulls or repeats; a null or blank text has no words."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("text"))
    return rows.select("doc", severity(model)("text").alias("s"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, as they came."""
    from .common import table

    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("s.p1") < REJECT).select("doc.*")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's chance of each grade or more, expected severity and verdict."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text"), train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc.doc_id", "s.*", (F.col("s.p1") >= REJECT).alias("toxic"))

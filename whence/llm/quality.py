"""Quality of documents by hierarchical empirical Bayes.

A logistic model of each document's own text gives the evidence, tempered to be no
more certain than it is right on rows that it wasn't fitted on.  Sites have two
levels, the host and a path on it.  Grouped sums give each level's rate; how far
rates differ beyond chance (method of moments) gives how strongly a level is
shrunk: a host to the global rate, a path to its host.  Evidence alone says too
little of a site where texts say little, so sums are taken again of what the
documents are worth given their site (expectation maximisation).  The site's
rate, without the document's own part, then replaces the global prior in each
document's odds.

Documents carry no url: `source` up to its first slash is the host; what
follows, or the language where nothing follows, is the path.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import written

#: About this many labelled documents at most are fitted, chosen by a hash of their id.
FIT_ROWS = 20_000
#: A document stays if its posterior of being good is at least this.
KEEP = 0.5
#: Weight of a unit of squared coefficient in the fit.
RIDGE = 1.0
#: Rounds, at most, in which sites' rates and documents' posteriors are told to each
#: other, and by how much a path's rate may still change for the last one.
ROUNDS, SETTLED = 10, 1e-4
#: Sites are broadcast up to this many rows of about 100 bytes, and joined by site beyond.
BROADCAST_SITES = 200_000
#: Posteriors of sites stay away from 0 and 1 by this.
EDGE = 1e-4

_BYTES = np.zeros((256, 8), bool)
for _kind, _chars in enumerate((b"#$%&*|<>{}[]@^~=+_\\/", b"!?", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:", b" \t\r\n\x0b\x0c", b"abcdefghijklmnopqrstuvwxyz", b"\n")):
    _BYTES[list(_chars), _kind] = True
_CLASS = np.where(_BYTES[:, :7].any(axis=1), _BYTES[:, :7].argmax(axis=1), 7)
_LINES = re.compile(rb"[^\n]*[^\s][^\n]*")
NAMES = ("bias", "words", "symbols", "shouts", "upper", "digits", "stops", "space", "word_length", "distinct", "top_word", "repeated_lines", "repeated_words")


def features(text: str | None) -> np.ndarray:
    """The numbers of NAMES; of a null or blank text only the bias."""
    data = (text or "").encode("utf-8", "replace")
    words = data.split()
    out = np.zeros(len(NAMES))
    out[0] = 1
    n = len(words)
    if n == 0:
        return out
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8).astype(float)
    size = len(data)
    out[1] = np.log1p(n)
    out[2], out[3], out[5], out[6], out[7] = counts[[0, 1, 3, 4, 5]] / size
    out[4] = counts[2] / max(1.0, counts[2] + counts[6])
    out[8] = (size - counts[5]) / n
    often = Counter(words)
    out[9] = len(often) / n**0.8
    out[10] = (max(often.values()) - 1) / (n + 10)
    lines = _LINES.findall(data)
    out[11] = 1 - len(set(lines)) / len(lines)
    out[12] = sum(map(eq, words, words[1:])) / (n + 10)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def logits(self, rows: np.ndarray) -> np.ndarray:
        z = np.clip((rows - self.mean) / self.scale, -8, 8)
        z[:, 0] = 1
        return z @ self.weights

    def good(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(rows), -30, 30)))


def fit(rows: np.ndarray, labels: np.ndarray) -> Model:
    """Ridge logistic regression by Newton's method.  Without rows, or with one
    class only, the weights are zero but for the bias."""
    mean, scale = np.zeros(len(NAMES)), np.ones(len(NAMES))
    weights = np.zeros(len(NAMES))
    if len(rows) == 0:
        return Model(mean, scale, weights)
    mean[1:], scale[1:] = rows[:, 1:].mean(axis=0), rows[:, 1:].std(axis=0) + 1e-9
    rate = (labels.sum() + 1) / (len(labels) + 2)
    weights[0] = np.log(rate / (1 - rate))
    if 0 < labels.sum() < len(labels):
        z = np.clip((rows - mean) / scale, -8, 8)
        z[:, 0] = 1
        penalty = RIDGE * np.eye(len(NAMES))
        penalty[0, 0] = 1e-6
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ weights, -30, 30)))
            step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (labels - p) - penalty @ weights)
            weights = weights + step
            if np.abs(step).max() < 1e-8:
                break
    return Model(mean, scale, weights)


def tempered(rows: np.ndarray, labels: np.ndarray) -> Model:
    """fit(), its logits divided by a number from one on: that by which the logits of
    rows that a half's model wasn't fitted on would have to be, to be likeliest."""
    model = fit(rows, labels)
    half = np.arange(len(rows)) % 2 == 0
    if not all(0 < labels[h].sum() < h.sum() for h in (half, ~half)):
        return model
    held = np.concatenate([fit(rows[h], labels[h]).logits(rows[~h]) for h in (half, ~half)])
    said = np.concatenate([labels[~half], labels[half]])
    low, high = 0.02, 1.0  # of the factor on the logits; the loss is convex in it
    for _ in range(50):
        mid = (low + high) / 2
        slope = (held * (1 / (1 + np.exp(-np.clip(held * mid, -30, 30))) - said)).sum()
        low, high = (low, mid) if slope > 0 else (mid, high)
    return Model(model.mean, model.scale, model.weights * high)


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int = FIT_ROWS) -> DataFrame:
    """(text, label double) of a bounded sample of labelled documents.

    Labels whose id or value is null don't count, of a repeated id the larger
    one does.  The share to take follows from their number; which ones, from a
    hash of the id.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("double").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(label)), F.lit(1_000_000)) < int(1_000_000 * most / n))
    ids = F.broadcast(known) if min(n, most) <= 100_000 else known
    return docs.select("doc_id", "text").join(ids, "doc_id").select("text", "label")


def train(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> Model:
    def run(batches):
        for pdf in batches:
            x = np.array([features(t) for t in pdf["text"]]).reshape(len(pdf), len(NAMES))
            yield pd.DataFrame({"x": list(x), "label": pdf["label"]})

    rows = labelled(docs, labels, "quality", most).mapInPandas(run, "x array<double>, label double").toPandas()
    return tempered(np.array(rows["x"].tolist()).reshape(len(rows), len(NAMES)), rows["label"].to_numpy())


def evidence(model: Model):
    """A column function: text -> the document's own probability of being good."""

    @F.pandas_udf(DoubleType())
    def good(texts: pd.Series) -> pd.Series:
        rows = np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return pd.Series(model.good(rows))

    return good


def _site(source, lang):
    """(host, path), never null."""
    source, lang = F.coalesce(source.cast("string"), F.lit("")), F.coalesce(lang.cast("string"), F.lit(""))
    rest = F.regexp_extract(source, r"(?s)^[^/]*/(.+)$", 1)
    return F.substring_index(source, "/", 1), F.when(rest == "", lang).otherwise(rest)


def _spread(rows: DataFrame, rate: str, prior: str) -> DataFrame:
    """One row: how many observations the prior counts for.  rows: n, rate and
    prior of each group; from the moments of a beta-binomial model."""
    v = F.col(prior) * (1 - F.col(prior))
    sums = rows.agg(F.sum(F.col("n") * (F.col(rate) - F.col(prior)) ** 2 / v).alias("s"), F.count("*").alias("g"), F.sum("n").alias("t"), F.sum(F.col("n").cast("double") ** 2).alias("q"))
    free = F.col("t") - F.col("q") / F.col("t") - (F.col("g") - 1)
    rho = F.when(free > 0, (F.col("s") - (F.col("g") - 1)) / free).otherwise(0.0)
    rho = F.least(F.greatest(F.coalesce(rho, F.lit(0.0)), F.lit(1e-5)), F.lit(0.99))
    return sums.select((1 / rho - 1).alias("kappa"))


def _inside(c):
    return F.least(F.greatest(c, F.lit(EDGE)), F.lit(1 - EDGE))


def _rates(paths: DataFrame) -> DataFrame:
    """paths(host, path, n, s): with host_n, host_s, host_kappa, host_rate, kappa, path_rate and prior.

    The three single rows are joined, each of a few numbers."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("s").alias("host_s"))
    overall = hosts.agg(_inside(F.sum("host_s") / F.sum("host_n")).alias("prior"))
    hosts = hosts.crossJoin(F.broadcast(overall)).withColumns({"n": F.col("host_n"), "rate": F.col("host_s") / F.col("host_n")})
    hosts = hosts.crossJoin(F.broadcast(_spread(hosts, "rate", "prior").withColumnRenamed("kappa", "host_kappa")))
    rate = _inside((F.col("host_kappa") * F.col("prior") + F.col("host_s")) / (F.col("host_kappa") + F.col("host_n")))
    hosts = hosts.select("host", "prior", "host_n", "host_s", "host_kappa", rate.alias("host_rate"))
    paths = paths.join(hosts, "host").withColumn("rate", F.col("s") / F.col("n"))
    paths = paths.crossJoin(F.broadcast(_spread(paths, "rate", "host_rate")))
    path_rate = _inside((F.col("kappa") * F.col("host_rate") + F.col("s")) / (F.col("kappa") + F.col("n")))
    return paths.withColumn("path_rate", path_rate).drop("rate")


def _beside(found: DataFrame) -> DataFrame:
    return F.broadcast(found) if found.count() <= BROADCAST_SITES else found


def sites(scored: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """scored(host, path, good) -> host, path, n, s (their sum of what documents are
    worth), told (the rate that these were worth it by), host_n, host_s,
    host_kappa and kappa (the observations that the rates which a host and a path
    are shrunk to count for), host_rate, path_rate, base (the global prior of the
    evidence) and prior (that of the last round).

    Sums combine before the shuffle, so a host with most rows costs no more than
    another.  A round reads one table of numbers and writes one of sites.
    """
    scored = written(scored.select("host", "path", "good"), "evidence")
    paths = scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("good").alias("s"))
    found = _rates(paths)
    found = written(found.withColumns({"base": F.col("prior"), "told": F.col("prior")}), "sites")
    for _ in range(rounds):
        rates = _beside(found.select("host", "path", F.col("path_rate").alias("told"), "base"))
        worth = posterior(F.col("good"), F.col("base"), F.col("told"))
        paths = scored.join(rates, ["host", "path"]).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(worth).alias("s"), F.first("told").alias("told"), F.first("base").alias("base"))
        found = written(_rates(paths), "sites")
        moved = found.agg(F.max(F.abs(F.col("path_rate") - F.col("told")))).first()[0]
        if moved is None or moved < SETTLED:
            break
    return found


def others_rate(worth):
    """The path's rate without the document's own part, which would count twice, in the
    path's sums and in its host's; a host's only document has the global prior."""
    host = _inside((F.col("host_kappa") * F.col("prior") + F.col("host_s") - worth) / (F.col("host_kappa") + F.col("host_n") - 1))
    return _inside((F.col("kappa") * host + F.col("s") - worth) / (F.col("kappa") + F.col("n") - 1))


def judged(scored: DataFrame, found: DataFrame) -> DataFrame:
    """scored(host, path, good, ...) with host_rate, path_rate and posterior, found being sites()."""
    rows = scored.join(_beside(found), ["host", "path"], "left")
    rows = rows.withColumn("_worth", posterior(F.col("good"), F.col("base"), F.col("told")))
    return rows.select(*scored.columns, "host_rate", "path_rate", posterior(F.col("good"), F.col("base"), others_rate(F.col("_worth"))).alias("posterior"))


def posterior(good, prior, site):
    """The document's odds with its site's rate in place of the global prior."""
    odds = good / (1 - good) * (1 - prior) / prior * site / (1 - site)
    return odds / (1 + odds)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc (all columns of docs), good, host_rate, path_rate, posterior.

    One row per row of docs, whatever its nulls or repeats; null or blank texts
    are scored by the bias and their site alone.  The model reads each text
    twice, once for the sites' sums, so that no text is shuffled where the
    sites are few enough to broadcast; more are joined by site, where AQE splits
    a site that has most rows.
    """
    good = evidence(model)

    def scored(doc):
        rows = docs.select(doc, *(c.alias(n) for c, n in zip(_site(F.col("source"), F.col("lang")), ("host", "path"), strict=True)), "text")
        return rows.withColumn("good", F.least(F.greatest(good("text"), F.lit(1e-9)), F.lit(1 - 1e-9))).drop("text")

    found = sites(scored(F.lit(1).alias("doc")))
    rows = judged(scored(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")), found)
    return rows.select("doc", "good", "host_rate", "path_rate", "posterior")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the posterior keeps, as they came."""
    from .common import table

    model = train(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).where(F.col("posterior") >= KEEP).select("doc.*")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's evidence, site posteriors, posterior and verdict."""
    from .common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs.select("doc_id", "text", "lang", "source"), train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc.doc_id", "good", "host_rate", "path_rate", "posterior", (F.col("posterior") >= KEEP).alias("keep"))

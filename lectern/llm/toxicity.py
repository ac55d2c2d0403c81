"""Toxicity by cumulative-link ordinal regression over sparse text features.

Grades are 0 (clean), 1 (toxic) and 2 (severe). Labels that only say toxic or not are graded by dose: of the toxic
texts of the sample, those that hold more features of toxic texts than the median are severe.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all thresholds and theta_0 < theta_1. x marks which
of the vocabulary's words and word beginnings a text holds. The model is fitted in numpy on at most `sample` labelled
rows: toxic ones first, up to half of them, then clean ones, by the smallest hashes of their ids; the thresholds are
shifted back to the share of toxic rows in all labels. Rows with the same features (copies) count once. The vocabulary
is the features whose counts differ between toxic and clean texts, either way, by a likelihood-ratio statistic of at
least `tell` (chi-squared with one degree of freedom: 15 is one in ten thousand by chance, at any number of rows), at
most `features` of them. Scoring reads every word of every text. The model that goes to the tasks is at most
`features` words long.

Cases: a null or empty text has no words, gets the intercept alone and is never rejected. Very long texts count like
others, by their distinct words. Labels without a document and null labels are ignored; with no labelled row of both
kinds all weights are 0 and nothing is rejected. Null and repeated doc_ids are scored like other rows; a label holds
for each row of its doc_id. Other columns pass through; the output columns replace namesakes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import bounded, materialize

SAMPLE = 6000
FEATURES = 20_000
TELL = 15.0
REJECT = 0.5
_WORD = re.compile(r"\w+")


def features_of(text: str | None) -> set[str]:
    """The distinct words of a text, and their first four and five characters, which stems share, as ^abcd."""
    words = set(_WORD.findall((text or "").lower()))
    return words | {f"^{w[:n]}" for n in (4, 5) for w in words if len(w) > n}


@dataclass
class OrdinalModel:
    weights: dict[str, float]
    thresholds: tuple[float, float]

    def probabilities(self, score: np.ndarray) -> np.ndarray:
        """P(grade > 0) and P(grade > 1) of each score."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -40, 40)))

    def score(self, words: set[str]) -> float:
        found = [self.weights[w] for w in words if w in self.weights]
        return float(sum(sorted(found)))  # sorted: the sum must not depend on the set's order


def grade(dose: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """0, 1 or 2 for each text, given by how many features of toxic texts it holds."""
    middle = np.median(dose[toxic & (dose > 0)]) if (toxic & (dose > 0)).any() else 0.0
    return toxic.astype(int) + (toxic & (dose > middle)).astype(int)


def telling(sampled: DataFrame, tell: float = TELL, most: int = FEATURES) -> DataFrame:
    """The features of sampled (toxic, features) that toxic and clean rows hold unlike often, by a likelihood-ratio statistic of at least `tell`."""
    n1, n = sampled.agg(F.sum("toxic"), F.count("*")).first()
    n1, n = float(n1 or 0), float(n or 0)
    held = sampled.select("toxic", F.explode("features").alias("feature")).groupBy("feature").agg(F.sum("toxic").alias("a"), F.count("*").alias("k"))
    a, k = F.col("a"), F.col("k")
    term = lambda seen, expected: F.when((seen > 0) & (expected > 0), seen * F.log(seen / expected)).otherwise(0.0)
    with_it = term(a, k * n1 / max(1.0, n)) + term(k - a, k * (n - n1) / max(1.0, n))
    without = term(n1 - a, (n - k) * n1 / max(1.0, n)) + term(n - n1 - k + a, (n - k) * (n - n1) / max(1.0, n))
    g = F.round(2 * (with_it + without), 6)
    return held.where(g >= tell).orderBy(g.desc(), "feature").limit(most).select("feature")


def likelihood(p: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, prior: np.ndarray, l2: float) -> tuple[float, np.ndarray]:
    """The log-likelihood of grades y less l2 / 2 |w - prior|^2, and its gradient. p is w, theta_0 and log(theta_1 - theta_0); text rows[i] holds feature cols[i]."""
    d, n = len(prior), len(y)
    sigmoid = lambda x: 1 / (1 + np.exp(np.clip(-x, -40, 40)))
    s = np.bincount(rows, p[cols], n)
    c0, c1 = sigmoid(s - p[d]), sigmoid(s - p[d] - np.exp(p[d + 1]))
    mass = np.maximum(np.where(y == 0, 1 - c0, np.where(y == 1, c0 - c1, c1)), 1e-9)
    g0, g1 = c0 * (1 - c0), c1 * (1 - c1)
    by0 = np.where(y == 0, -g0, np.where(y == 1, g0, 0)) / mass  # of the log-likelihood by s - theta_0
    by1 = np.where(y == 1, -g1, np.where(y == 2, g1, 0)) / mass
    gradient = np.concatenate([np.bincount(cols, (by0 + by1)[rows], d) - l2 * (p[:d] - prior), [-(by0 + by1).sum(), -(by1.sum()) * np.exp(p[d + 1])]])
    return float(np.log(mass).sum() - l2 / 2 * ((p[:d] - prior) ** 2).sum()), gradient


def fit(texts: list[set[str]], toxic: np.ndarray, l2: float = 4.0, steps: int = 400, shift: float = 0.0) -> OrdinalModel:
    """Maximum likelihood with a Gaussian prior around each feature's log-odds, by Adam over the whole sample; shift is added to both thresholds."""
    toxic = toxic.astype(bool)
    known = sorted(set().union(*texts))
    if not known or toxic.all() or not toxic.any():
        return OrdinalModel({}, (40.0, 41.0))
    index = {w: k for k, w in enumerate(known)}
    rows, cols = np.array([(r, index[w]) for r, found in enumerate(texts) for w in sorted(found)], np.int64).reshape(-1, 2).T
    n, d = len(texts), len(known)
    n1, seen = int(toxic.sum()), np.bincount(cols, minlength=d)
    bad = np.bincount(cols, toxic[rows].astype(float), d)
    prior = (np.log((bad + 0.5) / (n1 + 1)) - np.log((seen - bad + 0.5) / (n - n1 + 1))) / 2  # half: words and their beginnings go together
    y = grade(np.bincount(rows, prior[cols] > 0, n), toxic)
    base = [np.clip((y > k).mean(), 0.5 / n, 1 - 0.5 / n) for k in (0, 1)]
    theta0 = float(np.log((1 - base[0]) / base[0]))
    gap = float(np.log(max(0.1, np.log((1 - base[1]) / base[1]) - theta0)))  # theta_1 = theta_0 + exp(gap)
    p = np.concatenate([prior, [theta0, gap]])
    m, v = np.zeros_like(p), np.zeros_like(p)
    for step in range(1, steps + 1):
        gradient = likelihood(p, rows, cols, y, prior, l2)[1]
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        p += 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return OrdinalModel({w: float(p[k]) for w, k in index.items()}, (float(p[d]) + shift, float(p[d] + np.exp(p[d + 1])) + shift))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> OrdinalModel:
    """Fits on at most `sample` labelled ids, toxic ones first up to half; only the telling features of those texts come to the driver."""
    labelled = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.max("toxic") > 0).alias("_toxic"))
    n_toxic, n_clean = labelled.agg(F.count_if("_toxic"), F.count_if(~F.col("_toxic"))).first()
    n1 = min(n_toxic, max(sample // 2, sample - n_clean))
    pick = lambda of, n: labelled.where(of).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = pick(F.col("_toxic"), n1).unionAll(pick(~F.col("_toxic"), min(n_clean, sample - n1)))
    n0 = min(n_clean, sample - n1)
    shift = float(np.log(n_clean / n_toxic * n1 / n0)) if n1 and n0 else 0.0
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), "text").where("_id is not null").join(F.broadcast(chosen), "_id")  # `sample` rows at most

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = [sorted(features_of(t)) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([int(t) for t in part.column(1).to_pylist()], pa.int32()), pa.array(found, pa.list_(pa.string()))], ["id", "toxic", "features"])

    sampled = bounded(texts.select("_id", "_toxic", "text")).mapInArrow(rows, "id long, toxic int, features array<string>")
    once = sampled.withColumn("digest", F.sha2(F.array_join("features", " "), 256)).groupBy("digest", "toxic").agg(F.min_by("features", "id").alias("features"), F.min("id").alias("id"))
    sampled = materialize(once, "labelled-sample")
    told = telling(sampled)
    held = sampled.select("digest", "toxic", F.explode("features").alias("feature")).join(F.broadcast(told), "feature").groupBy("digest", "toxic").agg(F.collect_set("feature").alias("features"))  # told: FEATURES rows at most
    got = sampled.select("digest", "toxic").join(held, ["digest", "toxic"], "left").orderBy("digest", "toxic").toPandas()
    return fit([set(w) if w is not None else set() for w in got["features"]], (got["toxic"] > 0).to_numpy(bool), shift=shift)


def score(docs: DataFrame, model: OrdinalModel, reject: float = REJECT) -> DataFrame:
    """docs with severity (the likeliest grade), expected_severity, p_toxic and rejected."""
    out = ["severity", "expected_severity", "p_toxic", "rejected"]
    docs = docs.drop(*out)
    names = docs.columns
    at = names.index("text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))  # at most FEATURES words

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = OrdinalModel(*shared.value)
        for batch in batches:
            scores, some = np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            for k, text in enumerate(batch.column(at)):  # one text's features at a time
                found = features_of(text.as_py())
                scores[k], some[k] = known.score(found), bool(found)
            p = known.probabilities(scores)
            expected = p.sum(axis=1).round(9)
            likeliest = np.stack([1 - p[:, 0], p[:, 0] - p[:, 1], p[:, 1]]).argmax(axis=0).astype(np.int32)
            bad = (p[:, 0] >= reject) & some
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(names))), pa.array(likeliest), pa.array(expected), pa.array(p[:, 0].round(9)), pa.array(bad)], [*names, *out])

    schema = docs.limit(0).withColumns({"severity": F.lit(0), "expected_severity": F.lit(0.0), "p_toxic": F.lit(0.0), "rejected": F.lit(False)}).schema
    return bounded(docs).mapInArrow(rows, schema)

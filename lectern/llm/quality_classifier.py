"""Quality of documents by supervised subword embeddings.

A text is its words (cut at white space, case kept). Its features are the words, pairs of neighbouring words, the
character n-grams (NGRAMS) of each word between < and >, and one end mark. A word that repeats the one before makes the
same pair feature whatever the word. Features are hashed to BUCKETS buckets, each with a learned vector of SIZE numbers.
The vectors of all features of a text are averaged, and a softmax layer over the two labels makes a probability of it.
Both are trained by stochastic gradient descent in numpy, text by text: TRAINERS groups of the sample take whole
passes of at least STEPS steps from common weights in as many tasks, and the weights are averaged, ROUNDS times over.

The model is fitted on at most SAMPLE labelled rows, those of the rarer label first up to half of them, chosen by the
hash of their ids; the bias is shifted back to the share of the labels among all labelled rows. What a task holds is its
share of the sample's features, at most BUCKETS a text; the driver holds TRAINERS models of BUCKETS x SIZE floats.
Hashing is done over arrays of characters, SEGMENT of them at a time, so that a text of one long word takes no more
memory than its words do. Scoring is linear in the features: a text's score is the mean of what its buckets add.

Cases: a null or empty text has the end mark alone. Whole texts count, however long. Null labels, labels without a
document and null doc_ids in labels are ignored; a doc_id with several labels has the one that at least half of them give
(1 in a tie). Repeated documents of a labelled doc_id are all learned from. Without labels the score is 0.5, with one
kind of label its share of them. All rows are scored, null doc_ids too (not held out). Other columns pass through; the output columns
replace namesakes. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import materialize

SAMPLE = 6000
BUCKETS = 1 << 16
SIZE = 8
NGRAMS = (3, 4)
TRAINERS, ROUNDS, STEPS = 8, 4, 2000
RATE = 2.0
SEGMENT = 1 << 17
KEEP = 0.3
_END, _SAME = 0, 1  # the first two buckets are of the end mark and of a word repeated
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def spread(h: np.ndarray) -> np.ndarray:
    """Buckets of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return 2 + ((h >> np.uint64(33)) % np.uint64(BUCKETS - 2)).astype(np.int64)


def features(text: str | None) -> Iterator[np.ndarray]:
    """The buckets of all features of a text, a segment at a time."""
    yield np.array([_END])
    words = (text or "").split()
    if not words:
        return
    marked = f"<{'> <'.join(words)}>"
    digests = np.zeros(len(words), np.uint64)
    word, since = 0, -1  # of the segment's first character: its word, and where the space before it is
    for start in range(0, len(marked), SEGMENT):
        codes = np.frombuffer(marked[start : start + SEGMENT + NGRAMS[-1] - 1].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        gap = codes == 32
        gaps = np.concatenate([[0], np.cumsum(gap)])
        for n in NGRAMS:
            k = min(SEGMENT, len(codes) - n + 1)
            if k > 0:
                whole = gaps[n : n + k] == gaps[:k]  # of one word
                yield spread(sum(codes[i : i + k] * _ODD[i] for i in range(n)) + np.uint64(n))[whole]
        codes, gap = codes[:SEGMENT], gap[:SEGMENT]
        at = np.arange(start, start + len(codes))
        place = at - np.maximum.accumulate(np.where(gap, at, since))
        part = (codes + place.astype(np.uint64) * _ODD[0]) * _ODD[1]
        part = np.where(gap, np.uint64(0), (part ^ (part >> np.uint64(31))) * _ODD[2])
        edges = np.flatnonzero(gap)
        sums = np.add.reduceat(part, np.concatenate([[0], edges]) if not len(edges) or edges[0] else edges)
        first = word + (len(edges) > 0 and edges[0] == 0)
        digests[first : first + len(sums)] += sums
        word += len(edges)
        since = int(start + edges[-1]) if len(edges) else since
    yield spread(digests)
    yield np.where(digests[:-1] == digests[1:], _SAME, spread(digests[:-1] * _ODD[3] + digests[1:]))


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of a text, rising, and the share of its features in each."""
    n = sum(np.bincount(found, minlength=BUCKETS) for found in features(text))
    at = np.flatnonzero(n).astype(np.int32)
    return at, (n[at] / n.sum()).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray  # BUCKETS x SIZE
    layer: np.ndarray  # SIZE x 2
    bias: np.ndarray  # of the two labels

    @staticmethod
    def fresh() -> Model:
        return Model(np.random.default_rng(0).uniform(-1 / SIZE, 1 / SIZE, (BUCKETS, SIZE)).astype(np.float32), np.zeros((SIZE, 2), np.float32), np.zeros(2, np.float32))

    def margins(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two labels' scores, and the difference of the biases."""
        return self.vectors.astype(float) @ (self.layer[:, 1] - self.layer[:, 0]).astype(float), float(self.bias[1] - self.bias[0])


def gradients(model: Model, at: np.ndarray, share: np.ndarray, label: int) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """The loss -log P(label) of a text, and its gradients by the average vector, the layer and the bias."""
    mean = np.einsum("n,nd->d", share, model.vectors[at])  # no threads of a matrix library for so little
    raised = mean @ model.layer + model.bias
    p = np.exp(raised - raised.max())
    p /= p.sum()
    off = p.copy()
    off[label] -= 1
    return -float(np.log(max(p[label], 1e-30))), model.layer @ off, np.outer(mean, off), off


def descend(model: Model, texts: list[tuple[np.ndarray, np.ndarray, int]], rates: np.ndarray) -> None:
    """One step of gradient descent a text, in place; the average's gradient reaches each bucket by its share."""
    for (at, share, label), rate in zip(texts, rates, strict=True):
        _, by_mean, by_layer, by_bias = gradients(model, at, share, label)
        model.vectors[at] -= (rate * share)[:, None] * by_mean[None, :]
        model.layer -= rate * by_layer
        model.bias -= rate * by_bias


def _trainer(start: Broadcast, k: int) -> Callable[[pa.Table], pa.Table]:
    """Trains the weights of round k on from a group's texts."""

    def trained(rows: pa.Table) -> pa.Table:
        known = start.value
        own = Model(known.vectors.copy(), known.layer.copy(), known.bias.copy())
        texts = [(a.values.to_numpy(), s.values.to_numpy(), y.as_py()) for a, s, y in zip(rows["at"], rows["share"], rows["label"], strict=True)]
        texts.sort(key=lambda t: (t[2], len(t[0]), crc32(t[0].tobytes()), crc32(t[1].tobytes())))  # whatever order the rows come in
        draw = np.random.default_rng(k)
        n = len(texts)
        epochs = -(-STEPS // n)
        for epoch in range(epochs):
            done = (k + (epoch + np.arange(n) / n) / epochs) / ROUNDS
            descend(own, [texts[i] for i in draw.permutation(n)], (RATE * (1 - done)).astype(np.float32))
        return pa.table({"n": [n], "vectors": [own.vectors.tobytes()], "layer": [own.layer.tobytes()], "bias": [own.bias.tobytes()]})

    return trained


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fits on at most `sample` rows of labels (doc_id, quality 0 or 1)."""
    kind = labels.schema["doc_id"].dataType
    labelled = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("_id")).agg((F.avg(F.col("quality").cast("double")) >= 0.5).cast("int").alias("_label"))
    n0, n1 = labelled.agg(F.count_if(F.col("_label") == 0), F.count_if(F.col("_label") == 1)).first()
    model = Model.fresh()
    if not n0 or not n1:
        model.bias[1] = 0.0 if n0 == n1 else 40.0 if n1 else -40.0
        return model
    rare = 0 if n0 <= n1 else 1
    few, many = min(n0, n1), max(n0, n1)
    took = min(few, max(sample // 2, sample - many))
    rest = min(many, sample - took)
    pick = lambda label, n: labelled.where(F.col("_label") == label).orderBy(F.xxhash64("_id"), "_id").limit(n)
    chosen = pick(rare, took).unionAll(pick(1 - rare, rest))
    texts = docs.select(F.col("doc_id").cast(kind).alias("_id"), "text").join(F.broadcast(chosen), "_id")  # `sample` rows at most

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                found = [counts(t.as_py()) for t in part.column(2)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([a for a, _ in found], pa.list_(pa.int32())), pa.array([s for _, s in found], pa.list_(pa.float32()))], ["slot", "label", "at", "share"])

    slot = F.pmod(F.xxhash64("_id", F.lit("slot")), F.lit(TRAINERS)).cast("int")
    held = materialize(texts.select(slot, "_label", "text").mapInArrow(featured, "slot int, label int, at array<int>, share array<float>"), "quality-sample")
    spark = docs.sparkSession
    for k in range(ROUNDS):
        start = spark.sparkContext.broadcast(model)

        made = held.repartition(TRAINERS, "slot").groupBy("slot").applyInArrow(_trainer(start, k), "n long, vectors binary, layer binary, bias binary")
        got = sorted(made.collect(), key=lambda r: (r["n"], crc32(r["vectors"])))  # TRAINERS models, in an order of their own
        if not got:
            return Model.fresh()
        weight = np.array([r["n"] for r in got], float) / sum(r["n"] for r in got)
        mean = lambda name, shape, rows=got, weight=weight: sum(w * np.frombuffer(r[name], np.float32) for w, r in zip(weight, rows, strict=True)).astype(np.float32).reshape(shape)
        model = Model(mean("vectors", (BUCKETS, SIZE)), mean("layer", (SIZE, 2)), mean("bias", (2,)))
        start.unpersist()
    model.bias[rare] += np.log(few / many) - np.log(took / rest)
    return model


def margin(text: str | None, margins: np.ndarray) -> float:
    """The mean margin of a text's features."""
    total, n = 0.0, 0
    for found in features(text):
        total += margins[found].sum()
        n += len(found)
    return float(total / n)


def score(docs: DataFrame, model: Model, keep: float = KEEP) -> DataFrame:
    """docs with score, the probability of label 1, and predicted, 1 from `keep` on."""
    docs = docs.drop("score", "predicted")
    names, at = docs.columns, docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(model.margins())  # BUCKETS numbers

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        margins, bias = shared.value
        for batch in batches:
            raised = np.array([margin(t.as_py(), margins) + bias for t in batch.column(at)], float)
            p = (1 / (1 + np.exp(-np.clip(raised, -40, 40)))).round(9)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p), pa.array((p >= keep).astype(np.int32))], [*names, "score", "predicted"])

    return docs.mapInArrow(rows, docs.limit(0).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema)


def held_out(doc_id: Column) -> Column:
    """Whether a row's label may not be learned from: crc32 of its id as text divides by 5. Null ids are not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted, learned from the labels that aren't held out."""
    model = train(docs, labels.where(~held_out(F.col("doc_id"))))
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"))), model)

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import quality_classifier as qc
from lectern.llm.queries import QUERIES


def scored(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.fixture(scope="module")
def sf():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def judged(spark, sf):
    return scored(QUERIES["op13_quality_classifier"](spark, sf))


def plain(text):
    """The features of a text as tuples, one by one."""
    words = (text or "").split()
    found = [("end",)] + [("w", w) for w in words]
    found += [("same",) if a == b else ("pair", a, b) for a, b in zip(words, words[1:], strict=False)]
    for w in words:
        found += [("g", n, f"<{w}>"[k : k + n]) for n in qc.NGRAMS for k in range(len(w) + 3 - n)]
    return found


@pytest.mark.parametrize("segment", [7, 64, qc.SEGMENT])
def test_features_are_words_pairs_and_character_ngrams(monkeypatch, segment):
    monkeypatch.setattr(qc, "SEGMENT", segment)
    monkeypatch.setattr(qc, "BUCKETS", 1 << 30)
    for text in (None, "", "  ", "a", "aa bb aa aa", "Ünï😀code words  with\tlong " + "x" * 100 + " words words", "abcd " * 40, "tail of a segment " * 9):
        got = np.concatenate(list(qc.features(text)))
        want = plain(text)
        assert len(got) == len(want) and len(set(got.tolist())) == len(set(want))
        assert sorted(np.unique(got, return_counts=True)[1]) == sorted({f: want.count(f) for f in want}.values())


def test_gradient_is_that_of_the_loss():
    draw = np.random.default_rng(1)
    model = qc.Model(draw.normal(size=(qc.BUCKETS, 3)), draw.normal(size=(3, 2)), draw.normal(size=2))
    at, share = qc.counts("Some words words here")
    for label in (0, 1):
        _, by_mean, by_layer, by_bias = qc.gradients(model, at, share, label)
        for part, own in ((model.vectors, lambda k, label=label: (share * by_mean[k % 3])[list(at).index(k // 3)]), (model.layer, lambda k: by_layer.flat[k]), (model.bias, lambda k: by_bias[k])):
            for k in [int(at[0]) * 3, int(at[2]) * 3 + 1] if part is model.vectors else range(part.size):
                was = part.flat[k]
                losses = []
                for step in (1e-5, -1e-5):
                    part.flat[k] = was + step
                    losses.append(qc.gradients(model, at, share, label)[0])
                part.flat[k] = was
                assert np.isclose((losses[0] - losses[1]) / 2e-5, own(k), atol=1e-6)


def test_score_is_the_softmax_of_averaged_vectors(spark, odd_docs):
    draw = np.random.default_rng(2)
    model = qc.Model(draw.normal(size=(qc.BUCKETS, qc.SIZE)).astype(np.float32), draw.normal(size=(qc.SIZE, 2)).astype(np.float32), draw.normal(size=2).astype(np.float32))
    got = qc.score(odd_docs, model)
    assert got.columns == [*odd_docs.columns, "score", "predicted"] and got.count() == odd_docs.count()
    for r in got.collect():
        at, share = qc.counts(r["text"])
        raised = share.astype(float) @ model.vectors[at].astype(float) @ model.layer.astype(float) + model.bias
        p = np.exp(raised - raised.max())
        assert abs(p[1] / p.sum() - r["score"]) < 1e-5 and r["predicted"] == int(r["score"] >= 0.3)


def test_held_out_accuracy(spark, sf, judged):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(judged) == spark.read.parquet(f"{sf}/documents.parquet").count()
    for r in judged.values():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1
    apart = [(r["predicted"], labels[d]) for d, r in judged.items() if r["held_out"] and d in labels]
    assert len(apart) > 50 and {y for _, y in apart} == {0, 1}
    assert sum(p == y for p, y in apart) >= 0.98 * len(apart)


def test_held_out_labels_and_other_columns_change_no_score(spark, sf, judged):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumns({"lang": F.lit("zz"), "source": F.lit("same"), "score": F.lit("mine"), "held_out": F.lit("mine")})
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    swapped = labels.withColumn("quality", F.when(qc.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    got = scored(qc.classify(docs, swapped))
    assert {d: (r["held_out"], r["score"]) for d, r in got.items()} == {d: (r["held_out"], r["score"]) for d, r in judged.items()}


def test_few_bad_documents_in_a_smaller_sample(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rare = labels.where((F.col("quality") == 1) | (F.col("doc_id") % 3 == 0))
    model = qc.train(docs, rare.where(~qc.held_out(F.col("doc_id"))), sample=80)
    got = {r["doc_id"]: r["predicted"] for r in qc.score(docs, model).collect()}
    bad = [r["doc_id"] for r in labels.where("quality = 0").collect()]
    good = [r["doc_id"] for r in labels.where("quality = 1").collect()]
    assert np.mean([got[d] for d in bad]) < 0.25 and np.mean([got[d] for d in good]) > 0.97


def test_odd_labels(spark, odd_docs, no_docs):
    some = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (9, 1), (None, 1), (6, None), (999, 0)], "doc_id long, quality int")
    assert qc.classify(odd_docs, some).count() == odd_docs.count()
    assert qc.classify(no_docs, some).count() == 0
    of = lambda labels: {(r["score"], r["predicted"]) for r in qc.classify(odd_docs, labels).collect()}
    assert of(some.limit(0)) == {(0.5, 1)}
    assert of(some.where("quality = 1")) == {(1.0, 1)} and of(some.where("doc_id = 8")) == {(0.0, 0)}

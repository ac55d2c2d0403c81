import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.llm import whitening
from lectern.llm.queries import QUERIES

SCHEMA = "vec_id long, embedding array<float>, n string, whitened string, component string"


def brute(vectors):
    """ids of the sound rows, their lattice vectors, n, sums, and the leading eigenpairs of the distinct ones, by numpy."""
    sound = [(k, [int(np.floor(256 * float(c))) for c in v]) for k, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in sound})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float) - np.array([s / n for s in sums])
    values, q = np.linalg.eigh(x.T @ x / n)
    return sound, n, sums, values[::-1], q[:, ::-1]


def compare(rows, vectors, atol=1e-9):
    sound, n, sums, values, q = brute(vectors)
    d, k = len(sums), min(4, len(sums))
    got = {}
    for r in rows:
        got.setdefault((r["vec_id"], r["component"]), []).append(r)
    assert sum(len(v) for v in got.values()) == len(sound) * k
    sign = {}
    for key, x in sound:
        deviation = sum((n * a - s) ** 2 for a, s in zip(x, sums, strict=True))
        for c in range(k):
            want = float((np.array(x) - np.array([s / n for s in sums])) @ q[:, c]) / np.sqrt(values[c]) if values[c] > 1e-9 * values.sum() else None
            found = [r for r in got[key, c + 1] if r["deviation"] == deviation]
            assert found and all(r["n"] == n for r in found)
            r = found[0]
            assert abs(r["explained"] - max(0, values[c]) / max(values.sum(), 1e-300)) < 1e-9 and r["identity_error"] < 1e-9
            if want is None:
                assert r["whitened"] is None
            else:
                s = sign.setdefault(c, 1.0 if abs(want) < 1e-6 else np.sign(want * r["whitened"]))
                assert abs(want) < 1e-6 or abs(s * r["whitened"] - want) < atol * max(1, abs(want)) * d
    return n


@pytest.mark.parametrize("d", [1, 2, 7, 40])
def test_rank_one_update_keeps_the_decomposition(d):
    draw = np.random.default_rng(d)
    for _ in range(30):
        q, _ = np.linalg.qr(draw.normal(size=(d, d)))
        values = np.sort(draw.choice([0, 0, 1, 1, 2.5, 1e-9, 3e5], d) * draw.choice([1, 1 + 1e-12], d))
        v, rho = draw.normal(size=d) * draw.choice([0, 1, 1e-8, 1], d), float(draw.choice([1, 1e-6, 1e4]))
        want = q @ np.diag(values) @ q.T + rho * np.outer(v, v)
        found, vectors = whitening.rank_one(values, q, v, rho)
        assert np.all(np.diff(found) >= 0) and np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs(vectors @ np.diag(found) @ vectors.T - want).max() < 1e-12 * max(np.abs(want).max(), 1e-300)


def test_updates_and_joins_equal_the_scatter():
    draw = np.random.default_rng(1)
    x = (draw.normal(size=(300, 12)) * np.arange(1, 13)).astype(int)
    parts = []
    for at in (0, 100, 130):
        parts.append(whitening.Spectrum([0] * 12))
        for v in x[at : {0: 100, 100: 130, 130: 300}[at]]:
            parts[-1].take(v.tolist())
    first, *rest = [whitening.Spectrum.of(p.table().to_pylist()[0]) for p in parts]
    for p in rest:
        first.join(p)
    scatter = np.cov(x.T, bias=True) * 300
    assert first.n == 300 and first.sums == x.sum(0).tolist()
    assert np.abs(first.vectors @ np.diag(first.values) @ first.vectors.T - scatter).max() < 1e-11 * scatter.max()


def test_whole_table(spark, sf):
    rows = QUERIES["op11_embedding_whitening"](spark, sf).collect()
    compare(rows, [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()])


def test_nulls_copies_and_ties(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    draw = np.random.default_rng(5)
    vectors = [(k, [float(np.float32(c)) for c in draw.normal(size=6) * [5, 3, 2, 2, 1, 0.1]]) for k in range(200)]
    vectors += [(k, vectors[0][1]) for k in range(200, 400)] + [(3, vectors[3][1]), (3, vectors[9][1]), (None, vectors[1][1]), (400, [-0.0] * 6)]
    vectors += [(500, None), (501, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (502, [float("nan")] + [0.0] * 5), (503, [float("inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(k, v, "n", "w", "c") for k, v in vectors], SCHEMA).repartition(7)
    laid = df.withColumn("x", whitening.lattice(F.col("embedding")))
    known = whitening.fit_whitening(laid, "x")
    got = whitening.whiten(laid, "x", known)
    assert got.columns == ["vec_id", "embedding", *whitening._OUT]
    assert compare(got.collect(), vectors) == 201
    ragged = laid.unionByName(spark.createDataFrame([(600, [1.0, 2.0], "", "", "")] * 3, SCHEMA).withColumn("x", whitening.lattice(F.col("embedding"))))
    assert whitening.whiten(ragged, "x", whitening.fit_whitening(ragged, "x")).count() == got.count()


@pytest.mark.parametrize("vectors", [[[1.0, 2.0, 3.0, 4.0, 5.0]] * 3, [[1.0, 2.0, 3.0, 4.0, 5.0], [2.0, 2.0, 3.0, 4.5, 5.0], [0.0, 9.0, 3.0, 4.0, 5.0]], [[0.5, 1.0], [2.0, 3.0], [9.0, 1.0]]])
def test_fewer_directions_than_components(spark, vectors):
    laid = spark.createDataFrame([(k, v, "", "", "") for k, v in enumerate(vectors)], SCHEMA).withColumn("x", whitening.lattice(F.col("embedding")))
    compare(whitening.whiten(laid, "x", whitening.fit_whitening(laid, "x")).collect(), list(enumerate(vectors)))


def test_deviations_beyond_a_long_and_no_rows(spark):
    big = spark.createDataFrame([(k, [1e15 * (k - 1), float(k)], "", "", "") for k in range(3)], SCHEMA).withColumn("x", whitening.lattice(F.col("embedding")))
    got = whitening.whiten(big, "x", whitening.fit_whitening(big, "x")).collect()
    assert len(got) == 6 and {r["deviation"] is None for r in got if r["vec_id"] != 1} == {True}
    none = big.limit(0)
    assert whitening.fit_whitening(none, "x") is None and whitening.whiten(none, "x", None).count() == 0

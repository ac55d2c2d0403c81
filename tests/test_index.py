"""The inverted-file index against brute force."""

import re

import numpy as np
import pytest

from lectern.operators import index

DIM = 8


def brute(vectors, queries, k):
    """The k best by the score at six digits, then by id."""
    out = {}
    ids = np.array([i for i, _ in vectors])
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    v = unit(np.array([x for _, x in vectors], np.float32).astype(float))
    for qid, q in queries:
        s = np.round(v @ unit(np.array([q], np.float32).astype(float))[0], 6) + 0.0
        out[qid] = [(int(ids[j]), float(s[j])) for j in np.lexsort((ids, -s))[:k]]
    return out


def clustered(n, seed=3, groups=12):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(groups, DIM))
    return [(k, (middles[k % groups] + 0.05 * rng.normal(size=DIM)).astype(np.float32).tolist()) for k in range(n)]


def frame(spark, rows, key="id"):
    return spark.createDataFrame(rows, f"{key} long, embedding array<float>")


def found(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.qid, r.rank)):
        out.setdefault(r.qid, []).append((r.id, r.score))
    return out


def same(got, want):
    assert got.keys() == want.keys()
    for q, best in want.items():
        assert [i for i, _ in got[q]] == [i for i, _ in best]
        assert np.allclose([s for _, s in got[q]], [s for _, s in best], atol=1e-6)


def test_exact_search_equals_the_scan_with_a_hot_group_and_odd_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 16 * DIM)  # blocks of 16 vectors
    good = clustered(400) + [(1000 + k, [1.0, 2.0] + [0.0] * 6) for k in range(200)] + [(2000, [0.0] * DIM), (2001, [0.0] * DIM)]
    odd = [(3000, None), (3001, [1.0]), (3002, [float("nan")] * DIM), (3003, [float("inf")] + [0.0] * 7), (3004, [None] * DIM)]
    asked = [(q, v) for q, v in good if q % 37 == 0] + [(1001, good[401][1]), (2000, [0.0] * DIM)]
    path = str(tmp_path / "index")
    index.build(frame(spark, good + odd), path, DIM, lists=10)
    assert index.blocks(spark, path).selectExpr("max(size(ids)) as most", "sum(size(ids)) as n").first() == (16, len(good))
    hot = index.blocks(spark, path).where("array_contains(ids, 1000L) or array_contains(ids, 1199L)").select("list").distinct().count()
    assert hot == 1 and index.blocks(spark, path).groupBy("list").count().agg({"count": "max"}).first()[0] >= 12
    same(found(index.search(spark, path, frame(spark, asked + [(9, None), (8, [1.0])], "qid"), 7)), brute(good, dict(asked).items(), 7))


def test_k_beyond_the_table(spark, tmp_path):
    rows = clustered(20)
    index.build(frame(spark, rows), str(tmp_path / "index"), DIM, lists=4)
    same(found(index.search(spark, str(tmp_path / "index"), frame(spark, rows[:3], "qid"), 50)), brute(rows, rows[:3], 50))


def test_far_lists_are_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 25 * DIM)
    rows, path = clustered(1200), str(tmp_path / "index")
    index.build(frame(spark, rows), path, DIM, lists=12)
    seen, real = [], index._score

    def score(session, at, visits, *rest):
        out = real(session, at, visits, *rest)
        seen.append((visits.select("block").distinct().count(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(index, "_score", score)
    same(found(index.search(spark, path, frame(spark, [rows[5]], "qid"), 5)), brute(rows, [rows[5]], 5))
    assert len(seen) == 2 and 0 < sum(n for n, _ in seen) < index.blocks(spark, path).count() / 2
    assert re.search(r"PartitionFilters: \[[^\]]*list#", seen[0][1])


def test_probes_raise_the_recall(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(1)
    rows, path = [(k, rng.normal(size=DIM).astype(np.float32).tolist()) for k in range(1500)], str(tmp_path / "index")
    index.build(frame(spark, rows), path, DIM, lists=20)
    monkeypatch.setattr(index, "BLOCK", DIM)  # a query is a block, so that none lends its lists to another
    want, recall = brute(rows, rows[:40], 10), []
    for probes in (1, 6, 20):
        got = found(index.search(spark, path, frame(spark, rows[:40], "qid"), 10, probes, exact=False))
        recall.append(sum(len({i for i, _ in got[q]} & {i for i, _ in best}) for q, best in want.items()) / 400)
    assert 0.2 < recall[0] < recall[1] < recall[2] == 1.0 and recall[1] > 0.8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [0.0] * DIM)]])
def test_nothing_to_fit(spark, tmp_path, rows):
    path = str(tmp_path / "index")
    index.build(frame(spark, rows), path, DIM, lists=4)
    got = found(index.search(spark, path, frame(spark, [(5, [1.0] * DIM)], "qid"), 3))
    assert got == ({5: [(1, 0.0)]} if rows and rows[0][1] else {})

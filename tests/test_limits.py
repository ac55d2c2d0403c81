"""Limits that tasks share, and headings of very long texts."""

import os
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, ledger, providers


def logged(folder):
    """A completer that leaves the time of each call."""

    def call(prompts):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
            f.write(repr(time.time()))
        return [f"re {p}" for p in prompts]

    return call


def most_in(folder, seconds):
    at = sorted(float(open(f"{folder}/{n}").read()) for n in os.listdir(folder))
    return max(sum(a <= b < a + seconds for b in at) for a in at), len(at)


@pytest.fixture()
def one_a_batch(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, "1")
    yield
    spark.conf.set(key, old)


def test_tasks_share_a_limit(spark, tmp_path, one_a_batch):
    prompts = spark.range(0, 60, 1, 24).select(F.concat(F.lit("p"), "id").alias("prompt"))  # three rounds of eight tasks
    got = providers.complete(prompts, logged(str(tmp_path)), limit=providers.Limit(20, 8)).collect()
    assert sorted(r.reply for r in got) == sorted(f"re p{k}" for k in range(60))
    most, n = most_in(tmp_path, 1.0)
    assert n == 60 and most <= 20 + 8


def test_a_ledger_and_embeddings_keep_the_limit(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    prompts = spark.range(0, 32, 1, 8).select(F.concat(F.lit("p"), "id").alias("prompt"))
    got = ledger.ask(prompts, logged(str(tmp_path / "calls")), str(tmp_path / "ledger"), "m", batch=1, limit=providers.Limit(16, 8)).collect()
    assert len(got) == 32 and all(r.reply and r.error is None for r in got)
    most, n = most_in(tmp_path / "calls", 1.0)
    assert n == 32 and most <= 16 + 8
    began = time.time()
    made = providers.embed_each(spark.createDataFrame([("a",), (None,)], "text string").coalesce(1), lambda t: [[1.0]] * len(t), dim=1, limit=providers.Limit(2, 1)).collect()
    assert time.time() - began >= 0.5 and [r.error for r in made] == [None, "no text"]


def test_gaps_delays_and_retries_of_one_task():
    now, calls, fail = [0.0], [], ["429 retry in 9s"]

    def pause(s):
        now[0] += s

    def call(batch):
        calls.append(now[0])
        if fail:
            raise ValueError(fail.pop())
        return batch

    run = providers.Limit(4, 8).spaced(call, lambda: now[0], pause)  # a call each 2 s
    with pytest.raises(ValueError):
        run([1])
    assert run([2]) == [2] and run([3]) == [3]
    assert calls == [2.0, 11.0, 13.0]
    fail.append("503 unavailable")
    again = providers.Limit(4, 8, attempts=2).spaced(call, lambda: now[0], pause)
    assert again([4]) == [4] and calls[3:] == [15.0, 30.0]


@pytest.mark.parametrize("bad", [(0, 1), (-1, 1), (1, 0)])
def test_a_limit_is_positive(bad):
    with pytest.raises(ValueError):
        providers.Limit(*bad)


def test_headings_of_a_very_long_text(spark):
    n = 100_000
    text = "\n".join(f"## {k}" if k % 2 else f"line {k}\n  ### x {k}  " for k in range(n))
    want, at = [], 0
    for line in text.split("\n"):
        if line.strip().startswith(("## ", "### ")):
            want.append((at, line.strip().lstrip("#").strip()))
        at += len(line) + 1
    began = time.time()
    got = spark.createDataFrame([(text,), (None,), ("",), ("## a",)], "text string").select(chunking.heading_map(F.col("text")).alias("h")).collect()
    assert [tuple(h) for h in got[0].h] == want and time.time() - began < 60
    assert got[1].h is None and got[2].h == [] and [tuple(h) for h in got[3].h] == [(0, "a")]

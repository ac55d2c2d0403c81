"""Streams, ledgers, versioned tables and batches across tasks: restarts, interruptions and odd rows."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from lectern.operators import chunking, ingest, ledger, providers, trace, transcript
from lectern.sources import replies
from lectern.sources.versions import Conflict, VersionedTable
from lectern.streaming import stages


def write_requests(spark, rows, folder, name):
    made = f"{folder}-made-{name}"
    spark.createDataFrame(rows, "request_id long, prompt string").coalesce(1).write.parquet(made)
    os.makedirs(folder, exist_ok=True)
    os.rename(glob.glob(f"{made}/part-*.parquet")[0], f"{folder}/{name}.parquet")


def test_stream_of_replies_in_three_batches_equals_the_batch_and_a_restart_repeats_nothing(spark, tmp_path):
    spark.dataSource.register(replies.Replies)
    folder, out, checkpoint = f"{tmp_path}/requests", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    parts = [[(1, "One two three. Four."), (2, "no stop here")], [(3, None), (4, "")], [(5, " spaced  words . x"), (6, ".")]]

    def run():
        read = spark.readStream.format("replies").option("path", folder).option("rowsPerBatch", 2).load()
        query = read.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return sum(p["numInputRows"] for p in query.recentProgress)

    counts = []
    for k, rows in enumerate(parts):
        write_requests(spark, rows, folder, f"{k:03d}")
        counts.append(run())
    assert all(counts) and run() == 0
    batch = spark.read.format("replies").option("path", folder).load()
    got = sorted(map(tuple, spark.read.parquet(out).collect()), key=repr)
    assert got == sorted(map(tuple, batch.collect()), key=repr) and len(got) == sum(counts)
    by = {}
    for r in batch.orderBy("request_id", "seq").collect():
        by.setdefault(r["request_id"], []).append(r)
    for rows in by.values():
        assert [r["seq"] for r in rows] == list(range(len(rows)))  # tokens, then how it ended, then done
        assert [r["kind"] for r in rows[:-2]] == ["token"] * (len(rows) - 2) and rows[-1]["kind"] == "done" and rows[-2]["kind"] in ("event", "error")
    said = {k: ([r["token"] for r in rows if r["kind"] == "token"], rows[-2]["detail"]) for k, rows in by.items()}
    assert said == {1: (["One", "two", "three"], None), 2: (["no"], "no sentence"), 3: ([], "no prompt"), 4: ([], "no sentence"), 5: (["spaced", "words"], None), 6: ([], None)}


def test_stage_events_of_records(spark):
    rows = [(1, 0, "event", "route", "done", None, None), (1, 1, "token", None, None, "x", "a"), (1, 2, "error", "compose", None, "bad", None), (1, 3, "done", None, None, None, None)]
    got = stages.stage_events(spark.createDataFrame(rows, replies.RECORD.replace("bigint", "long"))).orderBy("seq").collect()
    assert list(map(tuple, got)) == [(1, 0, "route", "done", None, None), (1, 1, "compose", "active", None, "a"), (1, 2, "compose", "error", "bad", None)]


def test_a_killed_run_asks_each_prompt_once(spark, tmp_path):
    asked = f"{tmp_path}/asked"
    os.makedirs(asked)

    def completer(prompts, most):
        if len(os.listdir(asked)) >= most:
            raise SystemExit  # no error of a call: the task dies
        for p in prompts:
            with open(f"{asked}/{p}", "x"):  # fails if it is there
                pass
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(k, f"p{k % 150}") for k in range(200)], "k int, prompt string")
    with pytest.raises(Exception, match="SystemExit|exited|failed|crash"):
        ledger.ask(df, lambda p: completer(p, 60), f"{tmp_path}/ledger", "m", batch=7).collect()
    first = len(os.listdir(asked))
    assert 60 <= first < 150
    got = ledger.ask(df, lambda p: completer(p, 10**6), f"{tmp_path}/ledger", "m", batch=7)
    assert {r.k: (r.reply, r.error) for r in got.collect()} == {k: (f"P{k % 150}", None) for k in range(200)}
    assert len(os.listdir(asked)) == 150 and ledger.read(spark, f"{tmp_path}/ledger").count() == 150
    other = ledger.ask(df.limit(1), lambda p: ["other"] * len(p), f"{tmp_path}/ledger", "another model").first()
    assert other.reply == "other"


def test_failures_leave_no_entry_and_are_asked_again(spark, tmp_path):
    def picky(prompts):
        if "bad" in prompts:
            raise ValueError("no")
        return prompts

    df = spark.createDataFrame([(1, "bad", "mine"), (2, "good", "mine"), (3, None, "mine")], "k int, prompt string, digest string")
    got = {r.k: (r.digest, r.reply, r.error) for r in ledger.ask(df, picky, f"{tmp_path}/l", "m").collect()}
    assert got == {1: ("mine", None, "no"), 2: ("mine", "good", None), 3: ("mine", None, "no prompt")}
    assert {r.k: r.reply for r in ledger.ask(df, lambda p: [x + "!" for x in p], f"{tmp_path}/l", "m").collect()} == {1: "bad!", 2: "good", 3: None}
    assert ledger.ask(df.limit(0), picky, f"{tmp_path}/none", "m").count() == 0


def test_versions_are_pinned_and_survive_interrupted_and_concurrent_writes(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/t", "id int, text string")
    assert t.read().count() == 0 and t.versions() == []
    assert t.replace(spark.createDataFrame([(1, "a"), (2, "b")], "id int, text string")) == 1
    pinned = t.read()
    broken = spark.range(10).select(F.col("id").cast("int").alias("id"), F.when(F.col("id") < 9, "x").otherwise(F.raise_error(F.lit("lost"))).alias("text"))
    with pytest.raises(Exception, match="lost"):
        t.replace(broken)
    assert t.versions() == [1] and sorted(map(tuple, t.read().collect())) == [(1, "a"), (2, "b")]
    assert t.append(spark.createDataFrame([(3, "c")], "id int, text string")) == 2
    assert t.add_column("language", "string", "en") == 3
    assert t.replace(spark.createDataFrame([(9, "z", "de")], "id int, text string, language string"), after=3) == 4
    with pytest.raises(Conflict):
        t.replace(spark.createDataFrame([(8, "y", "fr")], "id int, text string, language string"), after=3)
    assert list(map(tuple, t.read().collect())) == [(9, "z", "de")]
    assert sorted(map(tuple, t.read(2).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    assert sorted(map(tuple, t.read(2, newest_columns=True).collect())) == [(1, "a", "en"), (2, "b", "en"), (3, "c", "en")]
    assert sorted(map(tuple, pinned.collect())) == [(1, "a"), (2, "b")]
    assert [r.done for r in t.history().orderBy("version").collect()] == ["replace", "append", "add language", "replace"]
    with pytest.raises(ValueError, match="no column"):
        t.append(spark.createDataFrame([(1, 2)], "id int, other int"))
    with pytest.raises(ValueError, match="no version"):
        t.read(9)


def test_an_interrupted_seeding_is_completed_by_a_rerun(spark, tmp_path):
    chunks = spark.createDataFrame([(f"c{k}", f"f{k % 6}.pdf", k, f"text {k}") for k in range(60)], "chunk_id string, source_file string, line int, chunk_text string")
    made = lambda root: {n: VersionedTable(spark, f"file://{tmp_path}/{root}/{n}", c) for n, c in (("documents", "id string, mod string, file string"), ("chunks", "id string, document string, text string, chunk_index int"), ("embeddings", "id string, chunk string, embedding array<float>"))}
    once, broken = made("once"), made("broken")
    namespace = "6ba7b8109dad11d180b400c04fd430c8"
    ingest.seed_tables(chunks, once, providers.hashed_embedder(), namespace)
    calls = []

    class Stop(VersionedTable):
        def replace(self, *args, **more):
            calls.append(self.path)
            if len(calls) == 2:
                raise KeyboardInterrupt
            return super().replace(*args, **more)

    stopping = broken | {"embeddings": Stop(spark, f"file://{tmp_path}/broken/embeddings", "id string, chunk string, embedding array<float>")}
    with pytest.raises(KeyboardInterrupt):
        ingest.seed_tables(chunks, stopping, providers.hashed_embedder(), namespace, slices=3)
    assert broken["embeddings"].versions() == [1] and broken["chunks"].read().count() >= broken["embeddings"].read().count() > 0
    failed = ingest.seed_tables(chunks, broken, providers.hashed_embedder(), namespace, slices=3)
    assert failed.count() == 0
    for name in once:
        of = lambda t: sorted(map(repr, t.read().collect()))
        assert of(once[name]) == of(broken[name])


def plain_batches(rows, most):
    out, state = {}, {}
    for file, pos, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        batch, held = state.get(file, (0, 0))
        if held > 0 and held + (n or 0) > most:
            batch, held = batch + 1, 0
        out[file, pos] = batch
        state[file] = batch, held + (n or 0)
    return out


def test_tables_of_a_run_equal_the_fold():
    draw = random.Random(1)
    for _ in range(3000):
        most, words = draw.choice([1, 5, 30]), [draw.choice([0, 0, 1, 2, 7, 40]) for _ in range(draw.randint(0, 12))]
        state = draw.choice([(0, 0), (3, 0), (2, draw.randint(1, 45))])
        assert transcript._after(transcript._steps(words, most), *state, most) == transcript._batch(words, most, *state)[1:]


def test_batches_of_one_hot_file_are_spread_and_equal_the_fold(spark):
    draw = random.Random(2)
    rows = [("hot", k, draw.choice([0, 3, 50, 90, 200, 900, None])) for k in range(20_000)]
    rows += [(f"f{draw.randint(0, 40)}", k, draw.randint(0, 300)) for k in range(500)] + [(None, k, 300) for k in range(9)] + [("zz", k, 0) for k in range(30)]
    df = spark.createDataFrame(rows, "file string, pos int, word_count int").withColumns({"part": F.lit("mine"), "steps": F.lit(1.5), "batch": F.lit("old")})
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = transcript.greedy_batches(df)
        found = {(r["file"], r["pos"]): (r["batch"], r["part"], r["steps"]) for r in got.collect()}
        sizes = sorted(r["n"] for r in df.repartitionByRange("file", "pos").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert found == {k: (b, "mine", 1.5) for k, b in plain_batches(rows, 800).items()}
    assert len(sizes) > 2 and sizes[-1] < 2 * sizes[len(sizes) // 2]  # no task over twice the median
    assert transcript.greedy_batches(df.limit(0)).count() == 0


def test_lookup_loses_and_doubles_no_row(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, "z")], "k int, key string, of string")
    dimension = spark.createDataFrame([("a", 1), ("a", 2), ("d", 9), ("d", 8), (None, 7)], "key string, v int")
    of = lambda default, d=dimension: {(r.k, r.of, r.v) for r in ingest.lookup(rows, d, "key", default).collect()}
    assert of("d") == {(1, "x", 1), (2, "y", 8), (3, "z", 8)}
    assert of("nowhere") == {(1, "x", 1), (2, "y", None), (3, "z", None)}
    assert of("d", dimension.limit(0)) == {(1, "x", None), (2, "y", None), (3, "z", None)}


def test_a_text_without_pages_is_one_batch(spark):
    rows = spark.createDataFrame([(1, "\f\f--\f"), (2, "--"), (3, " \n"), (4, None), (5, "a--b")], "doc_id int, text string")
    got = {(r.doc_id, r.batch, r.text) for r in chunking.page_batches(rows, pattern="--").collect()}
    assert got == {(1, 0, "\f\f--\f"), (2, 0, "--"), (5, 0, "a\n\nb")}


def test_traces_as_a_stream(spark, tmp_path):
    """Ends by error and by compose, silence, tokens alone, events after the end and after the trace, null times."""
    schema = "request_id long, seq long, ts timestamp, stage string, status string, is_token boolean"
    files = [
        [(1, 3, 30, "compose", "done", False), (1, 1, 10, "route", "done", False), (2, 2, 20, "rewrite", "error", False), (3, 1, 10, "route", "done", False), (4, 1, 5, "compose", "active", True)],
        [(1, 2, 20, "compose", "active", True), (1, 4, 40, "evaluate1", "done", None), (2, 1, 10, "route", "done", None), (3, 2, 20, "odd", "done", False), (None, 1, 5, "route", "done", False)],
        [(9, 1, 5000, "route", "done", False)],
        [(9, 2, 5001, "rewrite", "done", False), (1, 5, 5001, "compose", "error", False)],  # 1 has been reduced by now
        [(9, 3, 80000, "compose", "done", False)],
        [(9, 4, 80001, "compose", "done", False)],
    ]
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    for rows in files:
        made = spark.createDataFrame([(i, q, s, stage, status, token) for i, q, s, stage, status, token in rows], "request_id long, seq long, at long, stage string, status string, is_token boolean")
        made.select("request_id", "seq", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, at)").alias("ts"), "stage", "status", "is_token").write.mode("append").parquet(folder)
        read = spark.readStream.schema(schema).parquet(folder)
        stages.traces(read, late="10 seconds", settle=60, idle=3600).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    got = {r.request_id: tuple(r)[1:] for r in spark.read.schema(stages.TRACE).parquet(out).collect()}
    got.pop(9, None)
    assert got == {1: (2, "compose", 1, False, True, None, False), 2: (1, "rewrite", 0, True, False, "rewrite", False), 3: (2, "odd", 1, False, False, "route", True)}


def test_traces_of_many_requests_share_the_state_of_a_group(spark, tmp_path):
    """Two rows of state for 60 requests that end or fall silent, as each alone."""
    schema = "request_id long, seq long, ts timestamp, stage string, status string, is_token boolean"
    names, draw = list(trace.STAGES), random.Random(8)
    made = [(i, q, 40 * (i % 3) + q, names[(q - 1) % 9], "error" if draw.random() < 0.1 else "done", draw.random() < 0.2) for i in range(60) for q in range(1, 4 + i % 9)]
    folder, out, checkpoint = (f"file://{tmp_path}/{n}" for n in ("in", "out", "checkpoint"))
    held = []
    for rows in (made[::2], made[1::2], [(-1, 1, 50000, "route", "done", False)], [(-1, 2, 50001, "route", "done", False)]):
        events = spark.createDataFrame(rows, "request_id long, seq long, at long, stage string, status string, is_token boolean")
        events.withColumn("ts", F.expr("timestamp '2024-01-01' + make_interval(0, 0, 0, 0, 0, 0, at)")).select("request_id", "seq", "ts", "stage", "status", "is_token").write.mode("append").parquet(folder)
        read = spark.readStream.schema(schema).parquet(folder)
        query = stages.traces(read, late="200 seconds", groups=2).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        held += [s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]]
    assert 0 < max(held) <= 2
    got = {r.request_id: tuple(r)[1:6] for r in spark.read.schema(stages.TRACE).parquet(out).where("request_id >= 0").collect()}
    events = spark.createDataFrame([r[:2] + r[3:] for r in made], "request_id long, seq long, stage string, status string, is_token boolean")
    assert got == {r.request_id: tuple(r)[1:] for r in trace.reduce_traces(events).collect()}


def test_seeding_shuffles_no_text_to_find_what_it_replaces(spark):
    """Some, none and all of the old rows are replaced; pins and other columns stay; of equal ids the last line counts."""
    namespace = "6ba7b8109dad11d180b400c04fd430c8"
    chunks = spark.createDataFrame([(f"c{k}", f"f{k % 2}.pdf", k, f"text {k}") for k in range(6)] + [("c1", "f1.pdf", 9, "last"), (None, "f1.pdf", 7, "x"), ("c8", "f1.pdf", 8, None)], "chunk_id string, source_file string, line int, chunk_text string")
    empty = {"documents": spark.createDataFrame([], "id string, mod string, file string"), "chunks": spark.createDataFrame([], "id string, document string, text string, chunk_index int"), "embeddings": spark.createDataFrame([], "id string, chunk string, embedding array<float>")}
    first, bad = ingest.seed(chunks, empty, providers.hashed_embedder(), namespace)
    assert sorted((r.text, r.chunk_index) for r in first["chunks"].collect()) == [("last", 5), ("text 0", 0), ("text 2", 1), ("text 3", 1), ("text 4", 2), ("text 5", 2)]
    assert sorted((r.chunk_id or "", r.error) for r in bad.collect()) == [("", "no chunk_id"), ("c8", "no text")]
    ids = {r.text: r.id for r in first["chunks"].collect()}
    held = lambda rows: spark.createDataFrame(rows, "id string, document string, text string, chunk_index int, note string")
    for old, stay in (([(ids["last"], "pinned", "old", 0, "n"), ("other", "d", "stays", 1, "m")], 1), ([("other", "d", "stays", 1, "m")], 1), ([(ids["last"], "pinned", "old", 0, "n")], 0)):
        out = ingest.seed(chunks, empty | {"chunks": held(old)}, providers.hashed_embedder(), namespace, defaults={"chunks": {"note": "new"}})[0]["chunks"]
        assert out.columns == ["id", "document", "text", "chunk_index", "note"]
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert "FullOuter" not in plan and "Window" not in plan and ("LeftAnti" in plan) == (len(old) == 2)
        got = {r.id: tuple(r)[1:] for r in out.collect()}
        assert len(got) == 6 + stay and got.get("other") == (("d", "stays", 1, "m") if stay else None)
        mine = got[ids["last"]]
        assert mine[1:3] == ("last", 5) and (mine[0], mine[3]) == (("pinned", "n") if old[0][0] != "other" else (mine[0], "new"))

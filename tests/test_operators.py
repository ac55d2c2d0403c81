import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import answers, chunking, ingest, kernels, providers, questions, retrieval, topics, trace, transcript, upsert
from lectern.plans.retrieving import NAMESPACE
from lectern.sources import tables
from lectern.streaming import stages


def one(spark, value, make):
    return spark.createDataFrame([(value,)], "x string").select(make(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "n"), [("", 0), ("  ", 0), (" a  b\n", 2), (None, 0)])
def test_words(spark, text, n):
    assert one(spark, text, lambda c: F.coalesce(fn.word_count(c), F.lit(0))) == n


@pytest.mark.parametrize(("ts", "s"), [("01:02:03.5", 3723.5), ("02:03,25", 123.25), ("7", 7.0)])
def test_seconds(spark, ts, s):
    assert one(spark, ts, fn.seconds) == s


def test_uuid5(spark):
    got = spark.range(50).select(F.concat(F.lit("doc::"), "id").alias("n")).select("n", fn.uuid5(F.col("n"), NAMESPACE).alias("u")).collect()
    assert all(r.u == str(uuid.uuid5(uuid.UUID(NAMESPACE), r.n)) for r in got)


def test_repair_escapes(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice('\\"/bnuq a\u0001\u0002') for _ in range(rng.randint(0, 12))) for _ in range(300)]

    def scan(s):
        out, k = [], 0
        while k < len(s):
            if s[k] == "\\" and k + 1 < len(s) and s[k + 1] in '"\\/ bfnrtu':
                out.append(s[k : k + 2])
                k += 2
            else:
                out.append("\\\\" if s[k] == "\\" and k + 1 < len(s) else s[k])
                k += 1
        return "".join(out)

    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", fn.repair_escapes(F.col("x")).alias("y")).collect()
    assert all(r.y == scan(r.x) for r in got)


def test_fences(spark):
    assert json.loads(one(spark, '```json\n{"a": 1}\n```', fn.strip_fences)) == {"a": 1}
    assert one(spark, "```x```", fn.strip_fences) == ""


@pytest.mark.parametrize("length", [0, 49, 50, 999, 1000, 1001, 1800, 1801, 5000])
def test_chunk_count(spark, length):
    docs = spark.createDataFrame([(1, "x" * length)], "doc_id long, text string")
    starts = range(0, max(0, math.ceil((length - 1000) / 800)) * 800 + 1, 800)
    want = 0
    for s in starts:
        if len("x" * length) - s < 50:
            break
        want += 1
    assert chunking.sliding_chunks(docs).count() == want


def test_overlap_must_be_smaller(spark):
    with pytest.raises(ValueError, match="overlap"):
        chunking.sliding_chunks(spark.createDataFrame([(1, "x")], "doc_id long, text string"), 10, 10)


def test_vtt(spark):
    text = "WEBVTT\n\n1\n00:00:01.000 --> 00:00:02.500 align:start\nAnn B: hello\nthere\n\n00:03.000 --> 00:04.000\nno name\n\nnot a cue\n"
    got = transcript.parse_vtt(spark.createDataFrame([("f", text)], "file string, text string")).orderBy("pos").collect()
    assert [(r.cue_id, r.ts_end, r.speaker, r.raw_text) for r in got] == [("1", "00:00:02.500", "Ann B", "hello there"), ("", "00:04.000", "unknown", "no name")]
    assert got[1].ts_start_sec == 3.0


def test_decision_is_order_sensitive(spark):
    for (f, r, c), want in (((0.7, 0.8, 0.9), "reloop"), ((0.9, 0.8, 0.7), "pass"), ((0.95, 0.95, 0.95), "pass")):
        assert one(spark, json.dumps({"f": f, "r": r, "c": c}), lambda x: answers.decide(answers.parse_grade(x), F.lit(True))) == want
    assert one(spark, json.dumps({"f": 1, "r": 1, "c": 1}), lambda x: answers.decide(answers.parse_grade(x), F.lit(False))) == "reloop"


@pytest.mark.parametrize("reply", ["", "no", '{"f": 1}', "```{}```"])
def test_unreadable_grade(spark, reply):
    got = one(spark, reply, answers.parse_grade)
    assert (got.f, got.r, got.c, got.is_fallback) == (0.5, 0.5, 0.5, True)


@pytest.mark.parametrize(("answer", "ok"), [("claim [1] and [7]", False), ("claim [1]", True), ("none", True)])
def test_compliance(spark, answer, ok):
    assert one(spark, answer, lambda c: answers.compliant(c, F.array(F.lit(1)))) is ok


@pytest.mark.parametrize(("q", "topic"), [("What is a confusion matrix?", "confusion-matrix"), ("K-Means", "kmeans"), ("tell me a joke", None)])
def test_topics(spark, q, topic):
    assert one(spark, q, topics.detect) == topic


def test_limit(spark):
    r = spark.range(11).select(F.lit(1).cast("long").alias("key"), F.col("id").cast("double").alias("seconds"), "id")
    assert [x.accepted for x in trace.rate_limit(r).orderBy("id").collect()] == [True] * 10 + [False]


def test_limit_on_odd_rows(spark):
    r = spark.createDataFrame([(None, 1.0, k) for k in range(12)] + [(1, None, 20), (1, 5.0, 21), (1, 5.0, 21)], "key long, seconds double, id long")
    got = [(x.key, x.id, x.accepted) for x in trace.rate_limit(r).orderBy("key", "id").collect()]
    assert got == [(None, k, k < 10) for k in range(12)] + [(1, 20, True), (1, 21, True), (1, 21, True)]
    assert trace.rate_limit(r.limit(0)).count() == 0


def test_batches(spark):
    rows = [("a", 0, 500), ("a", 1, 300), ("a", 2, 1), ("a", 3, 900), ("a", 4, 2), ("b", 0, 900), ("b", 1, 1), ("b", 2, 799)]
    s = spark.createDataFrame(rows, "file string, pos long, word_count long")
    got = transcript.greedy_batches(s).orderBy("file", "pos").collect()
    assert [x.batch for x in got] == [0, 0, 1, 2, 3, 0, 1, 1]


def test_stream_limit_equals_batch(spark, tmp_path):
    rng = random.Random(3)
    t, rows = 0.0, []
    for i in range(400):
        t += rng.random() * 3
        rows.append((rng.randint(1, 3), t, i))
    for n in range(2):  # two micro-batches
        spark.createDataFrame(rows[n * 200 : n * 200 + 200], "key long, seconds double, id long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    batch = {r.id: r.accepted for r in trace.rate_limit(spark.read.parquet(str(tmp_path / "in"))).collect()}
    source = spark.readStream.schema("key long, seconds double, id long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = stages.rate_limit(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    got = {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch


def test_feed(spark, tmp_path):
    spark.createDataFrame([("r", 1, "route", "done", None, None, None)], stages.EVENT).write.json(str(tmp_path / "in"))
    events = spark.readStream.schema(stages.EVENT).json(str(tmp_path / "in"))
    q = stages.feed(events, str(tmp_path / "out"), str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert 'data: {"stage":"route","status":"done"}' in [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"chunk_id": "x", "token_estimate": 3}\n\n{"chunk_id": "y", "retrieval_keywords": ["k"]}\n')
    got = tables.json_lines(spark, str(tmp_path)).orderBy("chunk_id").collect()
    assert [(r.chunk_id, r.token_estimate, r.retrieval_keywords) for r in got] == [("x", 3, None), ("y", None, ["k"])]
    tables.write_json_lines(tables.json_lines(spark, str(tmp_path)), str(tmp_path / "out"))
    assert '"lesson_title":null' in "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.md").write_bytes(b"x\r\ny")
    (tmp_path / "b.txt").write_text("no")
    assert [(r.file, r.text) for r in tables.text_files(spark, str(tmp_path), "*.md").collect()] == [("a.md", "x\ny")]


def test_providers(spark):
    p = spark.createDataFrame([("One. Two.",)], "prompt string")
    assert providers.complete(p, providers.extractive).first().reply == "One [1]."

    def fail(_):
        raise RuntimeError("busy")

    assert providers.complete(p, fail).first().error == "busy"
    v = providers.embed(p.withColumnRenamed("prompt", "text"), providers.hashed_embedder(16), dim=16).first().embedding
    assert abs(sum(x * x for x in v) - 1) < 1e-5


def vectors(spark, n):
    rng = random.Random(5)
    rows = [(k, f"3.{k % 4}", ["pdf", "transcript", "web"][k % 3], f"f{k}.md", f"text {k}", [rng.gauss(0, 1) for _ in range(8)]) for k in range(n)]
    return spark.createDataFrame(rows, "id long, mod string, source_type string, file string, text string, embedding array<double>")


def test_many_with_boost_equals_one_by_one(spark):
    chunks = vectors(spark, 60)
    asked = chunks.where("id < 5").select(F.col("id").alias("qid"), "mod", "embedding")
    got = {(r.qid, r["rank"]): (r.id, r.score) for r in retrieval.top_k_many(chunks, asked, 6, 0.3).collect()}
    for q in asked.collect():
        for r in retrieval.top_k(chunks, q.embedding, 6, q.mod, 0.3).collect():
            assert got[q.qid, r["rank"]] == (r.id, r.score)


def test_questions(spark):
    """Question 1 passes at once, 2 fails its grade and is drafted again over both passes, 3 has no text; 4's model fails."""
    chunks = vectors(spark, 40)
    asked = spark.createDataFrame([(1, "good"), (2, " why cosine similarity "), (3, None), (4, "boom")], "qid long, text string")

    def embedder(texts):
        return [[float(len(t) % 7 + 1), *([1.0] * 7)] for t in texts]

    def completer(prompts):
        out = []
        for p in prompts:
            if p.endswith("boom"):
                raise RuntimeError("busy")
            out.append("fine [1]" if p.endswith("good") else "poor [2] [99]\n## References\n[2] made up")
        return out

    def grader(prompts):
        return ['{"f": 1, "r": 1, "c": 1}' if "fine" in p else "none" for p in prompts]

    got = {r.qid: r for part in ("qid < 4", "qid = 4") for r in questions.answer(asked.where(part), chunks, completer, grader, embedder, dim=8).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1].attempt, got[1].decision, got[1].ok, got[1].mod) == (1, "pass", True, "3.1")
    assert got[1].answer.startswith("fine [1]\n\n## References\n[1] f") and len(got[1].citations) == 1
    assert (got[2].attempt, got[2].decision, got[2].ok, got[2].is_fallback, got[2].mod) == (2, "reloop", False, True, "3.9")
    assert "made up" not in got[2].answer and "[2] f" in got[2].answer and len(got[2].citations) == 1
    assert (got[1].rewritten, got[2].rewritten) == ("good", "why cosine similarity") and got[2].reflection
    assert got[3].attempt == 2 and got[4].attempt == 2 and got[4].answer == "" and got[4].error == "busy"


def test_second_pass_appends_only_unseen(spark):
    row = "qid long, position int, id long"
    first, again = spark.createDataFrame([(1, 1, 7), (1, 2, 5)], row), spark.createDataFrame([(1, 1, 5), (1, 2, 9), (2, 1, 7)], row)
    assert [tuple(r) for r in questions.append_unseen(first, again).select("qid", "position", "id").orderBy("qid", "position").collect()] == [(1, 1, 7), (1, 2, 5), (1, 3, 9), (2, 1, 7)]


def test_numbers_too_large_for_a_rank(spark):
    got = spark.createDataFrame([("a [99999999999] [2]",)], "x string").select(answers.cited(F.col("x")).alias("c"), answers.compliant(F.col("x"), F.array(F.lit(2))).alias("ok")).first()
    assert got.c == [-1, 2] and not got.ok


@pytest.mark.parametrize("ts", ["00:00:0x", "", "a:b", None, "::"])
def test_what_is_no_time(spark, ts):
    assert one(spark, ts, fn.seconds) is None


def test_white_space_is_that_of_python(spark):
    kinds = [chr(c) for c in range(0x3100) if chr(c).isspace()] + ["​", "᠎"]
    texts = [f"{a}{b}x{b}{a}y {a}" for a in kinds for b in (" ", a)]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select("x", fn.strip(F.col("x")).alias("s"), fn.words(F.col("x")).alias("w")).collect()
    assert all(r.s == r.x.strip() and r.w == r.x.split() for r in got)


def test_vectors_that_cannot_be_compared(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 0.0]), (5, [0.6, 0.8])], "id long, embedding array<float>")
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], "qid long, embedding array<float>")
    many = retrieval.top_k_many(chunks, asked, 3).collect()
    assert {(r.qid, r.id, r["rank"]) for r in many} == {(1, 1, 1), (1, 5, 2), (1, 4, 3)}
    assert {(r.id, r["rank"]) for r in retrieval.top_k(chunks, [1.0, 0.0], 3).collect()} == {(1, 1), (5, 2), (4, 3)}
    assert retrieval.top_k_many(chunks, asked.limit(0), 3).collect() == []


def test_many_keep_the_best_of_all_batches(spark):
    rng = random.Random(8)
    vectors = [(k, [float(rng.randint(0, 2)) for _ in range(3)]) for k in range(900)]
    chunks = spark.createDataFrame(vectors, "id long, embedding array<float>").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    try:
        got = {(r.qid, r["rank"]): r.id for r in retrieval.top_k_many(chunks, chunks.where("id < 5").withColumnRenamed("id", "qid"), 7).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for q in range(5):
        want = [r.id for r in retrieval.top_k(chunks, vectors[q][1], 7).orderBy("rank").collect()]
        assert [got[q, n] for n in range(1, 8)] == want


def test_repeated_keys_in_an_upsert(spark):
    old = spark.createDataFrame([(1, "a", 0)], "k int, v string, n int")
    new = spark.createDataFrame([(1, "b", 1), (1, "c", 2), (2, "d", 3), (2, "e", 4), (None, "x", 5)], "k int, v string, n int")
    assert {tuple(r) for r in upsert.upsert(old, new, "k", order="n").collect()} == {(1, "c", 2), (2, "e", 4)}
    assert {tuple(r) for r in upsert.insert_if_absent(old, new, "k", order="n").collect()} == {(1, "a", 0), (2, "d", 3)}
    once = upsert.upsert(old, new, "k", ("v",), "n")
    assert {tuple(r) for r in once.collect()} == {tuple(r) for r in upsert.upsert(once, new, "k", ("v",), "n").collect()} == {(1, "a", 2), (2, "e", 4)}


def test_keywords_are_no_patterns(spark):
    mine = {"c++": (["c++", "a.b("], ["9"])}
    q = spark.createDataFrame([("what is C++",), ("a.b(c)",), ("axb",)], "text string")
    assert [r.t for r in q.select(topics.detect(F.col("text"), mine).alias("t")).collect()] == ["c++", "c++", None]
    assert {(r["mod"], r.n) for r in topics.coverage(q, mine, ["8", "9"]).collect()} == {("8", 0), ("9", 2)}


def test_unknown_compliance_passes_in_both(spark):
    g = F.struct(F.lit(0.9).alias("f"), F.lit(0.9).alias("r"), F.lit(0.9).alias("c"), F.lit(False).alias("is_fallback"))
    none = F.lit(None).cast("boolean")
    r = spark.range(1).select(answers.decide(g, none).alias("d"), answers.verdict(g, none).alias("v")).first()
    assert (r.d, r.v) == ("pass", "PASS")


def test_stream_limit_on_null_times(spark, tmp_path):
    rows = [(1, float(k // 2) if k % 3 else None, k) for k in range(60)]
    spark.createDataFrame(rows, "key long, seconds double, id long").coalesce(1).write.parquet(str(tmp_path / "in"))
    batch = {r.id: r.accepted for r in trace.rate_limit(spark.read.parquet(str(tmp_path / "in"))).collect()}
    source = spark.readStream.schema("key long, seconds double, id long").parquet(str(tmp_path / "in"))
    q = stages.rate_limit(source).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    assert q.awaitTermination(120)
    assert {r.id: r.accepted for r in spark.read.parquet(str(tmp_path / "out")).collect()} == batch
    assert set(batch.values()) == {True, False}


def test_ranges_of_one_value(spark):
    same = spark.createDataFrame([(0.0,), (0.0,)], "v double")
    assert {r.scaled for r in kernels.scaled(same, "v").collect()} == {0.0} and {r.heat for r in kernels.heat(same, "v").collect()} == {0.12}


def test_replies_become_chunks(spark):
    replies = ['```json\n[{"clean_markdown": "a"}, {"clean_markdown": "b"}]\n```', '{"clean_markdown": "one \\alpha"}', "[]", "sorry", "", None, "{broken"]
    df = spark.createDataFrame([(k, r, None) for k, r in enumerate(replies)], "k int, reply string, error string")
    items, failed = ingest.reply_chunks(df, ["k"])
    assert sorted((r.k, r["at"], r["item"].clean_markdown) for r in items.collect()) == [(0, 0, "a"), (0, 1, "b"), (1, 0, "one \\alpha")]
    assert {r.k for r in failed.collect()} == {3, 4, 5, 6}


def test_slides_and_metrics(spark):
    slides = spark.createDataFrame([("a.md", "A"), ("b.md", "B"), ("c.md", "C")], "path string, text string")
    configs = spark.createDataFrame([("3.1", ["b.md", "gone.md", "a.md"]), ("3.2", ["gone.md"])], "module string, slide_md_relatives array<string>")
    assert {tuple(r) for r in ingest.slide_context(slides, configs).collect()} == {("3.1", "B\n\n---\n\nA"), ("3.2", "")}
    seen, metrics = ingest.observed(slides, "slides", empty=F.count_if(F.col("text") == ""))
    seen.collect()
    assert metrics.get == {"n": 3, "empty": 0}
    files = spark.createDataFrame([("x.md", "# T\n<!-- gone -->"), ("y.md", "<!-- all -->")], "file string, text string")
    assert [tuple(r) for r in ingest.cleaned_files(files).collect()] == [("x_cleaned.md", "# T")]


def test_retry_waits_and_models(spark):
    said, waits = [], []

    def model(name, errors):
        def call(batch):
            said.append(name)
            if errors:
                raise RuntimeError(errors.pop(0))
            return [name] * len(batch)

        return call

    gone = "429 RESOURCE_EXHAUSTED quotaValue: '20' GenerateRequestsPerDayPerProject"
    call = providers.with_retry([model("a", ["429 RESOURCE_EXHAUSTED {'retryDelay': '7s'}", "429 slow down", "503 unavailable", gone]), model("b", [])], attempts=6, pause=waits.append)
    assert call(["x"]) == ["b"] and said == ["a", "a", "a", "a", "b"]
    assert waits == [9.0, 8.0, 45.0]  # the asked delay and 2, the second of 4, 8, ..., the third of 15, 30, ...
    assert call(["y"]) == ["b"] and said[5:] == ["b"]  # the model whose day is over isn't asked again
    del waits[:], said[:]
    with pytest.raises(RuntimeError):
        providers.with_retry(model("c", ["e"] * 9), attempts=3, pause=waits.append)(["x"])
    assert waits == [5.0, 5.0] and said == ["c"] * 3
    with pytest.raises(RuntimeError):
        providers.with_retry([model("d", ["quotaValue quota limit: 0"])], pause=waits.append)(["x"])
    assert len(waits) == 2  # no wait helps
    assert providers.named_completer("fast", {"a": providers.extractive}, {"fast": "a"}) is providers.extractive


def test_one_bad_prompt_costs_itself_alone(spark):
    def picky(prompts):
        if any("bad" in p for p in prompts):
            raise ValueError("no")
        return [p.upper() for p in prompts]

    df = spark.createDataFrame([(k, "bad" if k == 5 else f"p{k}") for k in range(20)], "k int, prompt string").coalesce(1)
    got = {r.k: (r.reply, r.error) for r in providers.complete(df, picky).collect()}
    assert got == {k: (None, "no") if k == 5 else (f"P{k}", None) for k in range(20)}


def test_a_bad_prompt_among_many_costs_few_calls():
    calls = []

    def picky(prompts):
        calls.append(len(prompts))
        if 700 in prompts:
            raise ValueError("no")
        return prompts

    got = providers.by_halves(picky, list(range(1000)))
    assert [k for k, (_, e) in enumerate(got) if e] == [700] and len(calls) <= 21
    assert providers.by_halves(lambda p: p[:-1], [1, 2])[0][1] == "0 results for 1 rows"


def test_prose(spark):
    texts = {
        1: "a **b**\n*c* `d` [1] [7]\n\n|x|y|\n|:-:|-|\n|<|2|3|\n|---|\n- p\n* q\n1. r\n## S\n## T\n### U",
        2: "|no|\n|table|",
        3: "",
        4: None,
        5: "####\nend",
        6: "|-|\n|-|",
    }
    rows = [(k, t, [1, 1, None]) for k, t in texts.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, cited array<int>")
    link = '<sup><a href="#source-1" class="cite-ref">[1]</a></sup>'
    cell = lambda tag, side, x: f'<{tag} style="text-align:{side}">{x}</{tag}>'
    table = f'<table class="answer-table"><thead><tr>{cell("th", "center", "x")}{cell("th", "left", "y")}</tr></thead><tbody><tr>{cell("td", "center", "&lt;")}{cell("td", "left", "2")}{cell("td", "left", "3")}</tr><tr>{cell("td", "center", "---")}</tr></tbody></table>'
    whole = [f"<p>a <strong>b</strong> <em>c</em> <code>d</code> {link} [7]</p>", table, '<ul class="answer-list"><li>p</li><li>q</li></ul>', '<ol class="answer-list"><li>r</li></ol>']
    whole += [f'<{h} class="answer-{h}">{x}</{h}>' for h, x in (("h2", "S"), ("h2", "T"), ("h3", "U"))]
    empty = f'<table class="answer-table"><thead><tr>{cell("th", "left", "-")}</tr></thead><tbody></tbody></table>'
    want = {1: "\n".join(whole), 2: "<p>|no| |table|</p>", 3: "", 5: "<p>#### end</p>", 6: empty}
    assert {r.doc_id: r.html for r in answers.prose_html(df).collect()} == want
    assert answers.prose_html(df.limit(0)).count() == 0
    spans = [one(spark, x, answers.math_spans) for x in ("$$a$$ $b$ \\(c\\) \\[d\\]", "$a \\[b\\] c$", "$$$$ $$ x", "$5\n$6", "")]
    assert [tuple(s) for s in spans] == [(2, 2), (0, 1), (0, 0), (0, 0), (0, 0)]


def test_kernels_a_row(spark):
    image = [0.0, 0.1, 0.2, 0.3, 0.5, 0.4, 0.2, 0.1, 0.0, 0.9]
    df = spark.createDataFrame([(1, image), (2, []), (3, None), (4, [0.5] * 4)], "id int, v array<double>")
    got = {r.id: r.y for r in df.select("id", kernels.convolve(F.col("v"), 3, "sharpen").alias("y")).collect()}
    assert got[1] == [*image[:4], 1.0, *image[5:]] and got[2] == [] and got[3] is None and got[4] == [0.5] * 4
    runs = spark.createDataFrame([(1, -0.2, 0.1), (2, None, 0.1)], "id int, w double, rate double")
    path = {r.id: r.p for r in runs.select("id", kernels.optimiser(F.col("w"), F.col("rate"), "sgd", 3).alias("p")).collect()}
    w, plain = -0.2, []
    for _ in range(3):
        w -= 0.1 * (2 * (w - 1.4) + 0.75 * math.cos(5 * w))
        plain.append(w)
    assert path[1] == pytest.approx(plain) and path[2] == [None] * 3


@pytest.mark.parametrize(("q", "route"), [("Bias-Variance", "overfit"), ("what is k?", "knn"), ("make it", None), (None, None), ("", None), ("loss surface of l2", "reg")])
def test_routes_by_pattern(spark, q, route):
    assert one(spark, q, topics.route_by_pattern) == route
    assert one(spark, q, lambda c: topics.route_by_pattern(c, default="none")) == (route or "none")


def test_cards_keep_all_rows_and_their_order(spark):
    rows = spark.createDataFrame([("a", "mine"), ("a", "mine"), ("b", "mine"), (None, "mine")], "topic string, eq string")
    cards = spark.createDataFrame([("a", 2, "y", "second"), ("a", 1, "x", "first"), ("z", 1, "z", None), (None, 1, "n", "n")], "topic string, position int, eq string, note string")
    got = topics.with_cards(rows, cards)
    assert got.columns == ["topic", "eq", "cards"]
    assert sorted(((r.topic or "", [tuple(c) for c in r.cards]) for r in got.collect()), key=repr) == [("", []), ("a", [("x", "first"), ("y", "second")]), ("a", [("x", "first"), ("y", "second")]), ("b", [])]
    assert topics.with_cards(rows, cards.limit(0)).where("size(cards) = 0").count() == 4


def test_files_in_order(spark):
    rows = spark.range(0, 500, 1, 7).select(F.format_string("f%03d", F.pmod(F.col("id") * 77, F.lit(500))).alias("path"), F.lit("mine").alias("_other"))
    got = tables.in_order(rows).collect()
    assert [r.path for r in got] == sorted(r.path for r in got) and [r.position for r in got] == list(range(500)) and got[0]._other == "mine"
    assert tables.in_order(rows.limit(0)).collect() == []

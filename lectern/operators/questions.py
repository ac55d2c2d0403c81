"""Questions answered in batches: route, rewrite, retrieve, reason, reflect, draft, grade, and one retry with a second retrieval.

The rewritten question is what the first pass searches for. Reasoning over the chunks goes into the drafts; reflection on
question, snippets and reasoning says what is missing, and that is what the second pass searches for, else the
rewritten question.

Questions are rows (qid, text), chunks are (id, mod, source_type, file, text, embedding). Models and the embedder are
providers; what they give is written before it is used again, since a second call may say something else. Each
question holds at most FIRST + AGAIN chunks, so its groups are bounded. Null texts are asked as empty ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import strip
from lectern.operators import answers, providers, retrieval, topics
from lectern.sources.tables import staged

FIRST, AGAIN = 8, 6
CONTEXT, GRADED, REASONED = 600, 400, 500
IN_REFLECTION, IN_DRAFT, SNIPPET = 600, 800, 200
ROUTE = "3.1"
#: The levels an answer may have; any other is standard.
LEVELS = ["eli5", "standard", "academia"]


def level(asked: Column) -> Column:
    return F.when(asked.isin(LEVELS), asked).otherwise("standard")


def route(question: Column) -> Column:
    """The first module of the question's topic, else 3.1."""
    return F.coalesce(F.get(topics.modules(topics.detect(question)), F.lit(0)), F.lit(ROUTE))


def weighed(found: DataFrame) -> DataFrame:
    """found (qid, rank, score, source_type, ...) with position: the order of weighted scores of each question."""
    weight = F.coalesce(*(F.when(F.col("source_type") == s, F.lit(w)) for s, w in retrieval.SOURCE_WEIGHTS.items()), F.lit(1.0))
    score = F.round(F.least(F.col("score") * weight, F.lit(1.0)), 6)
    return found.withColumn("weighted", score).withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("weighted"), "rank")))


def contexts(found: DataFrame, limit: int, name: str = "context") -> DataFrame:
    """(qid, context): the numbered chunks of each question."""
    part = F.struct("position", F.format_string("[%d] %s", F.col("position"), F.substring("text", 1, limit)).alias("t"))
    return found.groupBy("qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias(name))


def retrieve(chunks: DataFrame, asked: DataFrame, k: int, boost: float = 0.0) -> DataFrame:
    """(qid, position, id, mod, source_type, file, text, score) of the k best chunks of each question."""
    best = retrieval.top_k_many(chunks, asked, k, boost)
    return weighed(best.join(chunks.drop("embedding"), "id")).select("qid", "position", "id", "mod", "source_type", "file", "text", "score")


def append_unseen(first: DataFrame, again: DataFrame) -> DataFrame:
    """first with those of again behind it that a question hasn't seen."""
    unseen = again.join(first.select("qid", "id"), ["qid", "id"], "left_anti")
    both = first.withColumn("turn", F.lit(1)).unionByName(unseen.select(*first.columns).withColumn("turn", F.lit(2)))
    return both.withColumn("position", F.row_number().over(Window.partitionBy("qid").orderBy("turn", "position"))).drop("turn")


def think(asked: DataFrame, found: DataFrame, reasoner: providers.Completer, reflector: providers.Completer) -> DataFrame:
    """(qid, reasoning, reflection) of questions (qid, text) over the chunks found; a failed reply is an empty one."""
    question = F.concat(F.lit("QUESTION: "), "text")
    prompts = asked.select("qid", "text").join(contexts(found, REASONED), "qid", "left").select("qid", "text", F.concat_ws("\n\n", question, F.concat(F.lit("CHUNKS:\n"), "context")).alias("prompt"))
    reasoned = staged(providers.complete(prompts, reasoner).select("qid", "text", strip(F.coalesce("reply", F.lit(""))).alias("reasoning")), "reasoned")
    body = F.concat_ws("\n\n", question, F.concat(F.lit("CHUNK SNIPPETS:\n"), "context"), F.concat(F.lit("REASONING:\n"), F.substring("reasoning", 1, IN_REFLECTION)))
    prompts = reasoned.join(contexts(found, SNIPPET), "qid", "left").select("qid", "reasoning", body.alias("prompt"))
    return staged(providers.complete(prompts, reflector).select("qid", "reasoning", strip(F.coalesce("reply", F.lit(""))).alias("reflection")), "reflected")


def draft(asked: DataFrame, found: DataFrame, attempt: int, completer: providers.Completer, grader: providers.Completer) -> DataFrame:
    """For questions (qid, text, reasoning): (qid, attempt, answer, citations, f, r, c, is_fallback, ok, decision, verdict, error): one answer to each question and its grade."""
    prompts = asked.join(contexts(found, CONTEXT), "qid", "left").select("qid", F.concat_ws("\n\n", "context", F.concat(F.lit("Reasoning: "), F.substring("reasoning", 1, IN_DRAFT)), F.concat(F.lit("Question: "), "text")).alias("prompt"))
    said = staged(providers.complete(prompts, completer).select("qid", F.coalesce("reply", F.lit("")).alias("answer"), "error"), f"drafts-{attempt}")
    marks = answers.resolve(said.select(F.col("qid").alias("doc_id"), "answer"), found.select(F.col("qid").alias("doc_id"), F.col("position").alias("rank"), "file", "mod", "id"))
    full = answers.rebuild(said.select(F.col("qid").alias("doc_id"), "answer"), marks).withColumnRenamed("doc_id", "qid")
    cited = marks.groupBy(F.col("doc_id").alias("qid")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"]).alias("citations"))
    known = found.groupBy("qid").agg(F.array_sort(F.collect_set("position")).alias("known"))
    judged = said.select("qid", F.col("answer").alias("said"), "error").join(full, "qid").join(cited, "qid", "left").join(known, "qid", "left").join(contexts(found, GRADED, "seen"), "qid", "left")
    none = F.array().cast("array<int>")
    judged = judged.withColumn("ok", answers.compliant(F.col("said"), F.coalesce("known", none)))
    judged = judged.withColumn("prompt", F.concat_ws("\n\n", "seen", F.concat(F.lit("Answer: "), "said")))
    graded = staged(providers.complete(judged.withColumnRenamed("error", "failure"), grader), f"grades-{attempt}").withColumn("g", answers.parse_grade(F.col("reply")))
    return graded.select(
        "qid", F.lit(attempt).alias("attempt"), "answer", F.coalesce("citations", F.array().cast("array<bigint>")).alias("citations"), "g.*", "ok",
        answers.decide(F.col("g"), F.col("ok")).alias("decision"), answers.verdict(F.col("g"), F.col("ok"), attempt > 1).alias("verdict"), F.coalesce("failure", "error").alias("error"),
    )


def answer(questions: DataFrame, chunks: DataFrame, completer: providers.Completer, grader: providers.Completer, embedder: providers.Embedder, dim: int = 64, rewriter: providers.Completer = providers.plain_question, reasoner: providers.Completer = providers.extractive, reflector: providers.Completer = providers.key_words) -> DataFrame:
    """The final answer to each question: the first draft if it passes, else a second one over the chunks of both passes."""
    asked = questions.select("qid", F.btrim(F.coalesce("text", F.lit(""))).alias("text")).withColumn("mod", route(F.col("text")))
    told = providers.complete(asked, rewriter, "text").select("qid", "mod", F.col("text").alias("question"), F.coalesce(F.nullif(strip(F.col("reply")), F.lit("")), "text").alias("text"))
    told = staged(providers.embed(told, embedder, dim=dim), "questions")
    asked = told.select("qid", "mod", F.col("question").alias("text"), F.col("text").alias("rewritten"))
    first = staged(retrieve(chunks, told.select("qid", "mod", "embedding"), FIRST, retrieval.BOOST), "first-pass")
    asked = asked.join(think(asked, first, reasoner, reflector), "qid")
    one = staged(draft(asked, first, 1, completer, grader), "attempt-1")
    redo = asked.join(one.where("decision = 'reloop'").select("qid"), "qid", "left_semi")
    sought = F.coalesce(F.nullif("reflection", F.lit("")), "rewritten")
    again = staged(providers.embed(redo.select("qid", "mod", sought.alias("text")), embedder, dim=dim), "reflections")
    both = staged(append_unseen(first.join(again.select("qid"), "qid", "left_semi"), retrieve(chunks, again, AGAIN)), "second-pass")
    two = draft(redo, both, 2, completer, grader)
    last = one.where("decision = 'pass'").unionByName(two)
    return last.join(asked.select("qid", "mod", "rewritten", "reflection"), "qid")

"""Stage events of requests: reduction to traces, failures, rate limits, caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.operators.folds import fold

#: The stages in order, with the delay of a canned replay in milliseconds.
STAGES = {"route": 300, "rewrite": 400, "retrieve1": 800, "react": 600, "reflect": 500, "evaluate1": 700, "retrieve2": 900, "evaluate2": 700, "compose": 1200}
WINDOW_SECONDS, MOST_REQUESTS = 60, 10


def reduce_traces(events: DataFrame) -> DataFrame:
    """(request_id, n_events, last_stage, active_index, failed, finished): token events don't count, an error or compose/done ends."""
    real = events.where(~F.coalesce(F.col("is_token"), F.lit(False)))
    ends = (F.col("status") == "error") | ((F.col("stage") == "compose") & (F.col("status") == "done"))
    end = real.where(ends).groupBy("request_id").agg(F.min("seq").alias("end_seq"))
    kept = real.join(end, "request_id", "left").where(F.col("end_seq").isNull() | (F.col("seq") <= F.col("end_seq")))
    error = F.col("status") == "error"
    return kept.groupBy("request_id").agg(F.count_if(~error).alias("n_events"), F.max_by("stage", "seq").alias("last_stage"), (F.count_if(~error) - 1).alias("active_index"), F.bool_or(error).alias("failed"), F.bool_or((F.col("stage") == "compose") & (F.col("status") == "done")).alias("finished"))


def last_evaluation(events: DataFrame) -> DataFrame:
    return events.where(F.col("stage").startswith("evaluate") & F.col("score").isNotNull()).groupBy("request_id").agg(F.max_by("score", "seq").alias("score"), F.max_by("stage", "seq").alias("stage"))


def next_stage(stage: Column) -> Column:
    """The stage that runs after one that is done: where a failure belongs."""
    names = list(STAGES)
    return F.coalesce(*(F.when(stage == a, F.lit(b)) for a, b in zip(names, names[1:], strict=False)), F.when(stage == names[-1], F.lit(names[-1])), F.lit(names[0]))


def failure_stage(events: DataFrame) -> DataFrame:
    """(request_id, failed_stage) of requests with an error: the stage after the last one that was done before it."""
    error = events.where("status = 'error'").groupBy("request_id").agg(F.min("seq").alias("error_seq"))
    done = events.where("status = 'done'").join(error, "request_id").where("seq < error_seq").groupBy("request_id").agg(F.max_by("stage", "seq").alias("stage"))
    return error.join(done, "request_id", "left").select("request_id", next_stage(F.col("stage")).alias("failed_stage"))


def stage_class(status: Column, verdict: Column) -> Column:
    return F.when(status == "active", "active").when((status == "done") & F.coalesce(verdict.startswith("BELOW"), F.lit(False)), "reloop").when(status == "done", "done").otherwise("pending")


def error_label(detail: Column) -> Column:
    return F.when(detail.contains("RateLimitError"), "rate limit").when(detail.contains("InvalidAPIKey") | detail.contains("invalid_api_key"), "api key").otherwise(F.concat(F.lit("Pipeline error: "), F.coalesce(detail, F.lit("unknown"))))


def server_sent(event: Column) -> Column:
    """One event as a server-sent line; null fields are left out."""
    return F.concat(F.lit("data: "), F.to_json(event), F.lit("\n\n"))


def rate_limit(requests: DataFrame, window: int = WINDOW_SECONDS, most: int = MOST_REQUESTS) -> DataFrame:
    """(key, id, accepted) of requests (key, seconds, id): a sliding log of at most `most` times, where a rejected request leaves no trace.

    A fold for each key in the order of (seconds, id). A request without a time is accepted and leaves no trace.
    """

    def step(log: tuple[float, ...] | None, t: float | None) -> tuple[tuple[float, ...], bool]:
        if t is None:
            return log or (), True
        held = tuple(x for x in log or () if t - x <= window)
        return ((*held, t), True) if len(held) < most else (held, False)

    asked = requests.select("key", F.col("seconds").cast("double").alias("seconds"), F.col("id").cast("long").alias("id"))
    return fold(asked, "key", ["seconds", "id"], "seconds", step, "accepted", "boolean").select("key", "id", "accepted")


def answer_cache(answers: DataFrame) -> DataFrame:
    """The last answer of each question by difficulty."""
    return answers.groupBy("question").pivot("difficulty", ["eli5", "standard", "academia"]).agg(F.max_by("answer", "seq"))


def lit_edges(events: DataFrame, edges: list[tuple[str, str]]) -> DataFrame:
    """(request_id, from_stage, to_stage, lit) of every request and edge: lit if the request has come to the edge's end, by the stages seen, not by how many."""
    ends = sorted({b for _, b in edges})
    seen = events.groupBy("request_id").agg(F.collect_set(F.when(F.col("stage").isin(ends), F.col("stage"))).alias("seen"))  # a few names
    each = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in edges)))
    return seen.select("request_id", "seen", each.alias("e")).select("request_id", F.col("e.a").alias("from_stage"), F.col("e.b").alias("to_stage"), F.array_contains("seen", F.col("e.b")).alias("lit"))


def replay(events: DataFrame, delays: dict[str, int] = STAGES) -> DataFrame:
    """events (request_id, seq, stage, ...) with at_ms: when a canned replay shows each, by the summed delays of its request."""
    delay = F.coalesce(*(F.when(F.col("stage") == s, F.lit(ms)) for s, ms in delays.items()), F.lit(0)).cast("long")
    return events.withColumn("at_ms", F.sum(delay).over(Window.partitionBy("request_id").orderBy("seq")))  # the events of one request


def error_event(detail: Column) -> Column:
    """The server-sent line of a failed request."""
    return server_sent(F.struct(F.lit("error").alias("stage"), F.lit("error").alias("status"), detail.alias("detail")))


def percent(share: Column) -> Column:
    """A share as a whole percentage; halves go up."""
    return F.floor(share * 100 + 0.5).cast("long")


def day_theme(ts: Column, hours: int = 8) -> Column:
    """light from 7 to 18 hours of the local day, else dark."""
    local = F.hour(ts + F.expr(f"interval {hours} hours"))
    return F.when(local.between(7, 18), "light").otherwise("dark")


def stamp(ts: Column, hours: int = 8) -> Column:
    return F.date_format(ts + F.expr(f"interval {hours} hours"), "yyyyMMdd_HHmmss")

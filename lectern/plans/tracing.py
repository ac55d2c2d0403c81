"""Stage events and rate limits: events stand for both, a user is a request or a client."""

from pyspark.sql import functions as F

from lectern.operators import retrieval, trace
from lectern.plans.registry import registry
from lectern.sources import tables
from lectern.sources.tables import shared_path, table
from lectern.streaming import stages

QUERIES, ORACLE, query = registry()
NAMES = list(trace.STAGES)
LIST = "[" + ", ".join(f"'{s}'" for s in NAMES) + "]"

EVENTS = f"""n as (select *, row_number() over (partition by user_id order by ts, event_id) as seq from events),
s as (select user_id as request_id, seq, {LIST}[((seq - 1) % 9 + 1)::int] as stage, case when event_type = 'error' and event_id % 5 = 0 then 'error' when event_id % 13 = 0 then 'active' else 'done' end as status,
 case when event_id % 3 = 0 then 'BELOW 0.80' else 'PASS' end as verdict, event_type = 'view' and event_id % 2 = 0 as is_token, value as score from n)"""


def staged(spark, sf_dir, *more):
    """Events in order of (ts, event_id) walk through the stages."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "events").withColumn("seq", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long"))
    i, kind = F.col("event_id"), F.col("event_type")
    stage = F.element_at(F.array(*map(F.lit, NAMES)), ((F.col("seq") - 1) % 9 + 1).cast("int"))
    status = F.when((kind == "error") & (i % 5 == 0), "error").when(i % 13 == 0, "active").otherwise("done")
    return e.select(F.col("user_id").alias("request_id"), "seq", stage.alias("stage"), status.alias("status"), F.when(i % 3 == 0, "BELOW 0.80").otherwise("PASS").alias("verdict"), ((kind == "view") & (i % 2 == 0)).alias("is_token"), F.col("value").alias("score"), *more)


@query(f"""with {EVENTS}, r as (select * from s where not is_token), e as (select request_id, min(seq) as end_seq from r where status = 'error' or (stage = 'compose' and status = 'done') group by request_id),
k as (select r.* from r left join e using (request_id) where end_seq is null or seq <= end_seq)
select request_id, count(*) filter (where status <> 'error') as n_events, max_by(stage, seq) as last_stage, count(*) filter (where status <> 'error') - 1 as active_index, bool_or(status = 'error') as failed, bool_or(stage = 'compose' and status = 'done') as finished from k group by request_id""")
def trace_reduce(spark, sf_dir):
    return trace.reduce_traces(staged(spark, sf_dir))


@query(f"with {EVENTS} select request_id, max_by(score, seq) as score, max_by(stage, seq) as stage from s where starts_with(stage, 'evaluate') and score is not null group by request_id")
def last_eval(spark, sf_dir):
    return trace.last_evaluation(staged(spark, sf_dir))


@query(f"""with {EVENTS}, e as (select request_id, min(seq) as es from s where status = 'error' group by request_id), d as (select s.request_id, max_by(stage, seq) as stage from s join e using (request_id) where status = 'done' and seq < es group by s.request_id)
select e.request_id, case when stage is null then 'route' else {LIST}[least(9, list_position({LIST}, stage) + 1)::int] end as failed_stage from e left join d using (request_id)""")
def failure_stage(spark, sf_dir):
    return trace.failure_stage(staged(spark, sf_dir))


@query(f"with {EVENTS} select request_id, seq, case when status = 'active' then 'active' when status = 'done' and starts_with(verdict, 'BELOW') then 'reloop' when status = 'done' then 'done' else 'pending' end as class from s")
def stage_class(spark, sf_dir):
    return staged(spark, sf_dir).select("request_id", "seq", trace.stage_class(F.col("status"), F.col("verdict")).alias("class"))


@query("select event_id, case when contains(d, 'RateLimitError') then 'rate limit' when contains(d, 'invalid_api_key') then 'api key' else 'Pipeline error: ' || d end as label from (select event_id, case event_id % 3 when 0 then 'RateLimitError: slow down' when 1 then 'invalid_api_key' else event_type end as d from events)")
def error_labels(spark, sf_dir):
    i = F.col("event_id") % 3
    detail = F.when(i == 0, "RateLimitError: slow down").when(i == 1, "invalid_api_key").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", trace.error_label(detail).alias("label"))


@query("""with recursive n as (select user_id, event_id, epoch_us(ts) / 1e6 / 100 as t, row_number() over (partition by user_id order by ts, event_id) as rn from events),
r as (select user_id, event_id, rn, [t] as log, true as accepted from n where rn = 1 union all
 select n.user_id, n.event_id, n.rn, case when len(list_filter(r.log, lambda x: n.t - x <= 60)) < 10 then list_append(list_filter(r.log, lambda x: n.t - x <= 60), n.t) else list_filter(r.log, lambda x: n.t - x <= 60) end, len(list_filter(r.log, lambda x: n.t - x <= 60)) < 10 from r join n on n.user_id = r.user_id and n.rn = r.rn + 1)
select user_id as key, event_id as id, accepted from r""")
def rate_limit(spark, sf_dir):
    """Time runs a hundred times as fast, so that the limit is met."""
    e = table(spark, sf_dir, "events")
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 100
    return trace.rate_limit(e.select(F.col("user_id").alias("key"), seconds.alias("seconds"), F.col("event_id").alias("id")))


@query("""select user_id as question, max_by(event_type, event_id) filter (where event_id % 3 = 0) as eli5, max_by(event_type, event_id) filter (where event_id % 3 = 1) as standard, max_by(event_type, event_id) filter (where event_id % 3 = 2) as academia from events group by user_id""")
def answer_cache_pivot(spark, sf_dir):
    i = F.col("event_id") % 3
    level = F.when(i == 0, "eli5").when(i == 1, "standard").otherwise("academia")
    return trace.answer_cache(table(spark, sf_dir, "events").select(F.col("user_id").alias("question"), level.alias("difficulty"), F.col("event_type").alias("answer"), F.col("event_id").alias("seq")))


@query(f"""with {EVENTS} select request_id, seq, 'data: {{"stage":"' || stage || '","status":"' || status || '"' || case when status = 'done' then ',"verdict":"' || verdict || '"' else '' end || '}}' || chr(10) || chr(10) as line from s""")
def server_sent_events(spark, sf_dir):
    s = staged(spark, sf_dir)
    event = F.struct("stage", "status", F.when(F.col("status") == "done", F.col("verdict")).alias("verdict"))
    return s.select("request_id", "seq", trace.server_sent(event).alias("line"))


@query(f"""with {EVENTS}, d as (select request_id, list(distinct stage) as seen from s where status = 'done' group by request_id), x as (select unnest(range(1, 9)) as i)
select request_id, {LIST}[i] as from_stage, {LIST}[i + 1] as to_stage, list_contains(seen, {LIST}[i + 1]) as lit from d, x""")
def lit_edges(spark, sf_dir):
    return trace.lit_edges(staged(spark, sf_dir).where("status = 'done'"), list(zip(NAMES, NAMES[1:], strict=False)))


@query(f"""with {EVENTS}, r as (select * from s where not is_token), e as (select request_id, min(seq) as end_seq from r where status = 'error' or (stage = 'compose' and status = 'done') group by request_id),
k as (select r.*, end_seq from r left join e using (request_id) where end_seq is null or seq <= end_seq),
t as (select request_id, count(*) filter (where status <> 'error') as n_events, max_by(stage, seq) as last_stage, count(*) filter (where status <> 'error') - 1 as active_index, bool_or(status = 'error') as failed, bool_or(stage = 'compose' and status = 'done') as finished, max_by(stage, seq) filter (where status = 'done') as done, bool_and(end_seq is null) as silent from k group by request_id)
select request_id, n_events, last_stage, active_index, failed, finished, case when not failed and not silent then null when done is null then 'route' else {LIST}[least(9, list_position({LIST}, done) + 1)::int] end as failed_stage, silent from t""")
def streamed_traces(spark, sf_dir):
    """The events as a stream of files that hold them in no order; a last event long after lets all requests be reduced."""
    numbered = staged(spark, sf_dir, F.col("ts").cast("timestamp").alias("ts")).select("request_id", "seq", "ts", "stage", "status", "is_token")
    rows = tables.staged(numbered, "numbered")  # sorted once, not for each part
    folder, out, checkpoint = (shared_path(spark, n) for n in ("events", "traces", "traces-checkpoint"))
    late = spark.sql("select -1L as request_id, 1L as seq, timestamp '2100-01-01' as ts, 'route' as stage, 'done' as status, false as is_token")
    for k in range(5):
        part = rows.where(F.pmod(F.xxhash64("request_id", "seq"), F.lit(3)) == k) if k < 3 else late.withColumn("seq", F.lit(k).cast("long"))
        part.write.mode("append").parquet(folder)
        read = spark.readStream.schema(rows.schema).parquet(folder)
        # the months of the table are one batch's lateness here
        stages.traces(read, late="365 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stages.TRACE).parquet(out).where("request_id >= 0")


@query("select event_id, coalesce(json_extract_string(props, '$.timestamp_start'), json_extract_string(props, '$.k')) as ts from (select event_id, case when event_id % 5 = 0 then 'no json' when event_id % 3 = 0 then '{\"timestamp_start\":\"00:0' || event_id % 10 || ':00\",\"k\":1}' else props end as props from events where event_id % 5 <> 0) union all select event_id, null from events where event_id % 5 = 0")
def json_locators(spark, sf_dir):
    """Metadata of three kinds: with a time, with another key alone, and no JSON."""
    i = F.col("event_id")
    timed = F.concat(F.lit('{"timestamp_start":"00:0'), (i % 10).cast("string"), F.lit(':00","k":1}'))
    e = table(spark, sf_dir, "events").select("event_id", F.when(i % 5 == 0, "no json").when(i % 3 == 0, timed).otherwise(F.col("props")).alias("props"))
    return e.select("event_id", retrieval.locator(F.col("props"), "timestamp_start", "k").alias("ts"))

"""Slides and transcripts to chunks by way of a stand-in model, and chunks to tables."""

import json

from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import ingest, providers, trace, transcript
from lectern.plans.ingesting import LONG, SPOKEN, cues, segments
from lectern.plans.registry import registry
from lectern.plans.retrieving import NAMESPACE
from lectern.sources.tables import staged, table

QUERIES, ORACLE, query = registry()

PAGES = "p as (select doc_id, unnest(string_split(text, chr(10))) as text, generate_subscripts(string_split(text, chr(10)), 1) as page from documents)"


def pages(spark, sf_dir):
    """Lines stand for pages."""
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", F.col("page") + 1)


@query(f"with {PAGES} select doc_id, string_agg('<!-- page ' || page || ' -->' || chr(10) || text, chr(10) || chr(10) order by page) as text from p group by doc_id")
def page_marks(spark, sf_dir):
    return ingest.page_marks(pages(spark, sf_dir))


def first_words(prompts: list[str]) -> list[str]:
    """A stand-in model: each batch is two chunks, the first hundred characters and the first twenty, fenced."""
    plain = ["".join(c if c.isascii() and (c.isalnum() or c == " ") else " " for c in p) for p in prompts]
    item = lambda t, page: {"topic": "t", "lesson_title": "L", "page_number": page, "clean_markdown": t, "retrieval_keywords": t.split()[:2], "sample_questions": []}
    return ["```json\n" + json.dumps([item(p[:20], 0), item(p[:100], 3)]) + "\n```" for p in plain]


SLIDES = r"""p as (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') as p from documents),
b as (select doc_id, b::int as batch, array_to_string(p[b * 10 + 1:b * 10 + 10], chr(10) || chr(10)) as text from (select *, unnest(range(0, ceil(len(p) / 10)::int)) as b from p)),
t as (select doc_id, batch, regexp_replace(text, '[^a-zA-Z0-9 ]', ' ', 'g') as t from b), u as (select doc_id, batch, unnest([0, 1]) as place, unnest([left(t, 20), left(t, 100)]) as t from t),
n as (select *, row_number() over (partition by doc_id order by batch, place) as n, trim(t) as m, list_filter(string_split(t, ' '), lambda x: x <> '')[1:2] as k from u),
slides as (select doc_id, n::int as n, 'lesson_' || doc_id || '_LEC01_' || lpad(n::varchar, greatest(4, length(n::varchar))::int, '0') as chunk_id, 'Lesson ' || doc_id || '.pdf' as source_file, case when place = 1 then 3 end as page_number,
  m || case when len(k) > 0 then chr(10) || chr(10) || 'Keywords: ' || array_to_string(k, ', ') else '' end as chunk_text from n where length(m) >= 30)"""


def lessons(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("Lesson "), "doc_id").alias("file"), F.replace("text", F.lit("\n"), F.lit("\n<!-- page 1 -->\n")).alias("text"))


@query(f"with {SLIDES} select doc_id, n, chunk_id, source_file, page_number, chunk_text, greatest(1, length(chunk_text) // 4)::bigint as token_estimate from slides")
def slide_chunks(spark, sf_dir):
    return ingest.slide_chunks(lessons(spark, sf_dir), first_words)[0].select("doc_id", "n", "chunk_id", "source_file", "page_number", "chunk_text", "token_estimate")


CONFIGURED = LONG.replace("from conversations)", "from conversations), kept as (select * from cues where ts_start_sec >= 40 and not ts_start_sec between 200 and 240)").replace("from cues window", "from kept window")


def configs(spark, sf_dir):
    """A config for each conversation: the lecture starts at 40 s, a notebook is open from 200 to 240 s."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("source_file")).distinct()
    return c.select("source_file", F.concat(F.lit("3."), F.col("source_file") % 10).alias("module"), F.lit("L").alias("lesson_title"), F.lit(40.0).alias("lecture_start_sec"), F.array(F.lit("ASSIST")).alias("teaching_speakers"), F.array(F.array(F.lit(200.0), F.lit(240.0))).alias("notebook_periods"), F.array(F.lit("b.md"), F.lit("none.md"), F.lit("a.md")).alias("slide_md_relatives"))


@query(f"with {CONFIGURED} select file, pos, speaker, segment_type, merged_text, word_count from long")
def configured_segments(spark, sf_dir):
    return ingest.configured_segments(cues(spark, sf_dir), configs(spark, sf_dir)).select("file", "pos", "speaker", "segment_type", "merged_text", "word_count")


def last_sentence(prompts: list[str]) -> list[str]:
    """A stand-in model: one object a batch with the first 300 characters of its last segment; no topic in every other batch."""
    body = [p.rsplit("]\n", 1)[-1][:300] for p in prompts]
    return [json.dumps({"topic": "even" if len(t) % 2 == 0 else "odd", "clean_markdown": t, "timestamp_start": ""}) for t in body]


@query("""with recursive %s, n as (select *, row_number() over (partition by file order by pos) as rn from long),
r as (select file, pos, rn, word_count as s, 0::bigint as batch from n where rn = 1 union all select n.file, n.pos, n.rn, case when r.s + n.word_count > 800 then n.word_count else r.s + n.word_count end, case when r.s + n.word_count > 800 then r.batch + 1 else r.batch end from r join n on n.file = r.file and n.rn = r.rn + 1),
h as (select file, batch, min_by(floor(ts_start_sec)::bigint, pos) as a, min_by(segment_type, pos) as kind, left(max_by(merged_text, pos), 300) as t from r join long using (file, pos) group by file, batch),
k as (select * from h where len(list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '')) >= 15 and length(t) %% 2 = 0)
select file, row_number() over (partition by file order by batch)::int as n, lpad((a // 3600)::varchar, 2, '0') || ':' || lpad((a %% 3600 // 60)::varchar, 2, '0') || ':' || lpad((a %% 60)::varchar, 2, '0') as timestamp_start, kind as segment_type, regexp_replace(t, '^\\s+|\\s+$', '', 'g') as chunk_text from k""" % LONG)
def transcript_chunks(spark, sf_dir):
    s = segments(spark, sf_dir)
    contexts = s.select("file").distinct().withColumn("context", F.lit("slides"))
    vocabulary = spark.createDataFrame([("even",)], "topic string")
    return ingest.transcript_chunks(ingest.transcript_prompts(s, contexts), last_sentence, topics=vocabulary)[0].select("file", "n", "timestamp_start", "segment_type", "chunk_text")


@query("select conv_id, turn, regexp_matches(lower(text), '%s') as enters, regexp_matches(lower(text), '%s') as leaves from (select conv_id, turn, case turn %% 3 when 0 then 'Let me GO to the notebook ' when 1 then 'so we go back to the slide ' else '' end || text as text from conversations)" % ("|".join(transcript.ENTRY), "|".join(transcript.EXIT)))
def notebook_phrases(spark, sf_dir):
    lead = F.when(F.col("turn") % 3 == 0, "Let me GO to the notebook ").when(F.col("turn") % 3 == 1, "so we go back to the slide ").otherwise("")
    return transcript.phrase_flags(table(spark, sf_dir, "conversations").select("conv_id", "turn", F.concat(lead, "text").alias("raw_text"))).select("conv_id", "turn", "enters", "leaves")


@query("select source as file, min(doc_id) as first from documents group by source")
def first_seen(spark, sf_dir):
    return ingest.first_seen(table(spark, sf_dir, "documents").select(F.col("source").alias("file"), "doc_id"), "file", "doc_id")


def seeded(spark, sf_dir):
    """Documents as chunks of their sources, every seventh without a text, over empty tables; the second run finds the first one's rows."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("chunk_text"))
    empty = {
        "documents": spark.createDataFrame([], "id string, mod string, file string"),
        "chunks": spark.createDataFrame([], "id string, document string, text string, chunk_index int"),
        "embeddings": spark.createDataFrame([], "id string, chunk string, embedding array<float>"),
    }
    first, _ = ingest.seed(chunks, empty, providers.hashed_embedder(), NAMESPACE)
    return ingest.seed(chunks, {k: staged(v, k) for k, v in first.items()}, providers.hashed_embedder(), NAMESPACE)


def _uuid(name: str) -> str:
    h = f"substr(sha1(unhex('{NAMESPACE}') || ({name})::blob), 1, 32)"
    return f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-5' || substr({h}, 14, 3) || '-' || lower(to_hex((('0x' || substr({h}, 17, 1))::int & 3) | 8)) || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)"


@query(f"""with c as (select *, (row_number() over (partition by source order by doc_id) - 1)::int as chunk_index from documents)
select {_uuid("'chunk::c' || doc_id")} as id, {_uuid("'doc::' || source || '.pdf'")} as document, text, chunk_index from c where doc_id % 7 <> 0""")
def seed_chunks(spark, sf_dir):
    return seeded(spark, sf_dir)[0]["chunks"]


@query(f"""select {_uuid("'emb::c' || doc_id")} as id, {_uuid("'chunk::c' || doc_id")} as chunk, true as unit from documents where doc_id % 7 <> 0""")
def seed_embeddings(spark, sf_dir):
    length = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return seeded(spark, sf_dir)[0]["embeddings"].select("id", "chunk", (F.abs(length - 1) < 1e-5).alias("unit"))


@query("select 'c' || doc_id as chunk_id, 'no text' as error from documents where doc_id % 7 = 0")
def seed_errors(spark, sf_dir):
    return seeded(spark, sf_dir)[1].select("chunk_id", "error")


@query("select count(*) filter (where length(text) >= 20) as ok, count(*) filter (where length(text) < 20) as errors, round(count(*) / 10.0::double, 6) as rate, round((2 * count(*) - count(*)) * 10.0::double / count(*), 6) as eta from (select left(d.text, 15 + (doc_id % 9)::int) as text from embeddings e join documents d on e.vec_id = d.doc_id)")
def reindex_progress(spark, sf_dir):
    """Vectors made anew by an embedder that refuses short texts; a rate for ten seconds."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("chunk"), "embedding")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", F.lit(1), (15 + F.col("doc_id") % 9).cast("int")).alias("text"))

    def embed(given: list[str]) -> list[list[float]]:
        if any(len(t) < 20 for t in given):
            raise ValueError("too short")
        return [[1.0] + [0.0] * 63 for _ in given]

    done = staged(ingest.reindex(e, texts, embed), "reindexed")
    return ingest.progress(done, 10.0, 2 * done.count())


REQUESTS = "r as (select event_id, case event_id % 4 when 0 then 'eli5' when 1 then 'standard' when 2 then 'Academia' end as difficulty, case event_id % 3 when 0 then 'local' else event_type end as backend from events)"


def requests(spark, sf_dir):
    i = F.col("event_id")
    level = F.when(i % 4 == 0, "eli5").when(i % 4 == 1, "standard").when(i % 4 == 2, "Academia")
    return table(spark, sf_dir, "events").select("event_id", level.alias("difficulty"), F.when(i % 3 == 0, "local").otherwise(F.col("event_type")).alias("backend"))


@query(f"with {REQUESTS} select event_id, case when difficulty is null or difficulty not in ('eli5', 'standard', 'academia') then 'difficulty' else 'backend' end as reason from r where difficulty is null or difficulty not in ('eli5', 'standard', 'academia') or backend not in ('local', 'view')")
def refused_requests(spark, sf_dir):
    return ingest.validate(requests(spark, sf_dir), {"difficulty": ["eli5", "standard", "academia"], "backend": ["local", "view"]})[1].select("event_id", "reason")


@query(f"with {REQUESTS} select event_id, case when difficulty = 'eli5' then 'plain words' else 'textbook' end as tone, case when difficulty = 'eli5' then 0 else 1 end as equations from r")
def answer_tones(spark, sf_dir):
    tones = spark.createDataFrame([("eli5", "plain words", 0), ("standard", "textbook", 1)], "difficulty string, tone string, equations int")
    return ingest.lookup(requests(spark, sf_dir), tones, "difficulty", "standard").select("event_id", "tone", "equations")


@query("select doc_id, text from documents order by source, doc_id limit 5")
def first_rows(spark, sf_dir):
    return ingest.sample(table(spark, sf_dir, "documents"), ["source", "doc_id"]).select("doc_id", "text")


@query("select doc_id, floor((quality + toxic * 0.335 + doc_id % 7 / 7.0) / 3 * 100 + 0.5)::bigint as percent from labels")
def mean_percent(spark, sf_dir):
    l = table(spark, sf_dir, "labels")
    return l.select("doc_id", trace.percent((F.col("quality") + F.col("toxic") * 0.335 + F.col("doc_id") % 7 / 7.0) / 3).alias("percent"))


@query("select event_id, case when extract(hour from ts + interval 8 hour) between 7 and 18 then 'light' else 'dark' end as theme, strftime(ts + interval 8 hour, '%Y%m%d_%H%M%S') as stamp from events")
def local_time(spark, sf_dir):
    ts = F.col("ts")
    return table(spark, sf_dir, "events").select("event_id", trace.day_theme(ts).alias("theme"), trace.stamp(ts).alias("stamp"))


@query("select event_id, (sum(case event_type when 'view' then 300 when 'click' then 900 else 0 end) over (partition by user_id order by ts, event_id))::bigint as at_ms from events where event_type in ('view', 'click')")
def replay_times(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type in ('view', 'click')")
    return trace.replay(e.select(F.col("user_id").alias("request_id"), F.struct("ts", "event_id").alias("seq"), F.when(F.col("event_type") == "view", "route").otherwise("retrieve2").alias("stage"), "event_id")).select("event_id", "at_ms")


@query("""select event_id, 'data: {"stage":"error","status":"error","detail":"' || event_type || '"}' || chr(10) || chr(10) as line from events where event_type = 'error'""")
def error_events(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return e.select("event_id", trace.error_event(F.col("event_type")).alias("line"))


@query(r"""with t as (select turn, conv_id, case conv_id % 2 when 0 then chr(9) || '  ' else '' end || text as text from conversations) select conv_id, turn, trim(regexp_replace('""" + SPOKEN + r"""' || text, '\s+', ' ', 'g')) as text from t""")
def squeezed_text(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    lead = F.when(F.col("conv_id") % 2 == 0, "\t  ").otherwise("")
    return c.select("conv_id", "turn", fn.strip(F.regexp_replace(F.concat(F.lit(SPOKEN), lead, "text"), f"{fn.SPACE}+", " ")).alias("text"))

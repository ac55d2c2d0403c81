"""Work that comes in parts and can be resumed: streamed replies, a ledger of model calls, versioned tables."""

from pyspark.sql import functions as F

from lectern.operators import ingest, ledger, providers, trace
from lectern.plans.registry import registry
from lectern.plans.seeding import NAMESPACE, _uuid
from lectern.sources import replies
from lectern.sources.tables import shared_path, staged, table
from lectern.sources.versions import VersionedTable
from lectern.streaming import stages

QUERIES, ORACLE, query = registry()

REPLIES = """p as (select doc_id, text, coalesce(contains(text, '.'), false) as good, list_filter(string_split(string_split(text, '.')[1], ' '), lambda x: x <> '') as w from documents),
t as (select doc_id, good, text is null as nothing, case when text is null then [] when good then w else w[1:1] end as w from p),
r as (select doc_id as request_id, (i - 1)::bigint as seq, 'token' as kind, null as stage, null as status, null as detail, w[i] as token from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from t)
 union all select doc_id, len(w), case when good then 'event' else 'error' end, 'compose', case when good then 'done' else 'error' end, case when nothing then 'no prompt' when not good then 'no sentence' end, null from t
 union all select doc_id, len(w) + 1, 'done', null, null, null, null from t)"""


def streamed(spark, sf_dir):
    """The documents as requests that come in three parts; each part is streamed into a table before the next comes."""
    spark.dataSource.register(replies.Replies)
    asked = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt"), F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("part"))
    requests, out, checkpoint = (shared_path(spark, n) for n in ("requests", "replies", "replies-checkpoint"))
    for k in range(3):
        made = shared_path(spark, "arriving")
        asked.where(F.col("part") == k).select("request_id", "prompt").write.parquet(made)
        _arrive(spark, made, requests, k)
        read = spark.readStream.format("replies").option("path", requests).load()
        read.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(replies.RECORD).parquet(out)


def _arrive(spark, made: str, folder: str, k: int) -> None:
    """Moves the Parquet files of `made` into `folder` under names that rise."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.FileSystem.get(jvm.Path(folder).toUri(), spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(folder))
    for n, status in enumerate(s for s in fs.listStatus(jvm.Path(made)) if s.getPath().getName().startswith("part-")):
        fs.rename(status.getPath(), jvm.Path(f"{folder}/{k:04d}-{n:05d}.parquet"))


@query(f"with {REPLIES} select request_id, seq, kind, stage, status, detail, token from r")
def streamed_replies(spark, sf_dir):
    return streamed(spark, sf_dir)


@query(f"""with {REPLIES}, e as (select request_id, seq, case when kind = 'token' then 'compose' else stage end as stage, case when kind = 'token' then 'active' else status end as status, detail, token from r where kind <> 'done')
select request_id, seq, 'data: {{"stage":"' || stage || '","status":"' || status || '"' || case when detail is not null then ',"detail":"' || detail || '"' else '' end || case when token is not null then ',"token":' || to_json(token)::varchar else '' end || '}}' || chr(10) || chr(10) as line from e""")
def streamed_lines(spark, sf_dir):
    """Server-sent lines of replies read in one batch."""
    spark.dataSource.register(replies.Replies)
    requests = shared_path(spark, "requests")
    table(spark, sf_dir, "documents").select(F.col("doc_id").alias("request_id"), F.col("text").alias("prompt")).write.parquet(requests)
    events = stages.stage_events(spark.read.format("replies").option("path", requests).load())
    return events.select("request_id", "seq", trace.server_sent(F.struct("stage", "status", "detail", "token")).alias("line"))


def _never(prompts: list[str]) -> list[str]:
    raise ValueError("asked again")


@query(r"select doc_id, case when text is null then null else regexp_replace(string_split(text, '.')[1], '^\s+|\s+$', '', 'g') || ' [1].' end as reply, case when text is null then 'no prompt' end as error from documents")
def resumed_replies(spark, sf_dir):
    """Half of the documents are asked in a first run; the second asks the others, and a third, whose model would fail, asks none."""
    path = shared_path(spark, "ledger")
    prompts = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"))
    staged(ledger.ask(prompts.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0), providers.extractive, path, "stand-in").select("doc_id", "reply", "error"), "first-run")
    staged(ledger.ask(prompts, providers.extractive, path, "stand-in").select("doc_id", "reply", "error"), "second-run")
    return ledger.ask(prompts, _never, path, "stand-in").select("doc_id", "reply", "error")


@query("""with had as (select distinct source from documents where doc_id % 2 = 0 and source < 'src5') select source, doc_id, case when source in (select source from had) then 'kept' else 'made' end as origin
from documents where (source in (select source from had) and doc_id % 2 = 0) or source not in (select source from had)""")
def merged_chunks(spark, sf_dir):
    """Chunks of some sources from a run before, and of all from this one."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id")
    old = d.where("doc_id % 2 = 0 and source < 'src5'").withColumn("origin", F.lit("kept"))
    return ledger.merge_new(old, d.withColumn("origin", F.lit("made")), "source")


CHUNKS, DOCUMENTS, EMBEDDINGS = "id string, document string, text string, chunk_index int", "id string, mod string, file string", "id string, chunk string, embedding array<float>"


def seeded_tables(spark, sf_dir):
    """Documents as chunks, seeded in two slices, a column added, and seeded again."""
    d = table(spark, sf_dir, "documents")
    chunks = d.select(F.concat(F.lit("c"), "doc_id").alias("chunk_id"), F.concat("source", F.lit(".pdf")).alias("source_file"), F.col("doc_id").alias("line"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("chunk_text"))
    root = shared_path(spark, "seeded-tables")
    tables = {n: VersionedTable(spark, f"{root}/{n}", c) for n, c in (("documents", DOCUMENTS), ("chunks", CHUNKS), ("embeddings", EMBEDDINGS))}
    ingest.seed_tables(chunks, tables, providers.hashed_embedder(), NAMESPACE, slices=2)
    tables["chunks"].add_column("language", "string", "en")
    failed = ingest.seed_tables(chunks, tables, providers.hashed_embedder(), NAMESPACE)
    return tables, failed


@query(f"""with c as (select *, (row_number() over (partition by source order by doc_id) - 1)::int as chunk_index from documents),
r as (select {_uuid("'chunk::c' || doc_id")} as id, {_uuid("'doc::' || source || '.pdf'")} as document, text, chunk_index from c where doc_id % 7 <> 0)
select v as version, id, document, text, chunk_index, 'en' as language from r, (values (2), (4)) as x(v)""")
def seeded_versions(spark, sf_dir):
    """The chunks after the first seeding, under the newest columns, and after the second."""
    chunks = seeded_tables(spark, sf_dir)[0]["chunks"]
    return chunks.read(2, newest_columns=True).withColumn("version", F.lit(2)).unionByName(chunks.read().withColumn("version", F.lit(4)))


@query(f"""select {_uuid("'emb::c' || doc_id")} as id, case when length(text) < 200 then 'old' else 'new' end as vector from documents where doc_id % 7 <> 0""")
def reindexed_table(spark, sf_dir):
    """Embeddings that a re-index overwrites with one-hot vectors, by an embedder that refuses short texts."""
    tables, _ = seeded_tables(spark, sf_dir)

    def embed(given: list[str]) -> list[list[float]]:
        if any(len(t) < 200 for t in given):
            raise ValueError("too short")
        return [[2.0] + [0.0] * 63 for _ in given]

    ingest.reindex_table(tables["embeddings"], tables["chunks"].read(), embed)
    return tables["embeddings"].read().select("id", F.when(F.col("embedding")[0] == 2, "new").otherwise("old").alias("vector"))

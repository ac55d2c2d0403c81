"""Retrieval over embeddings joined to documents: vec_id is the document, label stands for the module."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import module_of, route_label, slugify, uuid5
from lectern.operators import chunking, index, retrieval
from lectern.plans.registry import registry
from lectern.sources.tables import shared_path, table

QUERIES, ORACLE, query = registry()
#: Fixed value: the namespace of our document keys.
NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"

CHUNKS = """c as (select e.vec_id as id, '3.' || (e.label + 1) as mod, d.source as file, d.text, left(d.text, 200) as snip, e.embedding,
  case substr(d.source, 4)::int % 3 when 0 then 'pdf' when 1 then 'textbook' else 'transcript' end as source_type from embeddings e join documents d on e.vec_id = d.doc_id),
q as (select embedding as qe from embeddings where vec_id = {q}),
s as (select c.*, round(list_cosine_similarity(embedding::double[], (select qe from q)::double[]), 6) as score from c)"""


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.substring("source", 4, 10).cast("int") % 3
    e, d = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents")
    joined = e.join(d, e["vec_id"] == d["doc_id"])
    return joined.select(F.col("vec_id").alias("id"), F.concat(F.lit("3."), F.col("label") + 1).alias("mod"), F.col("source").alias("file"), "text", F.substring("text", 1, 200).alias("snip"), "embedding", F.when(kind == 0, "pdf").when(kind == 1, "textbook").otherwise("transcript").alias("source_type"))


def vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where(F.col("vec_id") == vec_id).first()["embedding"])


@query(f"with {CHUNKS.format(q=0)} select id, mod, score, row_number() over (order by score desc, id) as rank from s order by score desc, id limit 8")
def vector_topk(spark, sf_dir):
    return retrieval.top_k(chunks(spark, sf_dir), vector(spark, sf_dir, 0), 8).select("id", "mod", "score", "rank")


BOOSTED = "f as (select *, row_number() over (order by round(score + case when mod = '3.4' then 0.15 else 0 end, 6) desc, id) as rank from s qualify rank <= 8)"


@query(f"with {CHUNKS.format(q=1)}, {BOOSTED} select id, mod, file, snip, score, rank from f")
def vector_topk_boosted(spark, sf_dir):
    return retrieval.top_k(chunks(spark, sf_dir), vector(spark, sf_dir, 1), 8, "3.4").select("id", "mod", "file", "snip", "score", "rank")


MANY = """with q as (select vec_id as qid, embedding as qe from embeddings where vec_id % 20 = 0)
select qid, vec_id as id, round(list_cosine_similarity(embedding::double[], qe::double[]), 6) as score, row_number() over (partition by qid order by round(list_cosine_similarity(embedding::double[], qe::double[]), 6) desc, vec_id) as rank
from embeddings, q qualify rank <= 8"""


@query(MANY)
def vector_topk_multi(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return retrieval.top_k_many(e, e.where("id % 20 = 0").withColumnRenamed("id", "qid"), 8)


@query(MANY)
def indexed_topk(spark, sf_dir):
    """The same by way of an index that is built first."""
    e, path = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), shared_path(spark, "index")
    index.build(e, path, lists=32)
    return index.search(spark, path, e.where("id % 20 = 0").withColumnRenamed("id", "qid"), 8)


WEIGHED = "w as (select *, round(least(score * case source_type when 'pdf' then 1.2::double when 'textbook' then 1.2::double when 'transcript' then 0.9::double else 1::double end, 1::double), 6) as weighted from f), g as (select *, row_number() over (order by weighted desc, rank) as new_rank from w)"


@query(f"with {CHUNKS.format(q=0)}, {BOOSTED}, {WEIGHED} select id, mod, source_type, snip, score, weighted, new_rank from g")
def source_weighted_rerank(spark, sf_dir):
    return retrieval.weigh(retrieval.top_k(chunks(spark, sf_dir), vector(spark, sf_dir, 0), 8, "3.4")).select("id", "mod", "source_type", "snip", "score", "weighted", "new_rank")


@query(f"""with {CHUNKS.format(q=0)}, {BOOSTED}, {WEIGHED}, s2 as (select c.*, round(list_cosine_similarity(embedding::double[], (select embedding from embeddings where vec_id = 3)::double[]), 6) as score from c),
f2 as (select *, row_number() over (order by score desc, id) as rank from s2 qualify rank <= 6),
w2 as (select *, row_number() over (order by round(least(score * case source_type when 'pdf' then 1.2::double when 'textbook' then 1.2::double when 'transcript' then 0.9::double else 1::double end, 1::double), 6) desc, rank) as new_rank from f2)
select id, pass, row_number() over (order by pass, new_rank) as position from (select id, 1 as pass, new_rank from g union all select id, 2, new_rank from w2 where id not in (select id from g))""")
def two_pass_retrieve(spark, sf_dir):
    c = chunks(spark, sf_dir)
    first = retrieval.weigh(retrieval.top_k(c, vector(spark, sf_dir, 0), 8, "3.4"))
    again = retrieval.weigh(retrieval.top_k(c, vector(spark, sf_dir, 3), 6))
    return retrieval.second_pass(first, again).select("id", "pass", "position")


@query(f"with {CHUNKS.format(q=2)}, {BOOSTED} select array_to_string(list_sort(list(distinct mod)), ', ') as modules from f")
def module_summary(spark, sf_dir):
    return retrieval.module_summary(retrieval.top_k(chunks(spark, sf_dir), vector(spark, sf_dir, 2), 8, "3.4"))


@query(f"with {CHUNKS.format(q=0)}, {BOOSTED} select string_agg('[' || rank || '] ' || left(text, 500), chr(10) || chr(10) order by rank) as context from f")
def context_build(spark, sf_dir):
    return retrieval.context(retrieval.top_k(chunks(spark, sf_dir), vector(spark, sf_dir, 0), 8, "3.4"), 500)


@query(" union all ".join(f"select '{t}' as name, count(*) as n from {t}" for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")))
def table_counts(spark, sf_dir):
    out = None
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        one = table(spark, sf_dir, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.unionAll(one)
    return out


@query("select d.doc_id, count(e.vec_id) as n_chunks from documents d left join embeddings e on e.vec_id = d.doc_id group by d.doc_id")
def chunks_per_document(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").select("vec_id")
    return d.join(e, d["doc_id"] == e["vec_id"], "left").groupBy("doc_id").agg(F.count("vec_id").alias("n_chunks"))


@query("select d.source, d.doc_id, e.label from documents d join embeddings e on e.vec_id = d.doc_id where e.label = 3 order by d.source, d.doc_id limit 10 offset 10")
def browse_page(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "embeddings").select("vec_id", "label").where("label = 3")
    return d.join(e, d["doc_id"] == e["vec_id"]).select("source", "doc_id", "label").orderBy("source", "doc_id").offset(10).limit(10)


@query("select count(*) as n from documents d join embeddings e on e.vec_id = d.doc_id where e.label = 3")
def browse_count(spark, sf_dir):
    d, e = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "embeddings").where("label = 3")
    return d.join(e, d["doc_id"] == e["vec_id"]).agg(F.count("*").alias("n"))


FILE = "'3.' || (substr(source, 4)::int + 1) || ' - ' || lang || ' Lesson_' || doc_id || '.md'"


def files(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("3."), F.substring("source", 4, 10).cast("int") + 1, F.lit(" - "), "lang", F.lit(" Lesson_"), "doc_id", F.lit(".md"))
    return table(spark, sf_dir, "documents").select("doc_id", name.alias("file"), "text")


@query(f"select doc_id, regexp_extract({FILE}, '^\\s*(\\d+\\.\\d+)', 1) as mod, regexp_replace(regexp_replace(lower({FILE}), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') as slug from documents")
def derive_module(spark, sf_dir):
    return files(spark, sf_dir).select("doc_id", module_of(F.col("file")).alias("mod"), slugify(F.col("file")).alias("slug"))


@query("""with t as (select doc_id, '3.' || (doc_id % 12) || case when doc_id % 3 = 0 then 'x' else '' end || ' because' as reply from documents)
select doc_id, case when regexp_matches(split_part(reply, ' ', 1), '^3\\.\\d+$') then split_part(reply, ' ', 1) else '3.1' end as route from t""")
def route_validate(spark, sf_dir):
    reply = F.concat(F.lit("3."), F.col("doc_id") % 12, F.when(F.col("doc_id") % 3 == 0, "x").otherwise(""), F.lit(" because"))
    return table(spark, sf_dir, "documents").select("doc_id", route_label(reply).alias("route"))


@query(f"""with h as (select doc_id, substr(sha1(unhex('{NAMESPACE}') || ('doc::' || doc_id)::blob), 1, 32) as h from documents)
select doc_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || lower(to_hex((('0x' || substr(h, 17, 1))::int & 3) | 8)) || substr(h, 18, 3) || '-' || substr(h, 21, 12) as uuid from h""")
def uuid5_keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", uuid5(F.concat(F.lit("doc::"), F.col("doc_id").cast("string")), NAMESPACE).alias("uuid"))


@query(f"""with w as (select doc_id, unnest(range(0, (greatest(0, ceil((length(text) - 1000) / 800)) + 1)::int)) as k, text, {FILE} as file from documents),
c as (select doc_id, k, file, regexp_replace(substr(text, k * 800 + 1, 1000), '^\\s+|\\s+$', '', 'g') as c from w), s as (select *, min(case when length(c) < 50 then k end) over (partition by doc_id) as stop from c)
select doc_id, k::int as chunk_index, regexp_replace(regexp_replace(lower(file), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') || '_LEC01_' || lpad((k + 1)::varchar, greatest(4, length((k + 1)::varchar))::int, '0') as chunk_id from s where stop is null or k < stop""")
def chunk_ids(spark, sf_dir):
    f = files(spark, sf_dir)
    named = chunking.sliding_chunks(f).join(f.select("doc_id", slugify(F.col("file")).alias("slug")), "doc_id")
    return chunking.number_chunks(named, F.col("slug"), "LEC01").select("doc_id", "chunk_index", "chunk_id")

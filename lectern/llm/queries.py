"""Queries of this subpackage over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import conversation_repair, decontaminate, licenses, line_dedup, ngram_join, packing, pseudo_likelihood, quality, quality_classifier, toxicity, url_filter, warc, whitening
from lectern.llm.base import table


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP1 = r"""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
s as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) >= 2),
m as (select k.doc_id, k.pos, k.line, s.first is not null and k.doc_id > s.first as dropped from k left join s using (key))
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not dropped), '')) as kept_sha256 from m group by doc_id"""


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"), licenses.known_licenses(spark)).select("doc_id", "canonical_sha256", "license_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents")).drop("host_rate")


OP3 = r"""with w as (select doc_id, source, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
g as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as win from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
d as (select doc_id, i from (select *, count(*) over (partition by doc_id, win) as n from g) where n >= 2),
r as (select doc_id, count(distinct j) as n_repeat_words from (select doc_id, unnest([i, i + 1, i + 2]) as j from d) group by doc_id),
m as (select w.doc_id, source, len(w)::bigint as n_words, coalesce(length(array_to_string(w, '')), 0)::bigint as word_chars, (length(t) - length(translate(t, '#*$%&|<>', '')))::bigint as n_symbols,
  len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))::bigint as n_lines,
  (len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))))::bigint as n_dup_lines,
  coalesce(n_repeat_words, 0)::bigint as n_repeat_words from w left join r on w.doc_id = r.doc_id),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from m),
f as (select source, unnest([0, 1, 2, 3]) as rule, unnest([n_words < 50, 100 * n_repeat_words > 50 * n_words, 10 * n_symbols > n_words, 100 * n_dup_lines > 30 * n_lines]) as failed from b),
h as (select source, rule, count(*) as n, count(*) filter (where failed) as f from f group by source, rule),
a as (select rule, round(sum(f) / sum(n), 9) as mean from h group by rule),
p as (select rule, mean, case when sum(n) - sum(n * n)::double / sum(n) > 0 then round((sum(n * (f / n - mean) * (f / n - mean)) - (count(*) - 1) * mean * (1 - mean)) / (sum(n) - sum(n * n)::double / sum(n)), 12) else 0 end as v from h join a using (rule) group by rule, mean),
q as (select rule, mean, case when v > 0 and mean > 0 and mean < 1 then least(greatest(mean * (1 - mean) / v - 1, 1.0), 1e6) else 1e6 end as s from p),
x as (select source, max(round((f + mean * s) / (n + s), 9)) as rate from h join q using (rule) group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and rate <= 0.5 as kept from b join x on b.source is not distinct from x.source"""


def url_entries(pages: DataFrame) -> DataFrame:
    """A dated list by rule, which grows with the hosts of pages: some hosts blocked for 60 days or allowed, some parents blocked."""
    day = lambda n: F.date_add(F.lit("2024-01-01").cast("date"), n)
    code = lambda c: F.conv(F.substring(F.md5(c), 1, 6), 16, 10).cast("int")
    hosts = pages.select(url_filter.host(F.col("url")).alias("h")).where("h is not null").distinct().withColumn("k", code(F.col("h")))
    parents = hosts.where("instr(h, '.') > 0").select(F.expr("substring(h, instr(h, '.') + 1)").alias("h")).distinct().withColumn("k", code(F.col("h")))
    entry = lambda df, action, event, since: df.select(F.col("h").alias("entry"), F.lit(action).alias("action"), F.lit(event).alias("event"), since.alias("since"))
    k = F.col("k")
    blocked, allowed = hosts.where("k % 3 = 0"), hosts.where("k % 3 = 1")
    return entry(blocked, "block", "add", day(k % 180)).unionAll(entry(blocked, "block", "remove", day(k % 180 + 60))).unionAll(entry(allowed, "allow", "add", day(k % 100))).unionAll(entry(parents, "block", "add", day(k % 300)))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched", F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 366).cast("int")))
    return url_filter.judge(captures, url_entries(pages)).select("page_id", "host", F.col("fetched").cast("string").alias("fetched"), "matched_entry", "blocked")


OP4 = r"""with p as (select page_id, nullif(lower(regexp_extract(url, '^(?i)https?://(?:[^/?#@]*@)?([^/?#:\\@]+)', 1)), '') as host, date '2024-01-01' + (page_id % 366)::int as fetched from pages),
h as (select distinct host as h from p where host is not null),
hk as (select h, ('0x' || substr(md5(h), 1, 6))::int as k from h),
pk as (select h, ('0x' || substr(md5(h), 1, 6))::int as k from (select distinct substr(h, instr(h, '.') + 1) as h from h where instr(h, '.') > 0)),
e as (select h as entry, 'block' as action, 'add' as event, date '2024-01-01' + k % 180 as since from hk where k % 3 = 0 union all select h, 'block', 'remove', date '2024-01-01' + (k % 180 + 60) from hk where k % 3 = 0
  union all select h, 'allow', 'add', date '2024-01-01' + k % 100 from hk where k % 3 = 1 union all select h, 'block', 'add', date '2024-01-01' + k % 300 from pk),
l as (select entry, since, max(struct_pack(event := event, action := action)) as e from e group by entry, since),
i as (select entry, e.action as action, since, until from (select *, lead(since) over (partition by entry order by since) as until from l) where e.event = 'add'),
a as (select page_id, i.entry, i.action, row_number() over (partition by page_id order by length(i.entry) desc) as rn from p join i on (host = entry or ends_with(host, '.' || entry)) and fetched >= since and (until is null or fetched < until))
select p.page_id, host, fetched::varchar as fetched, a.entry as matched_entry, coalesce(a.action = 'block', false) as blocked from p left join a on p.page_id = a.page_id and rn = 1"""


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, model).select("doc_id", "severity", "expected_severity", "p_toxic", F.col("rejected").alias("toxic"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


OP7 = """with p as (select page_id, coalesce(html, '') as h from pages), f as (select h, min(page_id) as first from p where strlen(h) >= 100 group by h)
select page_id, strlen(p.h) as payload_bytes, sha256(p.h) as payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type, case when first <> page_id then first end as refers_to from p left join f on p.h = f.h"""


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudo_likelihood.score_documents(table(spark, sf_dir, "documents"))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "copies")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = decontaminate.verdicts(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return judged.select("doc_id", "contaminated", "item_ids", "similarity")


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    laid = table(spark, sf_dir, "embeddings").select("vec_id", whitening.lattice(F.col("embedding")).alias("x"))
    return whitening.whiten(laid, "x", whitening.fit_whitening(laid, "x"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = conversation_repair.damage(table(spark, sf_dir, "conversations"))
    return conversation_repair.conversations(conversation_repair.repair(damaged, F.col("absent")))


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.classify(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return judged.select("doc_id", "held_out", "score", "predicted")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_line_dedup, op2_license_scan, op3_quality_rules, op4_url_filter, op5_toxicity, op6_packing, op7_warc, op8_lm_scoring, op9_ngram_join, op10_decontaminate, op11_embedding_whitening, op12_conversation_repair, op13_quality_classifier)
}
ORACLE: dict[str, str] = {"op1_line_dedup": OP1, "op2_license_scan": licenses.scan_sql(), "op3_quality_rules": OP3, "op4_url_filter": OP4, "op7_warc": OP7}

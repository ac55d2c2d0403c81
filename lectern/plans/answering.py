"""Answers and grades: documents with marks stand for answers, labels for grades."""

from pyspark.sql import functions as F

from lectern.operators import answers, providers, questions, topics, upsert
from lectern.plans.registry import registry
from lectern.sources.tables import staged, table

QUERIES, ORACLE, query = registry()

ANSWERS = "a as (select doc_id, text || ' [' || (doc_id % 9 + 1) || '] and [' || (doc_id % 4 + 1) || ']. ' || case when doc_id % 3 = 0 then chr(10) || '## References' || chr(10) || '[1] made up' else '' end as answer from documents)"
CHUNKS = "c as (select d.doc_id, k as rank, '3.' || k as mod, d.source || '-' || k || '.md' as file from documents d, (select unnest([1, 2, 3, 4, 5, 6]) as k))"


def answered(spark, sf_dir):
    end = F.when(F.col("doc_id") % 3 == 0, "\n## References\n[1] made up").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", F.concat("text", F.lit(" ["), F.col("doc_id") % 9 + 1, F.lit("] and ["), F.col("doc_id") % 4 + 1, F.lit("]. "), end).alias("answer"))


def chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"))
    return d.select("doc_id", "rank", F.concat(F.lit("3."), "rank").alias("mod"), F.concat("source", F.lit("-"), "rank", F.lit(".md")).alias("file"))


BARE = r"regexp_replace(regexp_replace(answer, '(?is)\n#{1,3}\s*(References|Sources)\b.*', ''), '\s+$', '')"
MARKS = r"list_sort(list_distinct(list_transform(regexp_extract_all(answer, '\[(\d+)\]', 1), lambda x: x::int)))"


@query(f"with {ANSWERS} select doc_id, {BARE} as answer from a")
def strip_references(spark, sf_dir):
    return answered(spark, sf_dir).select("doc_id", answers.strip_references(F.col("answer")).alias("answer"))


@query(f"with {ANSWERS}, {CHUNKS}, m as (select doc_id, unnest({MARKS}) as rank from a) select doc_id, rank, file, mod from m join c using (doc_id, rank)")
def citations(spark, sf_dir):
    return answers.resolve(answered(spark, sf_dir), chunks(spark, sf_dir)).select("doc_id", "rank", "file", "mod")


@query(f"with {ANSWERS}, {CHUNKS}, m as (select doc_id, unnest({MARKS}) as rank from a) select doc_id, rank as id, round((doc_id % 10 + rank) / 20.0, 6)::double as score from m join c using (doc_id, rank)")
def answer_sources(spark, sf_dir):
    scored = chunks(spark, sf_dir).withColumn("score", F.round((F.col("doc_id") % 10 + F.col("rank")) / 20, 6))
    return answers.sources(answers.resolve(answered(spark, sf_dir), scored))


@query(f"with {ANSWERS} select doc_id, {MARKS} as cited, len(list_filter({MARKS}, lambda x: x not in (1, 2, 3, 4, 5, 6))) = 0 as compliant from a")
def citation_compliance(spark, sf_dir):
    known = F.sequence(F.lit(1), F.lit(6))
    return answered(spark, sf_dir).select("doc_id", answers.cited(F.col("answer")).alias("cited"), answers.compliant(F.col("answer"), known).alias("compliant"))


@query(f"""with {ANSWERS}, {CHUNKS}, m as (select doc_id, unnest({MARKS}) as rank from a), b as (select doc_id, string_agg('[' || rank || '] ' || file || ' (module ' || mod || ')', chr(10) order by rank) as block from m join c using (doc_id, rank) group by doc_id)
select doc_id, {BARE} || coalesce(chr(10) || chr(10) || '## References' || chr(10) || block, '') as answer from a left join b using (doc_id)""")
def rebuild_references(spark, sf_dir):
    a = answered(spark, sf_dir)
    return answers.rebuild(a, answers.resolve(a, chunks(spark, sf_dir)))


GRADES = """g as (select doc_id, case when doc_id % 11 = 0 then 'no grade' else '{"f": ' || (quality * 0.3 + 0.6 + doc_id % 3 * 0.05)::decimal(4, 2) || ', "r": ' || (1 - toxic * 0.4)::decimal(4, 2) || ', "c": ' || ((doc_id % 5) * 0.3)::decimal(4, 2) || '}' end as reply, doc_id % 7 <> 0 as ok from labels),
p as (select doc_id, ok, doc_id % 11 = 0 as is_fallback, case when doc_id % 11 = 0 then 0.5 else least(1, json_extract(reply, '$.f')::double) end as f, case when doc_id % 11 = 0 then 0.5 else least(1, json_extract(reply, '$.r')::double) end as r, case when doc_id % 11 = 0 then 0.5 else least(1, json_extract(reply, '$.c')::double) end as c from g)"""


def graded(spark, sf_dir):
    two = lambda c: c.cast("decimal(4,2)")
    i = F.col("doc_id")
    reply = F.concat(F.lit('{"f": '), two(F.col("quality") * 0.3 + 0.6 + i % 3 * 0.05), F.lit(', "r": '), two(1 - F.col("toxic") * 0.4), F.lit(', "c": '), two(i % 5 * 0.3), F.lit("}"))
    return table(spark, sf_dir, "labels").select("doc_id", (i % 7 != 0).alias("ok"), answers.parse_grade(F.when(i % 11 == 0, "no grade").otherwise(reply)).alias("g"))


@query(f"with {GRADES} select doc_id, f::double as f, r::double as r, c::double as c, is_fallback from p")
def grade_parse(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", "g.*")


@query(f"with {GRADES} select doc_id, case when (f + r + c) / 3 >= 0.80 and ok then 'pass' else 'reloop' end as decision from p")
def pass_or_reloop(spark, sf_dir):
    return graded(spark, sf_dir).select("doc_id", answers.decide(F.col("g"), F.col("ok")).alias("decision"))


@query(f"""with {GRADES}, m as (select *, (f + r + c) / 3 as m from p) select doc_id, case when is_fallback then 'EVAL BACKEND UNAVAILABLE — stub score, not a real grade — ' else '' end || case when m >= 0.80 and ok then 'PASS' when not ok then 'BELOW 0.80 (' || printf('%.2f', m) || ') — citation compliance failed, reloop' else 'BELOW 0.80 (' || printf('%.2f', m) || '), reloop' end as verdict_1,
case when is_fallback then 'EVAL BACKEND UNAVAILABLE — stub score, not a real grade — ' else '' end || case when m >= 0.80 and ok then 'PASS' when not ok then printf('%.2f', m) || ' — citation compliance failed, proceeding to compose' else printf('%.2f', m) || ' — proceeding to compose' end as verdict_2 from m""")
def verdicts(spark, sf_dir):
    g = graded(spark, sf_dir)
    return g.select("doc_id", answers.verdict(F.col("g"), F.col("ok")).alias("verdict_1"), answers.verdict(F.col("g"), F.col("ok"), True).alias("verdict_2"))


@query("select doc_id as request_id, case when quality = 0 or toxic = 1 then 2 else 1 end as attempt, 'draft ' || case when quality = 0 or toxic = 1 then 2 else 1 end as answer from labels")
def final_answer_once(spark, sf_dir):
    again = (F.col("quality") == 0) | (F.col("toxic") == 1)
    tries = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("request_id"), F.explode(F.when(again, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))).alias("attempt"))
    return answers.final_once(tries.withColumn("answer", F.concat(F.lit("draft "), "attempt")))


@query("""with c as (select distinct on (conv_id) conv_id, text from conversations where role = 'user' order by conv_id, turn)
select conv_id, regexp_matches(lower(text), 'adequate|sufficient|covered') as adequate from c""")
def reflection_adequacy(spark, sf_dir):
    first = table(spark, sf_dir, "conversations").where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", answers.adequate(F.col("text")).alias("adequate"))


PROSE = r"t as (select doc_id, '| a<b | **c** |' || chr(10) || case doc_id % 3 when 0 then '|---|--:|' when 1 then 'x' else '|:-:|' end || chr(10) || '| 1 | [2] | 3 |' || chr(10) || '- *one* [1]' || chr(10) || '- two [9]' || chr(10) || ' - three' || chr(10) || '1. `x<y`' || chr(10) || '### Head [2]' || chr(10) || '#### no head' || chr(10) || chr(10) || coalesce(text, '') as text from documents)"
LINES = r"""l as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as pos from t),
i as (select *, regexp_matches(line, '^\|.*\|') as r, count(*) filter (where not regexp_matches(line, '^\|.*\|')) over (partition by doc_id order by pos) as isle, coalesce(regexp_matches(lead(line) over (partition by doc_id order by pos), '^\|[-:| ]+\|'), false) as under from l),
j as (select *, r and bool_or(r and under) over (partition by doc_id, isle, r order by pos) as tab from i),
k as (select *, case when tab then 'table' when regexp_matches(line, '^[-*] ') then 'ul' when regexp_matches(line, '^\d+\. ') then 'ol' when starts_with(line, '### ') then 'h3' when starts_with(line, '## ') then 'h2' when trim(line, chr(32) || chr(9) || chr(13)) = '' then 'blank' else 'paragraph' end as kind from j),
n as (select *, case when lag(kind) over (partition by doc_id order by pos) = kind and kind not in ('h2', 'h3') then 0 else 1 end as new from k),
b as (select *, sum(new) over (partition by doc_id order by pos)::bigint as block from n)"""


def prose(spark, sf_dir):
    rule = F.when(F.col("doc_id") % 3 == 0, "|---|--:|").when(F.col("doc_id") % 3 == 1, "x").otherwise("|:-:|")
    text = F.concat(F.lit("| a<b | **c** |\n"), rule, F.lit("\n| 1 | [2] | 3 |\n- *one* [1]\n- two [9]\n - three\n1. `x<y`\n### Head [2]\n#### no head\n\n"), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.alias("text"), F.array(F.lit(1), F.lit(2)).alias("cited"))


@query(f"with {PROSE}, {LINES} select doc_id, block, kind, count(*) as n_lines from b group by doc_id, block, kind")
def markdown_blocks(spark, sf_dir):
    return answers.blocks(prose(spark, sf_dir))


SPANS = r"'(?s)(\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$)'"


@query(rf"""with t as (select doc_id, text || ' $$x$$ and $y$ ' || case when doc_id % 2 = 0 then '\[z $q$\] \(w\) $$$$ $a \(b\) c$' else '' end as t from documents),
s as (select doc_id, regexp_extract_all(t, {SPANS}, 1) as s from t)
select doc_id, len(list_filter(s, lambda x: (starts_with(x, '$$') or starts_with(x, '\[')) and length(x) > 4))::int as display,
len(list_filter(s, lambda x: (starts_with(x, '\(') and length(x) > 4) or (starts_with(x, '$') and not starts_with(x, '$$'))))::int as "inline" from s""")
def math_spans(spark, sf_dir):
    t = F.concat("text", F.lit(" $$x$$ and $y$ "), F.when(F.col("doc_id") % 2 == 0, r"\[z $q$\] \(w\) $$$$ $a \(b\) c$").otherwise(""))
    return table(spark, sf_dir, "documents").select("doc_id", answers.math_spans(t).alias("m")).select("doc_id", "m.*")


def _inline(x: str) -> str:
    out = f"replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
    for mark, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"\*(.+?)\*", "em"), ("`(.+?)`", "code")):
        out = f"regexp_replace({out}, '{mark}', '<{tag}>\\1</{tag}>', 'g')"
    return out


def _linked(x: str, ids: tuple[int, ...]) -> str:
    for i in ids:
        x = f"""replace({x}, '[{i}]', '<sup><a href="#source-{i}" class="cite-ref">[{i}]</a></sup>')"""
    return x


@query(f"with {ANSWERS} select doc_id, {_linked(_inline("'**b** *i* `c<d>` ' || answer"), (2, 3))} as html from a")
def inline_html(spark, sf_dir):
    html = answers.inline_html(F.concat(F.lit("**b** *i* `c<d>` "), "answer"))
    return answered(spark, sf_dir).select("doc_id", answers.cite_links(html, F.array(F.lit(2), F.lit(3))).alias("html"))


CELLS = "list_filter(list_transform(string_split(replace(replace(replace({x}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '|'), lambda x: trim(x)), lambda x: x <> '')"


@query(f"""with t as (select doc_id, '| a<b | ' || source || ' | ' || n_chars || ' | x |' as line, case doc_id % 2 when 0 then '|---|:-:|--:|' else '|:--|--:|' end as separator from documents),
c as (select doc_id, {CELLS.format(x="line")} as c, list_transform({CELLS.format(x="separator")}, lambda x: case when starts_with(x, ':') and ends_with(x, ':') then 'center' when ends_with(x, ':') then 'right' else 'left' end) as a from t)
select doc_id, array_to_string(list_transform(c, lambda x, i: '<td style="text-align:' || coalesce(a[i], 'left') || '">' || x || '</td>'), '') as html from c""")
def table_rows(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    line = F.concat(F.lit("| a<b | "), "source", F.lit(" | "), "n_chars", F.lit(" | x |"))
    separator = F.when(F.col("doc_id") % 2 == 0, "|---|:-:|--:|").otherwise("|:--|--:|")
    return d.select("doc_id", answers.row_html(line, answers.alignments(separator)).alias("html"))


def _cells(line: str, separator: str, tag: str) -> str:
    a = f"list_transform({CELLS.format(x=separator)}, lambda y: case when starts_with(y, ':') and ends_with(y, ':') then 'center' when ends_with(y, ':') then 'right' else 'left' end)"
    return f"""array_to_string(list_transform({CELLS.format(x=line)}, lambda x, i: '<{tag} style="text-align:' || coalesce(({a})[i], 'left') || '">' || x || '</{tag}>'), '')"""


@query(f"""with {PROSE}, {LINES},
u as (select doc_id, block, pos, line, kind, row_number() over (partition by doc_id, block order by pos) as line_no, nth_value(line, 2) over (partition by doc_id, block order by pos rows between unbounded preceding and unbounded following) as sep from b where kind <> 'blank'),
v as (select *, case when kind = 'table' and line_no = 1 then '<table class="answer-table"><thead><tr>' || {_cells("line", "sep", "th")} || '</tr></thead><tbody>' when kind = 'table' and line_no = 2 then ''
when kind = 'table' then '<tr>' || {_cells("line", "sep", "td")} || '</tr>' when kind in ('ul', 'ol') then '<li>' || {_inline("regexp_replace(line, '^([-*]|[0-9]+[.]) ', '')")} || '</li>'
when kind in ('h2', 'h3') then '<' || kind || ' class="answer-' || kind || '">' || {_inline("regexp_replace(line, '^#+ ', '')")} || '</' || kind || '>' else {_inline("line")} end as h from u),
w as (select doc_id, block, kind, case when kind = 'paragraph' then string_agg(h, ' ' order by pos) else string_agg(h, '' order by pos) end as h from v group by doc_id, block, kind),
x as (select doc_id, string_agg(case when kind = 'table' then h || '</tbody></table>' when kind in ('ul', 'ol') then '<' || kind || ' class="answer-list">' || h || '</' || kind || '>' when kind = 'paragraph' then '<p>' || h || '</p>' else h end, chr(10) order by block) as html from w group by doc_id)
select doc_id, {_linked("html", (1, 2))} as html from x""")
def prose_html(spark, sf_dir):
    return answers.prose_html(prose(spark, sf_dir))


@query("select doc_id, case when lang in ('eli5', 'standard', 'academia') then lang else 'standard' end as level from (select doc_id, case doc_id % 4 when 0 then 'eli5' when 1 then 'academia' else lang end as lang from documents)")
def answer_level(spark, sf_dir):
    asked = F.when(F.col("doc_id") % 4 == 0, "eli5").when(F.col("doc_id") % 4 == 1, "academia").otherwise(F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", questions.level(asked).alias("level"))


OLD, NEW = "select doc_id, source, n_chars from documents where doc_id % 3 <> 0", "select doc_id, 'new' as source, n_chars + 1 as n_chars from documents where doc_id % 2 = 0"


def halves(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return d.where("doc_id % 3 <> 0"), d.where("doc_id % 2 = 0").select("doc_id", F.lit("new").alias("source"), (F.col("n_chars") + 1).alias("n_chars"))


@query(f"select coalesce(o.doc_id, n.doc_id) as doc_id, coalesce(o.source, n.source) as source, coalesce(n.n_chars, o.n_chars) as n_chars from ({OLD}) o full join ({NEW}) n on o.doc_id = n.doc_id")
def upsert_chunks(spark, sf_dir):
    old, new = halves(spark, sf_dir)
    return upsert.upsert(old, new, "doc_id", pinned=("source",))


@query(f"{OLD} union all select * from ({NEW}) where doc_id % 3 = 0")
def insert_if_absent(spark, sf_dir):
    return upsert.insert_if_absent(*halves(spark, sf_dir), "doc_id")


@query("select doc_id from documents where source not in (select source from documents where doc_id < 5)")
def skip_existing(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source")
    return upsert.skip_existing(d, d.where("doc_id < 5"), "source").select("doc_id")


ASKED = "q as (select conv_id, turn, case conv_id % 6 when 0 then 'Why k-means? ' when 1 then 'Explain Bias. ' when 2 then 'cosine similarity ' when 3 then 'A CNN filter ' else '' end || text as text from conversations where role = 'user')"


def asked(spark, sf_dir):
    k = F.col("conv_id") % 6
    lead = F.when(k == 0, "Why k-means? ").when(k == 1, "Explain Bias. ").when(k == 2, "cosine similarity ").when(k == 3, "A CNN filter ").otherwise("")
    return table(spark, sf_dir, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(lead, "text").alias("text"))


DETECT = "case " + " ".join(f"when regexp_matches(lower(text), '{'|'.join(w)}') then '{t}'" for t, (w, _) in topics.TOPICS.items()) + " end"
LIT = "case topic " + " ".join(f"when '{t}' then {m}" for t, (_, m) in topics.TOPICS.items()) + " else [] end"


@query(f"with {ASKED} select conv_id, turn, {DETECT} as topic from q")
def topic_detect(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", topics.detect(F.col("text")).alias("topic"))


@query(f"with {ASKED}, t as (select conv_id, turn, {DETECT} as topic from q) select conv_id, turn, {LIT}::varchar[] as modules from t")
def topic_modules(spark, sf_dir):
    return asked(spark, sf_dir).select("conv_id", "turn", topics.modules(topics.detect(F.col("text"))).alias("modules"))


@query(f"with {ASKED}, t as (select {DETECT} as topic from q), m as (select unnest({LIT}::varchar[]) as mod from t) select n.mod, count(m.mod) as n from (select unnest({topics.MODULES}) as mod) n left join m on n.mod = m.mod group by n.mod")
def coverage(spark, sf_dir):
    return topics.coverage(asked(spark, sf_dir))


def graded_by_length(prompts: list[str]) -> list[str]:
    """A stand-in grader: an answer of under a hundred characters fails."""
    return [f'{{"f": 0.9, "r": {0.9 if len(p.rsplit("Answer: ", 1)[-1]) >= 100 else 0.2}, "c": 0.9}}' for p in prompts]


@query()
def stub_answer_pipeline(spark, sf_dir):
    """The benchmark's items as questions over all documents, with stand-ins for the models."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("qid"), "text")
    docs = table(spark, sf_dir, "documents").where("doc_id is not null")
    embedder = providers.hashed_embedder()
    kind = F.element_at(F.array(*map(F.lit, ("pdf", "textbook", "transcript"))), (F.pmod(F.col("doc_id"), F.lit(3)) + 1).cast("int"))
    chunks = docs.select(F.col("doc_id").alias("id"), F.concat(F.lit("3."), F.pmod(F.col("doc_id"), F.lit(10)) + 1).alias("mod"), kind.alias("source_type"), F.concat("source", F.lit(".md")).alias("file"), "text")
    answered = questions.answer(items, staged(providers.embed(chunks, embedder), "chunks"), providers.extractive, graded_by_length, embedder)
    return answered.select("qid", "mod", "attempt", "answer", "citations", "ok", "decision", "verdict", "error")


ROUTED = "r as (select doc_id, case doc_id % 7 when 0 then 'Prune a Decision Tree? ' when 1 then 'The L2 Penalty ' when 2 then 'what is K ' when 3 then 'train a deep net ' when 4 then 'bias-variance ' else '' end || text as text from documents)"


@query(f"with {ROUTED} select doc_id, case " + " ".join(f"when regexp_matches(lower(text), '{p}') then '{t}'" for t, p in topics.PATTERNS.items()) + " else 'none' end as route from r")
def pattern_routes(spark, sf_dir):
    k = F.col("doc_id") % 7
    lead = F.when(k == 0, "Prune a Decision Tree? ").when(k == 1, "The L2 Penalty ").when(k == 2, "what is K ").when(k == 3, "train a deep net ").when(k == 4, "bias-variance ").otherwise("")
    asked_ = table(spark, sf_dir, "documents").select("doc_id", F.concat(lead, "text").alias("text"))
    return asked_.select("doc_id", topics.route_by_pattern(F.col("text"), default="none").alias("route"))


@query(f"""with {ASKED}, t as (select conv_id, turn, {DETECT} as topic from q), n as (select case n_nationkey % 3 when 0 then 'kmeans' when 1 then 'bias-variance' else 'embeddings' end as topic, n_nationkey as position, n_name as eq, 'region ' || n_regionkey as note from nation),
c as (select topic, string_agg(eq || '=' || note, ';' order by position) as cards from n group by topic) select conv_id, turn, topic, coalesce(cards, '') as cards from t left join c using (topic)""")
def topic_cards(spark, sf_dir):
    """Nations stand for the cards of three topics; the other topics have none."""
    k = F.col("n_nationkey") % 3
    topic = F.when(k == 0, "kmeans").when(k == 1, "bias-variance").otherwise("embeddings")
    cards = table(spark, sf_dir, "nation").select(topic.alias("topic"), F.col("n_nationkey").alias("position"), F.col("n_name").alias("eq"), F.concat(F.lit("region "), "n_regionkey").alias("note"))
    found = topics.with_cards(asked(spark, sf_dir).select("conv_id", "turn", topics.detect(F.col("text")).alias("topic")), cards)
    return found.select("conv_id", "turn", "topic", F.array_join(F.transform("cards", lambda c: F.concat(c["eq"], F.lit("="), c["note"])), ";").alias("cards"))

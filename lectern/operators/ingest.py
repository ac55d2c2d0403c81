"""Documents and transcripts to chunks by way of a model's replies, and chunks to tables with embeddings.

Prompts are made by the DataFrame operators, a completer answers them in tasks, and replies become chunks by column
expressions. A prompt whose reply failed or isn't JSON is a row with an error beside the chunks, never a failed job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn
from lectern.operators import chunking, providers, transcript, upsert
from lectern.sources.tables import staged
from lectern.sources.versions import VersionedTable

MIN_CHARS, MIN_WORDS = 30, 15
ITEM = "struct<lesson_title:string,topic:string,page_number:int,clean_markdown:string,retrieval_keywords:array<string>,sample_questions:array<string>,timestamp_start:string,timestamp_end:string,segment_type:string>"


def page_marks(pages: DataFrame) -> DataFrame:
    """(doc_id, text) of pages (doc_id, page, text): each under its mark, parted by blank lines, in order."""
    marked = F.concat(F.lit("<!-- page "), F.col("page"), F.lit(" -->\n"), F.coalesce("text", F.lit("")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", marked.alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))


def cleaned_files(docs: DataFrame) -> DataFrame:
    """(file, text): docs (file, text) cleaned, under their new names; those with nothing left are skipped."""
    name = F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit("_cleaned.md"))
    return docs.select(name.alias("file"), fn.clean_markdown(F.col("text")).alias("text")).where(F.length("text") > 0)


def reply_items(reply: Column) -> Column:
    """The chunks in a model's reply: a JSON array, or an object as an array of one; null if it is neither. Fences are taken off and escapes repaired."""
    bare = fn.repair_escapes(fn.strip_fences(reply))
    one = F.from_json(bare, ITEM, {"mode": "PERMISSIVE"})
    return F.when(bare.startswith("["), F.from_json(bare, f"array<{ITEM}>")).when(bare.startswith("{"), F.when(F.exists(F.json_object_keys(bare), lambda k: k.isNotNull()), F.array(one)))


def reply_chunks(replies: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(keys, at, item) of the chunks in replies (keys, reply, error), and (keys, error) of those that failed."""
    read = replies.withColumn("items", reply_items(F.col("reply")))
    failed = read.where("items is null").select(*keys, F.coalesce("error", F.lit("the reply isn't JSON")).alias("error"))
    return read.where("items is not null").select(*keys, F.posexplode("items").alias("at", "item")), failed


def _enriched(items: DataFrame, source_type: str) -> list[Column]:
    item = lambda c: F.col(f"item.{c}")
    none = F.array().cast("array<string>")
    keywords, questions = F.coalesce(item("retrieval_keywords"), none), F.coalesce(item("sample_questions"), none)
    return [
        F.lit(source_type).alias("source_type"), F.coalesce(item("topic"), F.lit("")).alias("topic"),
        fn.embedding_text(fn.strip(F.coalesce(item("clean_markdown"), F.lit(""))), keywords, questions).alias("chunk_text"),
        keywords.alias("retrieval_keywords"), questions.alias("sample_questions"),
    ]


def slide_chunks(docs: DataFrame, completer: providers.Completer, suffix: str = "LEC01", per_batch: int = chunking.PAGES_A_BATCH) -> tuple[DataFrame, DataFrame]:
    """Chunks of docs (doc_id, file, text) by way of replies to batches of pages, and the batches that failed.

    The chunks of a document are numbered over all its items, also those that are too short to be kept.
    """
    batches = chunking.page_batches(docs.select("doc_id", "text"), per_batch).withColumnRenamed("text", "prompt")
    replies = staged(providers.complete(batches, completer), "slide-replies")
    items, failed = reply_chunks(replies, ["doc_id", "batch"])
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("batch", "at"))  # the items of one document
    numbered = items.withColumn("n", number).where(F.length(fn.strip(F.coalesce("item.clean_markdown", F.lit("")))) >= MIN_CHARS)
    named = numbered.join(docs.select("doc_id", "file"), "doc_id")
    page = F.when(F.col("item.page_number") != 0, F.col("item.page_number"))
    out = named.select("doc_id", "n", F.concat(fn.slugify(F.col("file")), F.lit(f"_{suffix}_"), F.format_string("%04d", "n")).alias("chunk_id"), F.concat("file", F.lit(".pdf")).alias("source_file"), F.coalesce("item.lesson_title", F.lit("")).alias("lesson_title"), page.alias("page_number"), *_enriched(numbered, "pdf"))
    return out.withColumn("token_estimate", fn.token_estimate(F.col("chunk_text"))), failed


def slide_context(slides: DataFrame, configs: DataFrame) -> DataFrame:
    """(module, context): the slide texts (path, text) that each module's config lists and that exist, in its order."""
    listed = configs.select("module", F.posexplode("slide_md_relatives").alias("at", "path")).join(slides.select("path", "text"), "path")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda x: x["text"])
    return configs.select("module").join(listed.groupBy("module").agg(F.array_join(parts, "\n\n---\n\n").alias("context")), "module", "left").select("module", F.coalesce("context", F.lit("")).alias("context"))


def configured_segments(cues: DataFrame, configs: DataFrame) -> DataFrame:
    """Segments of cues (file, pos, ..., speaker) under their module's config (source_file, module, lecture_start_sec, teaching_speakers, notebook_periods): without what comes before the lecture and in notebooks."""
    one = configs.select(F.col("source_file").alias("file"), "module", "lesson_title", "lecture_start_sec", "teaching_speakers", "notebook_periods")
    mine = cues.join(one, "file")
    mine = mine.where(F.col("ts_start_sec") >= F.coalesce("lecture_start_sec", F.lit(0.0)))
    mine = transcript.drop_periods(mine, F.coalesce("notebook_periods", F.array().cast("array<array<double>>")))
    teacher = F.exists("teaching_speakers", lambda t: F.contains(F.lower("speaker"), F.lower(t)))
    paired = transcript.pair_speakers(mine, F.coalesce(teacher, F.lit(False)))
    return transcript.keep_long(transcript.qa_blocks(transcript.merge_cues(paired)))


def transcript_prompts(segments: DataFrame, contexts: DataFrame, most: int = transcript.BATCH_WORDS) -> DataFrame:
    """(file, batch, prompt, first_start, last_end, kind) of batches of segments; contexts are (file, context), and kind is that of the first segment."""
    batched = staged(transcript.greedy_batches(segments, most), "batches")
    heads = batched.groupBy("file", "batch").agg(F.min_by("ts_start_sec", "pos").alias("a"), F.max_by("ts_end_sec", "pos").alias("z"), F.min_by("segment_type", "pos").alias("kind"))
    body = transcript.batch_prompts(batched).join(heads, ["file", "batch"]).join(contexts, "file", "left")
    prompt = F.concat(F.lit("SLIDES:\n"), F.coalesce("context", F.lit("")), F.lit("\n\n---\n\nTRANSCRIPT:\n"), "prompt")
    return body.select("file", "batch", prompt.alias("prompt"), fn.hms(F.col("a")).alias("first_start"), fn.hms(F.col("z")).alias("last_end"), "kind")


def transcript_chunks(prompts: DataFrame, completer: providers.Completer, suffix: str = "LEC02", topics: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Chunks of transcripts by way of replies to prompts, and the batches that failed. With topics (topic), chunks of other topics go.

    Kept chunks are numbered in a file; what a reply leaves out comes from its batch.
    """
    replies = staged(providers.complete(prompts, completer), "transcript-replies")
    items, failed = reply_chunks(replies, ["file", "batch", "first_start", "last_end", "kind"])
    items = items.where(fn.word_count(F.coalesce("item.clean_markdown", F.lit(""))) >= MIN_WORDS)
    if topics is not None:
        items = items.join(F.broadcast(topics.select(F.col("topic").alias("known")).distinct()), F.col("item.topic") == F.col("known"), "left_semi")  # a vocabulary
    number = F.row_number().over(Window.partitionBy("file").orderBy("batch", "at"))  # the items of one file
    given = lambda c, other: F.coalesce(F.nullif(F.col(f"item.{c}"), F.lit("")), F.col(other))
    out = items.withColumn("n", number).select("file", "n", F.concat(fn.slugify(F.col("file").cast("string")), F.lit(f"_{suffix}_"), F.format_string("%04d", "n")).alias("chunk_id"), F.coalesce("item.lesson_title", F.lit("")).alias("lesson_title"), given("timestamp_start", "first_start").alias("timestamp_start"), given("timestamp_end", "last_end").alias("timestamp_end"), F.coalesce("item.segment_type", "kind").alias("segment_type"), *_enriched(items, "transcript"))
    return out.withColumn("token_estimate", fn.word_count(F.col("chunk_text"))), failed


def first_seen(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, first): the distinct keys and where each comes first."""
    return rows.groupBy(key).agg(F.min(order).alias("first"))


def sample(rows: DataFrame, order: list[str], n: int = 5) -> DataFrame:
    """The first n rows."""
    return rows.orderBy(*order).limit(n)


def seed(chunks: DataFrame, tables: dict[str, DataFrame], embedder: providers.Embedder, namespace: str, dim: int = 64, defaults: dict[str, dict] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """documents, chunks and embeddings with chunks (chunk_id, source_file, line, chunk_text, ...) upserted, and the rows that failed.

    Keys are name-based, so a second run changes nothing. A chunk's index counts the lines of its file, with gaps where a
    row fails: one without an id or a text, or with a vector of another length. Other columns of the tables keep their
    values, and are those of `defaults`, by table and column, in new rows.

    Rows are embedded where they are and numbered in the files written then; indices, the rows that count and what they
    replace are found without texts and vectors, which are shuffled once, to these rows.
    """

    def more(name: str, rows: DataFrame) -> tuple[DataFrame, tuple[str, ...]]:
        extra = [f for f in tables[name].schema if f.name not in rows.columns]
        return rows.withColumns({f.name: F.lit((defaults or {}).get(name, {}).get(f.name)).cast(f.dataType) for f in extra}), tuple(f.name for f in extra)

    key = lambda kind, c: fn.uuid5(F.concat(F.lit(f"{kind}::"), c.cast("string")), namespace)
    named = chunks.select("chunk_id", "source_file", "line", "chunk_text", key("doc", F.col("source_file")).alias("document"), key("chunk", F.col("chunk_id")).alias("id"))
    made = staged(providers.embed_each(named, embedder, "chunk_text", dim).withColumn("_row", F.monotonically_increasing_id()), "seeded")
    made = made.withColumn("error", F.when(F.col("chunk_id").isNull(), "no chunk_id").otherwise(F.col("error")))
    docs = made.select(F.col("document").alias("id"), fn.module_of(F.col("source_file")).alias("mod"), F.col("source_file").alias("file"), "line")
    index = (F.row_number().over(Window.partitionBy("source_file").orderBy("line", "_row")) - 1).cast("int")  # the chunks of one file
    light = made.select("_row", "id", "chunk_id", "document", "source_file", "line", "error").withColumn("chunk_index", index)
    last = staged(upsert.one_each(light.where("error is null").drop("error", "source_file"), "id", "line", last=True), "seeded-last")
    rows = last.select("id", "document", "chunk_index", "_row")
    vectors = last.select(key("emb", F.col("chunk_id")).alias("id"), F.col("id").alias("chunk"), "_row")
    out = {"documents": upsert.insert_if_absent(tables["documents"], more("documents", docs)[0], "id", "line")}
    for name, new, pin, heavy in (("chunks", rows, "document", F.col("chunk_text").alias("text")), ("embeddings", vectors, "chunk", F.col("embedding"))):
        wide = made.select("_row", heavy)
        old = tables[name]
        new, extra = more(name, new.withColumn(wide.columns[1], F.lit(None)))
        pinned = old.select("id", *(F.col(c).alias(f"_{c}") for c in (pin, *extra)), F.lit(True).alias("_old"))
        light = new.drop(wide.columns[1]).join(pinned, "id", "left")
        light = light.withColumns({c: F.when(F.col("_old"), F.col(f"_{c}")).otherwise(F.col(c)) for c in (pin, *extra)})
        out[name] = upsert.beside(old, light.join(wide, "_row").select(*old.columns), new.select("id"), "id")
    return out, made.where("error is not null").select("chunk_id", "source_file", "line", "error")


def seed_tables(chunks: DataFrame, tables: dict[str, VersionedTable], embedder: providers.Embedder, namespace: str, dim: int = 64, slices: int = 1) -> DataFrame:
    """Seeds versioned tables (documents, chunks, embeddings) and gives the rows that failed. The files are done in `slices`, each a version of
    each table, parents first: a run that is interrupted keeps the slices before, and a rerun changes nothing in them. If another
    writer comes between, versions.Conflict is raised and nothing of the slice is lost but its work."""
    failed = []
    for k in range(slices):
        mine = chunks if slices == 1 else chunks.where(F.pmod(F.xxhash64("source_file"), F.lit(slices)) == k)
        now = {name: tables[name].version() for name in ("documents", "chunks", "embeddings")}
        last = {name: v.number for name, v in now.items()}
        defaults = {name: {c["name"]: c["default"] for c in v.columns} for name, v in now.items()}
        made, bad = seed(mine, {name: tables[name].read(v.number or None) for name, v in now.items()}, embedder, namespace, dim, defaults)
        for name, number in last.items():
            tables[name].replace(made[name], after=number, done="seed")
        failed.append(bad)
    return reduce(DataFrame.unionByName, failed)


def reindex_table(embeddings: VersionedTable, chunks: DataFrame, embedder: providers.Embedder, dim: int = 64) -> DataFrame:
    """Overwrites a versioned table of embeddings with vectors made anew, and gives the rows that failed, which keep their old vectors. Rows without a chunk stay."""
    last = embeddings.version().number
    old = embeddings.read(last)
    made = staged(reindex(old, chunks, embedder, dim), "reindexed")
    embeddings.replace(upsert.beside(old, made.drop("error"), made.select("id"), "id"), after=last, done="reindex")
    return made.where("error is not null").select("id", "chunk", "error")


def reindex(embeddings: DataFrame, chunks: DataFrame, embedder: providers.Embedder, dim: int = 64) -> DataFrame:
    """embeddings (id, chunk, embedding) with vectors made anew from the chunks' texts (id, text), and error: a failed row keeps its old vector."""
    texts = chunks.select(F.col("id").alias("chunk"), F.col("text").alias("of_text"))
    made = providers.embed_each(embeddings.withColumnRenamed("embedding", "old").join(texts, "chunk"), embedder, "of_text", dim)
    anew = F.when(F.col("error").isNull(), F.col("embedding")).otherwise(F.col("old").cast("array<float>"))
    return made.select("id", "chunk", anew.alias("embedding"), "error")


def progress(done: DataFrame, seconds: float, total: int | None = None) -> DataFrame:
    """One row: ok, errors, rows a second, and the seconds left if total rows are to be done."""
    n, bad = F.count("*"), F.count_if(F.col("error").isNotNull())
    left = F.lit(total) - n if total is not None else F.lit(0)
    return done.agg((n - bad).alias("ok"), bad.alias("errors"), F.round(n / seconds, 6).alias("rate"), F.when(n > 0, F.round(left * seconds / n, 6)).otherwise(0.0).alias("eta"))


def observed(rows: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, Observation]:
    """rows, and an observation that has n and the metrics once a job has read them all: no job of its own."""
    seen = Observation(name)
    return rows.observe(seen, F.count(F.lit(1)).alias("n"), *(c.alias(k) for k, c in metrics.items())), seen


def validate(rows: DataFrame, allowed: dict[str, list[str]]) -> tuple[DataFrame, DataFrame]:
    """The rows whose columns hold allowed values, and the others with reason, the first column that doesn't; null is not allowed."""
    reason = F.coalesce(*(F.when(~F.coalesce(F.col(c).isin(values), F.lit(False)), F.lit(c)) for c, values in allowed.items()), F.lit(None).cast("string"))
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").drop("reason"), judged.where("reason is not null")


def lookup(rows: DataFrame, dimension: DataFrame, key: str, default: str) -> DataFrame:
    """rows with the columns of dimension for their key, those of the key `default` for any other, null if dimension hasn't that key either.

    A key that repeats in dimension has the least of its rows, so that no row is lost or doubled. The join is broadcast
    by the planner alone, by the size of dimension. Columns of rows keep their values, but those named as dimension's are replaced.
    """
    names = [c for c in dimension.columns if c != key]
    of, found, other = (next(n for n in (c + "_" * k for k in range(len(rows.columns) + 2)) if n not in rows.columns) for c in ("of", "found", "other"))
    one = dimension.where(F.col(key).isNotNull()).groupBy(F.col(key).alias(of)).agg(F.min(F.struct(*names)).alias(found))
    spare = dimension.where(F.col(key) == default).agg(F.min(F.struct(*names)).alias(other))  # one row, always
    kept = [c for c in rows.columns if c not in names]
    joined = rows.join(one, rows[key] == F.col(of), "left").crossJoin(spare)  # with one row
    return joined.select(*(rows[c] for c in kept), *(F.coalesce(found, other)[c].alias(c) for c in names))

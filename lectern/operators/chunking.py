"""Cleaning, windows, headings and pages of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import let, strip, token_estimate

SIZE, OVERLAP, MIN_CHARS = 1000, 200, 50
PAGE = r"<!--\s*page\s*\d+\s*-->"
PAGES_A_BATCH = 10


def _windows(text: Column, size: int, overlap: int, min_chars: int) -> Column:
    """The texts of the windows up to the first that is too short."""
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")
    step = size - overlap
    n = F.greatest(F.lit(0), F.ceil((F.length(text) - size) / step)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), n), lambda k: strip(F.substring(text, k * step + 1, F.lit(size))))
    stop = lambda c: F.array_position(F.transform(c, lambda x: F.length(x) < min_chars), True).cast("int")
    return let(cut, lambda c: let(stop(c), lambda at: F.when(at > 0, F.slice(c, F.lit(1), at - 1)).otherwise(c)))


def sliding_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, min_chars: int = MIN_CHARS, *more: Column) -> DataFrame:
    """(doc_id, chunk_index, start, chunk_text, token_estimate) and the columns `more` of docs: windows in one pass over each text."""
    kept = _windows(F.col("text"), size, overlap, min_chars)
    # the outer form, as the filter that Spark infers for the other would cut each text a second time
    given = docs.where("text is not null").select("doc_id", "text", *more)  # before the generator, which would compute them for each window
    rest = given.columns[2:]
    out = given.select("doc_id", *rest, F.posexplode_outer(kept).alias("chunk_index", "chunk_text")).where("chunk_index is not null")
    return out.select("doc_id", "chunk_index", (F.col("chunk_index") * (size - overlap)).alias("start"), "chunk_text", token_estimate(F.col("chunk_text")).alias("token_estimate"), *rest)


def heading_map(text: Column) -> Column:
    """array<struct<at, heading>> of the lines that start with ## or ###, by character offset.

    An array that grows by one is copied each time, so lines are folded in groups of about the root of their number, and
    then the groups: 10^5 headings take 10^5 * sqrt(10^5) copies, not 10^10 / 2.
    """
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,heading:string>>").alias("found"))

    def add(acc: Column, x: Column) -> Column:
        bare = strip(x)
        heading = F.struct(acc["at"].alias("at"), strip(F.regexp_replace(bare, "^#+", "")).alias("heading"))
        found = F.when(bare.rlike("^#{2,3} "), F.array_append(acc["found"], heading)).otherwise(acc["found"])
        return F.struct((acc["at"] + F.length(x) + 1).alias("at"), found.alias("found"))

    def join(acc: Column, group: Column) -> Column:
        moved = F.transform(group["found"], lambda h: F.struct((acc["at"] + h["at"]).alias("at"), h["heading"].alias("heading")))
        found = F.when(F.size(moved) > 0, F.concat(acc["found"], moved)).otherwise(acc["found"])
        return F.struct((acc["at"] + group["at"]).alias("at"), found.alias("found"))

    def both(lines: Column) -> Column:
        size = F.ceil(F.sqrt(F.size(lines))).cast("int")
        starts = F.sequence(F.lit(1), F.size(lines), size)
        groups = F.transform(starts, lambda s: F.aggregate(F.slice(lines, s, size), empty, add))
        return F.aggregate(groups, empty, join)["found"]

    return let(F.split(text, "\n"), both)


def headings(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.explode(heading_map(F.col("text"))).alias("h")).select("doc_id", F.col("h.at").alias("char_offset"), "h.heading")


def titled_chunks(docs: DataFrame, size: int = SIZE, overlap: int = OVERLAP, min_chars: int = MIN_CHARS) -> DataFrame:
    """sliding_chunks of docs with section_title, the heading at or before the start of each, else ''. Nothing is shuffled."""
    cut = sliding_chunks(docs, size, overlap, min_chars, heading_map(F.col("text")).alias("headings"))
    last = F.try_element_at(F.filter("headings", lambda h: h["at"] <= F.col("start")), F.lit(-1))["heading"]
    return cut.withColumn("section_title", F.coalesce(last, F.lit(""))).drop("headings")


def page_batches(docs: DataFrame, per_batch: int = PAGES_A_BATCH, pattern: str = PAGE) -> DataFrame:
    """(doc_id, batch, text): the pages that aren't empty, some to a batch; a text that isn't blank and has no such page is one."""
    pages = F.filter(F.transform(F.split("text", pattern), strip), lambda p: F.length(p) > 0)
    pages = F.when((F.size(pages) == 0) & (F.length(strip(F.col("text"))) > 0), F.array("text")).otherwise(pages)
    batches = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.size("p") / per_batch).cast("int") - 1)), lambda b: F.array_join(F.slice("p", b * per_batch + 1, F.lit(per_batch)), "\n\n"))
    return docs.select("doc_id", pages.alias("p")).where(F.size("p") > 0).select("doc_id", F.posexplode(batches).alias("batch", "text"))


def number_chunks(chunks: DataFrame, slug: Column, suffix: str) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("chunk_index")
    return chunks.withColumn("chunk_id", F.concat(slug, F.lit(f"_{suffix}_"), F.format_string("%04d", F.row_number().over(order))))


def layout_headings(spans: DataFrame) -> DataFrame:
    """(page_id, line, text, markdown) of span rows (page_id, line, pos, text, size, bold): the largest span of a line decides."""
    lines = spans.groupBy("page_id", "line").agg(F.max("size").alias("size"), F.bool_or("bold").alias("bold"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda s: s["text"]), " ").alias("text"))
    big = (F.col("size") >= 14) | ((F.col("size") >= 12) & F.col("bold"))
    mark = F.when(big, "## ").when((F.col("size") >= 11) & F.col("bold"), "### ").otherwise("")
    return lines.select("page_id", "line", "text", F.concat(mark, "text").alias("markdown"))

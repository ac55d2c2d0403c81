"""Answers: citations, references, grades, verdicts and the one retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions import text as fn

PASS_MEAN = 0.80
REFERENCES = r"(?is)\n#{1,3}\s*(References|Sources)\b.*"
UNAVAILABLE = "EVAL BACKEND UNAVAILABLE — stub score, not a real grade — "


def strip_references(answer: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(answer, REFERENCES, ""), r"\s+$", "")


def cited(answer: Column) -> Column:
    """Sorted distinct numbers in [N] marks; one that is too large for any chunk is -1, which is none."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), 1), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))))


def resolve(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(doc_id, n, ...) joining each mark of answers (doc_id, answer) to chunks (doc_id, rank, ...) by rank; others drop."""
    marks = answers.select("doc_id", F.explode(cited(F.col("answer"))).alias("rank"))
    return marks.join(chunks, ["doc_id", "rank"])


def sources(citations: DataFrame) -> DataFrame:
    """(doc_id, id, score): the marks of resolved citations (doc_id, rank, score, ...) with the scores of their chunks."""
    return citations.select("doc_id", F.col("rank").alias("id"), "score")


def rebuild(answers: DataFrame, citations: DataFrame) -> DataFrame:
    """Answers with the model's references replaced by those that resolve."""
    line = F.format_string("[%d] %s (module %s)", F.col("rank"), F.col("file"), F.col("mod"))
    block = citations.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("t")))), lambda x: x["t"]), "\n").alias("block"))
    joined = answers.join(block, "doc_id", "left")
    bare = strip_references(F.col("answer"))
    return joined.select("doc_id", F.when(F.col("block").isNotNull(), F.concat(bare, F.lit("\n\n## References\n"), "block")).otherwise(bare).alias("answer"))


def compliant(answer: Column, known: Column) -> Column:
    return F.size(F.array_except(cited(answer), known)) == 0


def parse_grade(reply: Column) -> Column:
    """struct f, r, c, is_fallback: what isn't three numbers grades as one half each."""
    parsed = F.from_json(reply, "f double, r double, c double")
    good = parsed["f"].isNotNull() & parsed["r"].isNotNull() & parsed["c"].isNotNull()
    one = lambda x: F.when(good, F.greatest(F.lit(0.0), F.least(F.lit(1.0), parsed[x]))).otherwise(0.5).alias(x)
    return F.struct(one("f"), one("r"), one("c"), (~F.coalesce(good, F.lit(False))).alias("is_fallback"))


def mean(g: Column) -> Column:
    return (g["f"] + g["r"] + g["c"]) / 3


def verdict(g: Column, ok: Column, second: bool = False) -> Column:
    shown, ok = F.format_string("%.2f", mean(g)), F.coalesce(ok, F.lit(True))  # as decide() has it
    if second:
        low, bad = F.concat(shown, F.lit(" — proceeding to compose")), F.concat(shown, F.lit(" — citation compliance failed, proceeding to compose"))
    else:
        low, bad = F.concat(F.lit("BELOW 0.80 ("), shown, F.lit("), reloop")), F.concat(F.lit("BELOW 0.80 ("), shown, F.lit(") — citation compliance failed, reloop"))
    text = F.when((mean(g) >= PASS_MEAN) & ok, "PASS").when(~ok, bad).otherwise(low)
    return F.concat(F.when(g["is_fallback"], UNAVAILABLE).otherwise(""), text)


def decide(g: Column, ok: Column) -> Column:
    """pass or reloop; no grade reloops, unknown compliance counts as compliant."""
    return F.when(F.coalesce((mean(g) >= PASS_MEAN) & F.coalesce(ok, F.lit(True)), F.lit(False)), "pass").otherwise("reloop")


def adequate(reflection: Column) -> Column:
    return F.lower(reflection).rlike("adequate|sufficient|covered")


def final_once(attempts: DataFrame) -> DataFrame:
    """The last attempt of each request."""
    last = Window.partitionBy("request_id").orderBy(F.desc("attempt"))
    return attempts.withColumn("n", F.row_number().over(last)).where("n = 1").drop("n")


ROW, SEPARATOR = r"^\|.*\|", r"^\|[-:| ]+\|"


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, pos, line, kind, block): a table begins at a row over a separator and takes all rows after it; a heading is a block of its own."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    line, row = F.col("line"), F.col("line").rlike(ROW)
    lines = lines.withColumns({"isle": F.count_if(~row).over(order), "head": row & F.coalesce(F.lead("line").over(order).rlike(SEPARATOR), F.lit(False))})
    table = row & F.max("head").over(Window.partitionBy("doc_id", "isle", row).orderBy("pos"))
    kind = F.when(table, "table").when(line.rlike(r"^[-*] "), "ul").when(line.rlike(r"^[0-9]+\. "), "ol").when(line.startswith("## "), "h2").when(line.startswith("### "), "h3").when(fn.strip(line) == "", "blank").otherwise("paragraph")
    lines = lines.withColumn("kind", kind)
    new = F.when((F.lag("kind").over(order) == F.col("kind")) & ~F.col("kind").isin("h2", "h3"), 0).otherwise(1)
    return lines.withColumn("new", new).select("doc_id", "pos", "line", "kind", F.sum("new").over(order).alias("block"))


def blocks(docs: DataFrame) -> DataFrame:
    """(doc_id, block, kind, n_lines) of Markdown (doc_id, text): runs of lines of one kind."""
    return _lines(docs).groupBy("doc_id", "block", "kind").agg(F.count("*").alias("n_lines"))


def math_spans(text: Column) -> Column:
    """struct display, inline: how many $$..$$ or \\[..\\] and how many $..$ or \\(..\\) spans that hold something, read from the left."""
    spans = F.regexp_extract_all(text, F.lit(r"(?s)(\$\$.*?\$\$|\\\[.*?\\\]|\\\(.*?\\\)|\$[^$\n]+?\$)"), 1)
    shown = lambda x: x.startswith("$$") | x.startswith("\\[")
    full = F.filter(spans, lambda x: F.length(x) > F.when(x.startswith("$") & ~x.startswith("$$"), 2).otherwise(4))
    return F.transform(F.array(full), lambda a: F.struct(F.size(F.filter(a, shown)).alias("display"), F.size(F.filter(a, lambda x: ~shown(x))).alias("inline")))[0]


def escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def inline_html(text: Column) -> Column:
    """Escaped, then bold, italics and code."""
    out = escaped(text)
    for mark, tag in ((r"\*\*(.+?)\*\*", "strong"), (r"\*(.+?)\*", "em"), ("`(.+?)`", "code")):
        out = F.regexp_replace(out, mark, f"<{tag}>$1</{tag}>")
    return out


def cite_links(html: Column, known: Column) -> Column:
    """Links at the marks of the known ids; other marks stay as they are."""
    link = lambda s, i: F.replace(s, F.concat(F.lit("["), i, F.lit("]")), F.concat(F.lit('<sup><a href="#source-'), i, F.lit('" class="cite-ref">['), i, F.lit("]</a></sup>")))
    ids = F.array_distinct(F.filter(known, lambda i: i.isNotNull()))
    return F.aggregate(F.coalesce(ids.cast("array<string>"), F.array().cast("array<string>")), html, link)


def cells(line: Column) -> Column:
    """The cells of a table row that aren't empty, escaped."""
    return F.filter(F.transform(F.split(escaped(line), r"\|"), fn.strip), lambda x: x != "")


def alignments(separator: Column) -> Column:
    """left, right or center for each cell of the row under the heads."""
    return F.transform(cells(separator), lambda x: F.when(x.startswith(":") & x.endswith(":"), "center").when(x.endswith(":"), "right").otherwise("left"))


def row_html(line: Column, aligned: Column, tag: str = "td") -> Column:
    """The cells of one table row; a cell without an alignment is on the left."""
    cell = lambda x, i: F.concat(F.lit(f'<{tag} style="text-align:'), F.coalesce(F.get(aligned, i), F.lit("left")), F.lit('">'), x, F.lit(f"</{tag}>"))
    return F.array_join(F.transform(cells(line), cell), "")


def prose_html(docs: DataFrame) -> DataFrame:
    """(doc_id, html) of Markdown without formulas (doc_id, text, cited): a table, list, heading or paragraph a block.

    One row per doc_id; the lines of a text meet in one task, as the text was in one. A null text has no row, a blank one an empty html.
    """
    kind, lines = F.col("kind"), F.col("lines")
    each = lambda skip, start, end: F.array_join(F.transform(lines, lambda x: F.concat(F.lit(start), inline_html(F.regexp_replace(x, skip, "")), F.lit(end))), "")
    aligned = alignments(lines[1])
    body = F.array_join(F.transform(F.slice(lines, 3, F.size(lines)), lambda x: F.concat(F.lit("<tr>"), row_html(x, aligned), F.lit("</tr>"))), "")
    table = F.concat(F.lit('<table class="answer-table"><thead><tr>'), row_html(lines[0], aligned, "th"), F.lit("</tr></thead><tbody>"), body, F.lit("</tbody></table>"))
    html = F.when(kind == "table", table)
    html = html.when(kind == "ul", F.concat(F.lit('<ul class="answer-list">'), each("^[-*] ", "<li>", "</li>"), F.lit("</ul>")))
    html = html.when(kind == "ol", F.concat(F.lit('<ol class="answer-list">'), each(r"^[0-9]+\. ", "<li>", "</li>"), F.lit("</ol>")))
    for name in ("h2", "h3"):
        html = html.when(kind == name, each("^#+ ", f'<{name} class="answer-{name}">', f"</{name}>"))
    html = html.when(kind == "paragraph", F.concat(F.lit("<p>"), F.array_join(F.transform(lines, inline_html), " "), F.lit("</p>")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"])
    made = _lines(docs).groupBy("doc_id", "block", "kind").agg(ordered.alias("lines")).select("doc_id", "block", html.alias("html"))
    parts = F.array_sort(F.collect_list(F.when(F.col("html").isNotNull(), F.struct("block", "html"))))
    whole = made.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["html"]), "\n").alias("html"))
    return whole.join(docs.select("doc_id", "cited"), "doc_id").select("doc_id", cite_links(F.col("html"), F.col("cited")).alias("html"))

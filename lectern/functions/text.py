"""Column functions over text that keep the semantics of whitespace splitting and stripping."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white space of Python's str.strip and str.split, which is wider than the \s of Java's patterns.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
EDGES = rf"^{SPACE}+|{SPACE}+$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.regexp_replace(c, EDGES, "")


def words(c: Column) -> Column:
    """Empty for a blank text."""
    bare = strip(c)
    return F.when(F.length(bare) > 0, F.split(bare, f"{SPACE}+")).otherwise(F.array().cast("array<string>"))


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("long")


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clean_markdown(c: Column) -> Column:
    """Without comments and span tags; headings stripped, lines of under four characters blank, other white space single."""
    bare = F.regexp_replace(F.regexp_replace(c, r"(?s)<!--.*?-->", ""), r"</?span[^>]*>", "")
    line = lambda x: F.when(strip(x).startswith("#"), strip(x)).when(F.length(F.regexp_replace(x, SPACE, "")) < 4, F.lit("")).otherwise(F.regexp_replace(strip(x), f"{SPACE}+", " "))
    return strip(F.regexp_replace(F.array_join(F.transform(F.split(bare, "\n"), line), "\n"), r"\n{3,}", "\n\n"))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")


def hms(seconds: Column) -> Column:
    s = F.floor(seconds)
    two = lambda x: F.when(x < 100, F.lpad(x.cast("string"), 2, "0")).otherwise(x.cast("string"))
    return F.concat_ws(":", two(F.floor(s / 3600)), two(F.floor(s % 3600 / 60)), two(s % 60))


def seconds(ts: Column) -> Column:
    """HH:MM:SS.mmm, MM:SS.mmm or bare seconds; a comma may stand for the point. Null for what is no time."""
    p = F.split(F.replace(ts, F.lit(","), F.lit(".")), ":")
    at = lambda k: strip(F.get(p, F.lit(k))).try_cast("double")
    return F.when(F.size(p) == 3, at(0) * 3600 + at(1) * 60 + at(2)).when(F.size(p) == 2, at(0) * 60 + at(1)).otherwise(at(0))


def module_of(file: Column) -> Column:
    return F.regexp_extract(file, r"^\s*(\d+\.\d+)", 1)


def route_label(reply: Column) -> Column:
    token = F.get(words(reply), F.lit(0))
    return F.when(token.rlike(r"^3\.\d+$"), token).otherwise("3.1")


def strip_fences(c: Column) -> Column:
    bare = strip(c)
    return F.when(bare.startswith("```"), strip(F.regexp_replace(F.regexp_replace(bare, r"^```[^\n]*\n?", ""), r"```\s*$", ""))).otherwise(bare)


def repair_escapes(c: Column) -> Column:
    """Doubles each backslash before a character that makes no JSON escape with it; a valid pair is taken as one, and so is a backslash with a space."""
    return F.regexp_replace(c, r'(?s)(\\["\\/ bfnrtu])|(\\)(?=.)', "$1$2$2")


def embedding_text(markdown: Column, keywords: Column, questions: Column) -> Column:
    keys = F.when(F.size(keywords) > 0, F.concat(F.lit("Keywords: "), F.array_join(keywords, ", ")))
    asked = F.when(F.size(questions) > 0, F.concat(F.lit("Questions this chunk answers:\n"), F.array_join(F.transform(questions, lambda q: F.concat(F.lit("- "), q)), "\n")))
    return F.concat_ws("\n\n", F.nullif(markdown, F.lit("")), keys, asked)


def uuid5(name: Column, namespace: str) -> Column:
    """Version 5 UUID in a namespace given as 32 hex digits."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.conv(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8).cast("string"), 10, 16))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))

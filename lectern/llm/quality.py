"""Quality rules with host-level verdicts, in DataFrame operations alone.

A document fails by itself if it has fewer than 50 words or if more than half of its words repeat. The rules that count
for hosts are these two and two more: symbols for over a tenth of its words, and over 30 % of its lines with words
repeated. Failures of each rule are aggregated by host (the source column), partially where the rows are. The rate of a
host with few documents says little, so each rule's rate is shrunk to (failed + a) / (n + a + b). The beta prior (a, b)
of a rule is fitted to all hosts by moments: the mean is that of all documents, and of the variance between hosts,
weighted by their documents, the part that is only binomial noise is taken off. Documents of a host with a shrunk rate over
`host_limit` in any rule are not kept. The join back is an equi join on the host, whose hot keys adaptive execution
splits; a million hosts at most are broadcast.

Words are `[^\\x20\\x09-\\x0D]+`. A word repeats if it is in a 3-word window that the text has twice or more; windows
are compared by 64-bit hashes.

Cases: a null or empty text has no words and fails. A null host is a host of its own. Null and repeated doc_ids are
rows like others. Very long texts are measured whole, a sort of their windows each. Other columns of docs are not
returned. An empty table gives no rows. With one host, or hosts that differ no more than chance, the prior is as strong
as `MOST_STRENGTH` documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import SPACES, let, materialize, small

MIN_WORDS = 50
HOST_LIMIT = 0.5
MOST_STRENGTH = 1_000_000.0


def words(text: Column) -> Column:
    stripped = F.btrim(text, F.lit(SPACES))
    return F.when(F.coalesce(stripped, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+"))


def repeated_words(w: Column) -> Column:
    """How many words are in 3-word windows that come twice or more: windows sorted by hash, equal neighbours marked."""
    windows = F.when(F.size(w) > 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("i")))).otherwise(F.array().cast("array<struct<h:bigint,i:int>>"))
    hash_at = lambda s, i: F.get(s, i)["h"]
    twice = lambda s: F.filter(s, lambda x, i: F.coalesce(hash_at(s, i - 1) == x["h"], F.lit(False)) | F.coalesce(hash_at(s, i + 1) == x["h"], F.lit(False)))
    marked = let(F.array_sort(windows), twice)
    return F.size(F.array_distinct(F.flatten(F.transform(marked, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def measures(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_filled_lines), a row for each row of docs."""
    text = F.coalesce("text", F.lit(""))
    filled = F.filter(F.split(text, "\n"), lambda line: F.length(F.btrim(line, F.lit(SPACES))) > 0)
    counted = let(words(text), lambda w: F.struct(F.size(w).alias("n"), repeated_words(w).alias("r")))
    lines = let(filled, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("dup")))
    long = lambda c, name: c.cast("long").alias(name)
    out = docs.select(F.col("doc_id"), F.col("source"), counted.alias("c"), long(F.length(F.translate(text, SPACES, "")), "word_chars"), long(F.length(text) - F.length(F.translate(text, "#*$%&|<>", "")), "n_symbols"), lines.alias("l"))
    return out.select("doc_id", "source", long(F.col("c.n"), "n_words"), "word_chars", "n_symbols", long(F.col("l.dup"), "n_dup_lines"), long(F.col("c.r"), "n_repeat_words"), long(F.col("l.n"), "n_filled_lines"))


#: Rules that count for hosts, as conditions on the measures.
RULES = {
    "short": f"n_words < {MIN_WORDS}",
    "repeats": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "lines": "100 * n_dup_lines > 30 * n_filled_lines",
}


def hosts(measured: DataFrame) -> DataFrame:
    """(source, n_docs, failed_<rule>, rate_<rule>): the failures of each host and rule, and the shrunk rates."""
    by_host = measured.groupBy("source").agg(F.count("*").alias("n_docs"), *(F.count_if(F.expr(rule)).alias(f"failed_{name}") for name, rule in RULES.items()))
    by_host = materialize(by_host, "by-host")
    n = F.col("n_docs")
    total = by_host.agg(F.count("*").alias("hosts"), F.sum(n).alias("n"), F.sum(n * n).alias("n2"), *(F.sum(f"failed_{name}").alias(name) for name in RULES)).first()  # one row
    docs = total.n or 1
    means = [round((total[name] or 0) / docs, 9) for name in RULES]
    spread = by_host.agg(*(F.sum(n * (F.col(f"failed_{name}") / n - m) ** 2) for name, m in zip(RULES, means, strict=True))).first()  # four numbers
    spare = docs - (total.n2 or 0) / docs
    apart = [round(((x or 0.0) - (total.hosts - 1) * m * (1 - m)) / spare, 12) if spare > 0 else 0.0 for x, m in zip(spread, means, strict=True)]
    strengths = [min(max(m * (1 - m) / v - 1, 1.0), MOST_STRENGTH) if v > 0 and 0 < m < 1 else MOST_STRENGTH for m, v in zip(means, apart, strict=True)]
    rate = lambda name, m, s: F.round((F.col(f"failed_{name}") + F.lit(m * s)) / (F.col("n_docs") + F.lit(s)), 9).alias(f"rate_{name}")
    return by_host.select("*", *(rate(*x) for x in zip(RULES, means, strengths, strict=True)))


def assess(docs: DataFrame, host_limit: float = HOST_LIMIT) -> DataFrame:
    """The measures of each row of docs with base_failed, kept and host_rate, the worst of its host's rates."""
    measured = measures(docs).withColumn("base_failed", F.expr(f"{RULES['short']} or {RULES['repeats']}"))
    measured = materialize(measured, "measures")
    worst = F.greatest(*(F.col(f"rate_{name}") for name in RULES))
    rates = materialize(hosts(measured).select(F.col("source").alias("host"), worst.alias("host_rate")), "hosts")
    joined = measured.join(small(rates, rates.count()), F.col("source").eqNullSafe(F.col("host")), "left")
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.col("host_rate") <= host_limit)).alias("kept"), "host_rate")

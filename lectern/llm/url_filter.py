"""Temporal URL lists: dated entries become validity intervals, and an as-of join judges each capture by the entries
active when it was fetched.

An entry is (entry, action, event, since): from `since` on, the host suffix `entry` is listed with an action ("block"
or "allow") after "add", or not listed after "remove". intervals() gives each event the time of the next event of its
entry as its end; of events at one time the last by (event, action) counts, "remove" after "add". The most specific
active suffix of a capture's host decides: "blog.a.org" before "a.org". A host under no active entry isn't blocked.

Captures are pre-aggregated to distinct (host, time) before they meet the list, so that a hot host makes as many
rows as it has fetch times. Intervals are cut at 30 days within the time that captures span and met by (entry, 30
days), so a capture meets what an entry did in those days and not its whole history, and an entry that all captures
share is as many keys as there are months. Verdicts go back over (host, time), whose skew adaptive execution splits.

Cases: the host is the lower-cased part of http and https URLs between :// (and any user@) and the next of /, ?, #, :
or a backslash; without one it is null. A capture with a null host or time is not blocked. Null entries and dates are ignored.
Repeated captures are each judged. Very long urls and hosts have a suffix for each label. Empty lists block nothing.
Other columns pass through, whatever their names; host, matched_entry and blocked replace namesakes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.base import fresh

HOST = r"^(?i)https?://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:\\@]+)"


def host(url: Column) -> Column:
    """The lower-cased host of a url, a bracketed address whole, without the dot that a full name may end with; null without one."""
    found = F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(found != "", found)


def intervals(entries: DataFrame) -> DataFrame:
    """(entry, action, since, until): when each listed entry holds, until excluded and null while it still holds."""
    dated = entries.where("entry is not null and since is not null").select(F.regexp_replace(F.lower("entry"), r"\.$", "").alias("entry"), "action", "event", "since")
    last = dated.groupBy("entry", "since").agg(F.max(F.struct("event", "action")).alias("e"))
    order = Window.partitionBy("entry").orderBy("since")  # the history of one entry
    return last.withColumn("until", F.lead("since").over(order)).where("e.event = 'add'").select("entry", F.col("e.action").alias("action"), "since", "until")


def suffixes(name: Column) -> Column:
    """a.b.c, b.c and c."""
    labels = F.split(name, "\\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _month(at: Column) -> Column:
    """The number of the 30 days that a date or time lies in."""
    return F.floor(F.unix_timestamp(at.cast("timestamp")) / (30 * 86_400))


def judge(captures: DataFrame, entries: DataFrame, url: str = "url", at: str = "fetched") -> DataFrame:
    """captures with host, matched_entry and blocked."""
    captures = captures.drop("host", "matched_entry", "blocked")
    seen = captures.select(host(F.col(url)).alias("host"), F.col(at).alias("at")).where("host is not null and at is not null").distinct()
    seen = seen.withColumn("month", _month(F.col("at")))
    asked = seen.select("host", "at", "month", F.explode(suffixes(F.col("host"))).alias("entry"))
    first, last = seen.agg(F.min("month"), F.max("month")).first()  # two numbers
    known = intervals(entries).withColumns({"a": F.greatest(_month(F.col("since")), F.lit(first)), "z": F.least(F.coalesce(_month(F.col("until")), F.lit(last)), F.lit(last))}).where("a <= z")
    months = known.select("entry", "action", "since", "until", F.explode(F.sequence("a", "z")).alias("month"))
    active = asked.join(months, ["entry", "month"]).where((F.col("at") >= F.col("since")) & (F.col("until").isNull() | (F.col("at") < F.col("until"))))
    verdict = active.groupBy("host", "at").agg(F.max(F.struct(F.length("entry").alias("n"), "entry", "action")).alias("v"))
    h, t, v = (fresh(captures, x) for x in ("host_", "at_", "verdict_"))
    verdict = verdict.toDF(h, t, v)
    joined = captures.withColumn("host", host(F.col(url))).join(verdict, (F.col("host") == F.col(h)) & (captures[at] == F.col(t)), "left")
    return joined.select(*captures.columns, "host", F.col(f"{v}.entry").alias("matched_entry"), F.coalesce(F.col(f"{v}.action") == "block", F.lit(False)).alias("blocked"))

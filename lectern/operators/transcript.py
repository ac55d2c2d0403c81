"""Timed transcripts: parsing, speaker filter, merging and batching."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from lectern.functions.text import SPACE, hms, seconds, strip, word_count
from lectern.sources.tables import staged

MIN_QUESTION_WORDS, GAP, MIN_WORDS, BATCH_WORDS = 6, 30.0, 10, 800
#: Phrases that tell when a notebook is entered or left. They are flags; filtering goes by periods.
ENTRY = ["let me go.{0,15}notebook", "go.{0,10}notebook", "open.{0,10}notebook", "run.{0,10}cell", "let.{0,10}do.{0,10}exercise", "jupyter", "go.{0,10}code.{0,10}component", "go into the code"]
EXIT = ["go back.{0,15}slide", "back.{0,10}deck", "back.{0,10}presentation", "so we saw from the notebook", "from the exercise"]

#: What the cleaning rules of transcripts call noise. The first only counts with a question mark.
TAGS = ["right", "okay", "yeah", "you know", "is it"]
NOISE = [
    "so so basically basically", "i think i think", "right right right", "okay okay okay", "let me let me", "basically basically", "i mean i mean", "like like", "can can",
    "lah", "leh", "lor", "wah", "sia", "lo", "erm", "uhh", "hmm", "you know", "okay so", "alright so", "so so", "and and",
]
NOISE_PATTERN = rf"(?i)\b({'|'.join(TAGS)})\?|\b({'|'.join(NOISE)})\b[?,]?"


#: NOISE_PATTERN as RE2 reads it, for Java: ends of words go by ASCII, upper and lower case by Unicode.
_EDGE = "(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
_ASCII_NOISE = rf"{_EDGE}(?iu:{'|'.join(TAGS)})\?|{_EDGE}(?iu:{'|'.join(NOISE)}){_EDGE}[?,]?"
_ASCII_SPACE = r"[\t\n\f\r ]+"


def without_noise(text: Column, ascii_words: bool = False) -> Column:
    """Without fillers, particles, false starts and transitions; white space single.

    With ascii_words a word ends at any character but ASCII's letters, digits and _, and white space is ASCII's, as in SQL engines on RE2; "lo" is then noise before an ñ."""
    if ascii_words:
        return F.btrim(F.regexp_replace(F.regexp_replace(text, _ASCII_NOISE, " "), _ASCII_SPACE, " "))
    return strip(F.regexp_replace(F.regexp_replace(text, NOISE_PATTERN, " "), f"{SPACE}+", " "))


def parse_vtt(files: DataFrame) -> DataFrame:
    """Cues of (file, text): (file, pos, cue_id, ts_start, ts_end, ts_start_sec, ts_end_sec, speaker, raw_text)."""
    block = files.select("file", F.posexplode(F.split("text", r"\n\n+")).alias("pos", "b")).select("file", "pos", F.split("b", "\n").alias("lines"))
    at = F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), True).cast("int")
    timed = block.withColumn("at", at).where("at > 0").withColumn("t", F.split(F.get("lines", F.col("at") - 1), "-->")).where(F.size("t") == 2)
    body = F.array_join(F.filter(F.transform(F.slice("lines", F.col("at") + 1, F.size("lines")), strip), lambda x: x != ""), " ")
    cues = timed.select("file", "pos", F.when(F.col("at") > 1, strip(F.get("lines", F.lit(0)))).otherwise("").alias("cue_id"), strip(F.get("t", F.lit(0))).alias("ts_start"), F.get(F.split(strip(F.get("t", F.lit(1))), f"{SPACE}+"), F.lit(0)).alias("ts_end"), body.alias("body")).where("body <> ''")
    named = F.col("body").rlike(r"^[^:]+:\s*")
    speaker = F.when(named, strip(F.regexp_extract("body", r"^([^:]+):", 1))).otherwise("unknown")
    return cues.select("file", "pos", "cue_id", "ts_start", "ts_end", seconds(F.col("ts_start")).alias("ts_start_sec"), seconds(F.col("ts_end")).alias("ts_end_sec"), speaker.alias("speaker"), F.when(named, strip(F.regexp_extract("body", r"^[^:]+:\s*(.*)", 1))).otherwise(F.col("body")).alias("raw_text"))


def phrase_flags(cues: DataFrame) -> DataFrame:
    low = F.lower("raw_text")
    return cues.withColumns({"enters": low.rlike("|".join(ENTRY)), "leaves": low.rlike("|".join(EXIT))})


def drop_periods(cues: DataFrame, periods: Column) -> DataFrame:
    """Cues that start in none of the periods (array<array<double>>), whose both ends belong to them."""
    return cues.where(~F.exists(periods, lambda p: (F.col("ts_start_sec") >= p[0]) & (F.col("ts_start_sec") <= p[1])))


def pair_speakers(cues: DataFrame, teacher: Column, gap: float = GAP, min_words: int = MIN_QUESTION_WORDS) -> DataFrame:
    """Teacher cues, and questions of others that a teacher answers at once, with segment_type. A file is a group."""
    order = Window.partitionBy("file").orderBy("pos")
    marked = cues.withColumn("t", teacher).withColumns({"nt": F.lead("t").over(order), "ns": F.lead("ts_start_sec").over(order)})
    asks = ~F.col("t") & (word_count(F.col("raw_text")) >= min_words) & F.coalesce("nt", F.lit(False)) & (F.col("ns") - F.col("ts_end_sec") <= gap)
    marked = marked.withColumn("q", F.coalesce(asks, F.lit(False))).withColumn("a", F.coalesce(F.lag("q").over(order), F.lit(False)))
    kind = F.when(F.col("a"), "qa_answer").when(F.col("t"), "lecture").when(F.col("q"), "qa_question")
    return marked.withColumn("segment_type", kind).where("segment_type is not null").drop("t", "nt", "ns", "q", "a")


def merge_cues(cues: DataFrame, gap: float = GAP) -> DataFrame:
    """Runs of one speaker and type without a pause over the gap, as islands."""
    order = Window.partitionBy("file").orderBy("pos")
    same = (F.lag("speaker").over(order) == F.col("speaker")) & (F.lag("segment_type").over(order) == F.col("segment_type")) & (F.col("ts_start_sec") - F.lag("ts_end_sec").over(order) <= gap)
    runs = cues.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_text"))), lambda x: x["raw_text"]), " ")
    return runs.groupBy("file", "island", "speaker", "segment_type").agg(F.min("pos").alias("pos"), F.min_by("ts_start_sec", "pos").alias("ts_start_sec"), F.max_by("ts_end_sec", "pos").alias("ts_end_sec"), joined.alias("merged_text")).drop("island")


def qa_blocks(segments: DataFrame) -> DataFrame:
    """A question and the answer right after it become one segment."""
    order = Window.partitionBy("file").orderBy("pos")
    ask = (F.col("segment_type") == "qa_question") & (F.lead("segment_type").over(order) == "qa_answer")
    marked = segments.withColumns({"pair": F.coalesce(ask, F.lit(False)), "ntext": F.lead("merged_text").over(order), "nend": F.lead("ts_end_sec").over(order), "nspeaker": F.lead("speaker").over(order)})
    marked = marked.withColumn("used", F.coalesce(F.lag("pair").over(order), F.lit(False))).where("not used")
    pair = F.col("pair")
    return marked.select("file", "pos", F.when(pair, F.col("nspeaker")).otherwise(F.col("speaker")).alias("speaker"), F.when(pair, "qa").otherwise(F.col("segment_type")).alias("segment_type"), "ts_start_sec", F.when(pair, F.col("nend")).otherwise(F.col("ts_end_sec")).alias("ts_end_sec"), F.when(pair, F.concat(F.lit("[Q] "), "merged_text", F.lit(" [A] "), "ntext")).otherwise(F.col("merged_text")).alias("merged_text"))


def keep_long(segments: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    return segments.withColumn("word_count", word_count(F.col("merged_text"))).where(F.col("word_count") >= min_words)


def greedy_batches(segments: DataFrame, most: int = BATCH_WORDS) -> DataFrame:
    """segments with batch: a segment that doesn't fit (most words) opens the next batch of its file; a null word_count counts as 0.

    Rows are range-partitioned by (file, pos), so that one file is spread over as many tasks as it has rows for. What the
    part of a file in a task does depends only on the words that the batch open before it holds, at most `most` or one
    segment: a task writes this as a table of at most `most` + 2 steps, one task a file chains the tables, and the parts
    are then batched apart. Files within one task are done at once.
    """
    rows = segments.drop("batch")
    names, at_file, at_words = rows.columns, rows.columns.index("file"), rows.columns.index("word_count")
    part, steps = (next(n for n in (c + "_" * k for k in range(len(names) + 1)) if n not in names) for c in ("part", "steps"))
    file = rows.schema["file"].dataType.simpleString()
    added = StructType.fromDDL(f"batch long, {part} long, {steps} struct<total:long,at:array<long>,batches:array<long>,words:array<long>>")
    laid = rows.repartitionByRange("file", "pos").sortWithinPartitions("file", "pos")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for group, which in _files(batches, at_file):
            words = [w or 0 for w in group.column(at_words).to_pylist()]
            if which is None:
                batch, table, of = _batch(words, most)[0], None, None
            else:
                batch, table, of = [None] * len(words), _steps(words, most), 2 * task + which
            ends = [None] * (len(words) - 1) + [table]
            made = [pa.array(batch, pa.int64()), pa.array([of] * len(words), pa.int64()), pa.array(ends, to_arrow_type(added[2].dataType))]
            yield pa.RecordBatch.from_arrays([*group.columns, *made], [*names, "batch", part, steps])

    held = staged(laid.mapInArrow(cut, StructType(rows.schema.fields + added.fields)), "batched")
    tables = held.where(F.col(steps).isNotNull()).select("file", part, steps).repartition("file").sortWithinPartitions("file", part)

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, batch, words, begun = None, 0, 0, False
        for found in batches:
            out = []
            for name, of, table in zip(*(c.to_pylist() for c in found.columns), strict=True):
                if not begun or name != now:
                    now, batch, words, begun = name, 0, 0, True
                out.append((of, batch, words))
                batch, words = _after(table, batch, words, most)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)] if out else [pa.array([], pa.int64())] * 3, [part, "_batch", "_words"])

    starts = tables.mapInArrow(chain, f"{part} long, _batch long, _words long")
    parts = held.where(F.col(part).isNotNull()).drop("batch", steps).join(starts, part)
    parts = parts.repartition(part).sortWithinPartitions(part, "pos").select(*names, part, "_batch", "_words")

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, (0, 0)
        for found in batches:
            out = []
            words, of, batch, held_ = (found.column(k).to_pylist() for k in (at_words, len(names), len(names) + 1, len(names) + 2))
            for n, p, b, w in zip(words, of, batch, held_, strict=True):
                if p != now:
                    now, state = p, (b, w)
                made, *state = _batch([n or 0], most, *state)
                out += made
            yield pa.RecordBatch.from_arrays([*found.columns[: len(names)], pa.array(out, pa.int64())], [*names, "batch"])

    return held.where(F.col(part).isNull()).drop(part, steps).unionByName(parts.mapInArrow(filled, StructType(rows.schema.fields + added.fields[:1])))


def _batch(words: list[int], most: int, batch: int = 0, held: int = 0) -> tuple[list[int], int, int]:
    """The batch of each segment from a state on, and the state after them."""
    out = []
    for n in words:
        if held > 0 and held + n > most:
            batch, held = batch + 1, 0
        held += n
        out.append(batch)
    return out, batch, held


def _steps(words: list[int], most: int) -> dict:
    """What a run of segments does to the batch open before it: it ends at the first segment whose running total is over `most` less its words.
    For each such total in `at`, how many batches are opened from there on and how many words the last one holds then."""
    n, sums = len(words), list(accumulate(words, initial=0))
    opened, left = [0] * (n + 1), [0] * (n + 1)
    for k in range(n - 1, -1, -1):  # a batch that starts at k ends at the first segment after its first words with which it is over
        stop = max(k + 1, bisect_right(sums, sums[k], k), bisect_right(sums, sums[k] + most, k) - 1)
        opened[k], left[k] = (1 + opened[stop], left[stop]) if stop < n else (1, sums[n] - sums[k])
    at, batches, held = [], [], []
    for k in range(n):
        if sums[k] <= most and (not at or sums[k + 1] > at[-1]):
            at.append(sums[k + 1])
            batches.append(opened[k])
            held.append(left[k])
    return {"total": sums[n], "at": at, "batches": batches, "words": held}


def _after(table: dict, batch: int, words: int, most: int) -> tuple[int, int]:
    """The state after a run of segments."""
    if words == 0:  # the open batch is empty: the first segment with words is as if it opened it
        first = next((k for k, x in enumerate(table["at"]) if x > 0), None)
        return (batch, 0) if first is None else (batch + table["batches"][first] - 1, table["words"][first])
    k = bisect_right(table["at"], most - words)
    return (batch, words + table["total"]) if k == len(table["at"]) else (batch + table["batches"][k], table["words"][k])


def _files(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, int | None]]:
    """The rows of each file of a task, with 0 for the first and 1 for the last of them, which may go on in other tasks, None for others."""
    held, name, first = [], None, True
    for batch in batches:
        names = batch.column(at).to_pylist()
        start = 0
        for k in range(batch.num_rows + 1):
            if k == batch.num_rows or (held or k > start) and names[k] != name:
                if k > start:
                    held.append(batch.slice(start, k - start))
                if k < batch.num_rows and held:
                    yield _joined(held), 0 if first else None
                    held, first = [], False
                start = k
            if k < batch.num_rows:
                name = names[k]
    if held:
        yield _joined(held), 0 if first else 1


def _joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.concat_batches(parts) if len(parts) > 1 else parts[0]


def first_batches(batched: DataFrame, n: int = 3) -> DataFrame:
    """The rows of the first n batches of each file: a sample to look at before all is asked of a model."""
    return batched.where(F.col("batch") < n)


def published(segments: DataFrame) -> DataFrame:
    """Segments in the fields they are published with, in order of those; the hint of a topic is left to a model."""
    start, end = hms(F.col("ts_start_sec")), hms(F.col("ts_end_sec"))
    kind = F.coalesce("segment_type", F.lit("lecture"))
    return segments.select("file", "pos", F.lit("").alias("topic_hint"), start.alias("ts_start"), end.alias("ts_end"), "ts_start_sec", "ts_end_sec", "merged_text", kind.alias("segment_type"), word_count(F.col("merged_text")).alias("word_count"))


def batch_heads(batched: DataFrame) -> DataFrame:
    return batched.groupBy("file", "batch").agg(F.min_by("ts_start_sec", "pos").alias("first_start"), F.max_by("ts_end_sec", "pos").alias("last_end"), F.sum("word_count").alias("words"), F.count("*").alias("segments"))


def batch_prompts(batched: DataFrame) -> DataFrame:
    """(file, batch, prompt): the time range, the number and the texts of the segments of each batch, in order."""
    part = F.concat(F.lit("["), hms(F.col("ts_start_sec")), F.lit(" → "), hms(F.col("ts_end_sec")), F.lit("] ["), F.upper("segment_type"), F.lit("]\n"), "merged_text")
    held = batched.groupBy("file", "batch").agg(F.min_by("ts_start_sec", "pos").alias("a"), F.max_by("ts_end_sec", "pos").alias("z"), F.array_sort(F.collect_list(F.struct("pos", part.alias("t")))).alias("p"))
    head = F.concat(F.lit("Time range: "), hms(F.col("a")), F.lit(" → "), hms(F.col("z")), F.lit("\nSegments: "), F.size("p"))
    return held.select("file", "batch", F.concat(head, F.lit("\n\n"), F.array_join(F.transform("p", lambda x: x["t"]), "\n\n---\n\n")).alias("prompt"))

"""Benchmark decontamination in DataFrame operations alone: SimHash of item-sized windows, then exact verification.

1. Windows of each item's length are laid at every start, but only where they could be similar: a window at the
   threshold holds most of an item's five-word shingles, in any order, so those with less than `SHARE` of that many
   shingles of the benchmark are left out. That loses none and leaves most of a corpus without a window.
2. Each window and item gets a 64-bit SimHash of its words, a word weighing as often as it occurs.
3. Multi-index Hamming search: fingerprints are cut into 4 blocks of 16 bits. Of two fingerprints within the radius of
   15, one block at least differs in 15 // 4 = 3 bits at most, so the blocks of the items are spread to all their
   neighbours within 3 bits (697 a block) and an equi join on (length, block, bits) finds every pair within the radius.
   Two random fingerprints meet with a probability of 0.04. A pair is taken at the first block it meets in, once.
4. Candidates are verified by the exact weighted Jaccard similarity of their five-word shingles, the weight of a
   shingle being how often it occurs: sum of minima over sum of maxima, 0.8 or more.

A window just at 0.8 has lost a ninth of its words at most, which is 9 bits of distance expected with a deviation of
3; the tests measure the recall between 0.80 and 0.85. Shingles are compared by 64-bit hashes. The benchmark's shingles and block keys
are broadcast if they are at most a million rows; else those joins are shuffled. Hot passages make narrow rows, which are
gathered by document and length, no longer than the document, and become windows before they meet the texts.

Cases: words are lower-cased and split at [\\x20\\x09-\\x0D]. Null and empty texts have no window and are clean; a
document shorter than an item is compared whole. Very long texts have as many windows as places that share shingles.
An item of fewer than five words is one shingle of all its words, so it is found where those stand in a row; an item
without words is not searched for. Items with equal texts or ids are each reported once. A null doc_id is judged like
any other; rows that repeat a doc_id are judged each by its own text. Other columns keep their names, types and
values, whatever they are called, but the three output columns replace namesakes. Empty tables give no findings.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import SPACES, fresh, let, materialize, small

N = 5
THRESHOLD = 0.8
RADIUS = 15
BITS = 64
BLOCK = 16
SHARE = 0.5


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words of a text, in order."""
    stripped = F.btrim(F.lower(text), F.lit(SPACES))
    words = F.when(F.coalesce(stripped, F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(stripped, "[\\x20\\x09-\\x0D]+"))
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column, n: int = N) -> Column:
    """A hash of each n words in a row; none for a shorter text."""
    at = F.sequence(F.lit(0), F.size(hashes) - n)
    return F.when(F.size(hashes) >= n, F.transform(at, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(n))))).otherwise(F.array().cast("array<bigint>"))


def simhash(hashes: Column) -> Column:
    """Bit b is set where more of the words' hashes have it than have not."""
    one = F.lit(1).cast("long")
    ones = lambda b: F.aggregate(hashes, F.lit(0), lambda s, h: s + F.when(F.call_function("shiftrightunsigned", h, b).bitwiseAND(one) == 1, 1).otherwise(-1))
    return F.aggregate(F.sequence(F.lit(0), F.lit(BITS - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.when(ones(b) > 0, F.call_function("shiftleft", one, b)).otherwise(F.lit(0).cast("long"))))


def occurrences(grams: Column) -> Column:
    """Hashes of (shingle, how many times it came before): a set whose intersections are those of the multisets."""
    return let(F.array_sort(grams), lambda s: F.transform(s, lambda x, i: F.xxhash64(x, i + 1 - F.array_position(s, x))))


def block(fingerprint: Column, k: int) -> Column:
    return F.shiftrightunsigned(fingerprint, k * BLOCK).bitwiseAND(F.lit((1 << BLOCK) - 1).cast("long"))


def blocks(fingerprint: Column) -> Column:
    """Pairs of (block, bits)."""
    return F.explode(F.array(*(F.struct(F.lit(k).alias("block"), block(fingerprint, k).alias("bits")) for k in range(BITS // BLOCK))))


def neighbours(fingerprint: Column, radius: int = RADIUS) -> Column:
    """Pairs of (block, bits) of all fingerprints whose distance in a block is at most that of one block in the radius."""
    within = radius // (BITS // BLOCK)
    masks = F.lit([x for x in range(1 << BLOCK) if x.bit_count() <= within]).cast("array<bigint>")
    of_block = lambda k: F.transform(masks, lambda m: F.struct(F.lit(k).alias("block"), block(fingerprint, k).bitwiseXOR(m).alias("bits")))
    return F.explode(F.flatten(F.array(*map(of_block, range(BITS // BLOCK)))))


def first_meeting(a: Column, b: Column, radius: int = RADIUS) -> Column:
    """The first block in which a and b differ in few enough bits to meet."""
    within, apart = radius // (BITS // BLOCK), a.bitwiseXOR(b)
    return F.coalesce(*(F.when(F.bit_count(block(apart, k)) <= within, F.lit(k)) for k in range(BITS // BLOCK)))


def text_key(docs: DataFrame) -> list[Column]:
    """k1 and k2, which are never null and tell rows of unlike texts apart."""
    return [F.coalesce(docs["doc_id"].cast("long"), F.lit(0).cast("long")), F.xxhash64(docs["doc_id"].isNull(), docs["text"])]


def starts(at: Column, length: Column, threshold: float = THRESHOLD, n: int = N, share: float = 1.0) -> Column:
    """Every start of a window of this length with enough of the sorted places of shared shingles.

    With m shingles on both sides, c in common give c / (2 m - c), so enough to reach the threshold are
    2 threshold / (1 + threshold) m; a document shorter than the item has the start 0 alone and needs threshold * m.
    `share` of those is enough.
    """
    m = F.greatest(length - (n - 1), F.lit(1))
    needed = lambda x: F.greatest(F.ceil(m * F.lit(x * share) - F.lit(1e-9)).cast("int"), F.lit(1))
    most, none = needed(2 * threshold / (1 + threshold)), F.array().cast("array<int>")

    def of_run(i: Column) -> Column:  # windows whose first shared place is the i-th
        first, last = F.greatest(F.get(at, i + most - 1) - m + 1, F.coalesce(F.get(at, i - 1), F.lit(-1)) + 1), F.get(at, i)
        return F.when(first <= last, F.sequence(first, last)).otherwise(none)

    laid = F.when(F.size(at) >= most, F.flatten(F.transform(F.sequence(F.lit(0), F.size(at) - most), of_run))).otherwise(none)
    whole = F.when(F.size(F.filter(at, lambda p: p < m)) >= needed(threshold), F.array(F.lit(0))).otherwise(none)
    return F.array_union(whole, laid)


def findings(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS, n: int = N) -> DataFrame:
    """(k1, k2, item_id, similarity): the best window of each document for each item it holds."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), word_hashes(F.col("text")).alias("wh")).where(F.size("wh") > 0)
    items = items.withColumns({"len": F.size("wh"), "sh": F.when(F.size("wh") >= n, shingles(F.col("wh"), n)).otherwise(F.array(F.xxhash64("wh")))})
    items = materialize(items.withColumn("item_fp", simhash(F.col("wh"))).drop("wh"), "benchmark-items")
    marks = items.select("len", F.explode("sh").alias("h")).distinct()
    short = [r.len for r in items.where(F.col("len") < n).select("len").distinct().collect()]  # lengths under n
    texts = docs.select(text_key(docs)[0].alias("k1"), text_key(docs)[1].alias("k2"), "text")
    in_rows = lambda k, w: F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))
    of_texts = lambda grams: texts.select("k1", "k2", F.posexplode(let(word_hashes(F.col("text")), grams)).alias("pos", "h"))
    meet = lambda spots, of: spots.join(small(of, of.count()), "h").select("k1", "k2", "len", "pos")
    shared = meet(of_texts(lambda w: shingles(w, n)), marks.where(F.col("len") >= n))
    for k in short:
        shared = shared.unionAll(meet(of_texts(partial(in_rows, k)), marks.where(F.col("len") == k)))
    places = shared.groupBy("k1", "k2", "len").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    places = materialize(places.select("k1", "k2", "len", starts(F.col("at"), F.col("len"), threshold, n, SHARE).alias("starts")).where(F.size("starts") > 0), "windows")
    of_doc = places.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    held = small(of_doc.select("k1", "k2"), of_doc.count())
    found = texts.join(held, ["k1", "k2"], "left_semi").select("k1", "k2", word_hashes(F.col("text")).alias("wh")).dropDuplicates(["k1", "k2"])
    inside = F.array_distinct(F.transform("starts", lambda s: F.greatest(F.lit(0), F.least(s, F.size("wh") - F.col("len")))))
    cut = places.join(found, ["k1", "k2"]).select("k1", "k2", "len", "wh", F.explode(inside).alias("start")).select("k1", "k2", "len", "start", F.slice("wh", F.col("start") + 1, F.col("len")).alias("w"))
    prints = cut.withColumn("fp", simhash(F.col("w")))
    left = prints.withColumn("b", blocks(F.col("fp"))).select("*", "b.*").drop("b")
    keys = items.select("item_id", "len", "item_fp", neighbours(F.col("item_fp"), radius).alias("b")).select("item_id", "len", "item_fp", "b.*").distinct()
    near = left.join(small(keys, keys.count()), ["len", "block", "bits"])
    near = near.where((F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius) & (F.col("block") == first_meeting(F.col("fp"), F.col("item_fp"), radius)))
    grams = items.select("item_id", "len", "item_fp", occurrences(F.col("sh")).alias("item_grams")).distinct()
    pairs = near.select("k1", "k2", "item_id", "len", "item_fp", "w").join(small(grams, grams.count()), ["item_id", "len", "item_fp"])
    own = F.when(F.size("w") >= n, occurrences(shingles(F.col("w"), n))).otherwise(occurrences(F.array(F.xxhash64("w"))))
    pairs = pairs.select("k1", "k2", "item_id", own.alias("grams"), "item_grams")
    both = F.size(F.array_intersect("grams", "item_grams"))
    similar = pairs.select("k1", "k2", "item_id", (both / (F.size("grams") + F.size("item_grams") - both)).alias("similarity")).where(F.col("similarity") >= threshold)
    return similar.groupBy("k1", "k2", "item_id").agg(F.max("similarity").alias("similarity"))


def verdicts(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """docs with contaminated, item_ids (sorted) and similarity (the best, null if clean)."""
    docs = docs.drop("contaminated", "item_ids", "similarity")
    names = [fresh(docs, x) for x in ("k1", "k2", "ids", "best")]
    k1, k2, ids, best = names
    found = findings(docs, benchmark, threshold, radius).groupBy("k1", "k2").agg(F.array_sort(F.collect_set("item_id")), F.round(F.max("similarity"), 6)).toDF(*names)
    found = materialize(found, "contaminated")
    keyed = docs.withColumns(dict(zip((k1, k2), text_key(docs), strict=True)))
    joined = keyed.join(small(found, found.count()), [k1, k2], "left")
    return joined.select(*docs.columns, F.col(ids).isNotNull().alias("contaminated"), F.coalesce(ids, F.array().cast("array<bigint>")).alias("item_ids"), F.col(best).alias("similarity"))

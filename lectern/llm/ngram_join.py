"""N-gram Jaccard self-join of documents: MinHash banding, then exact verification on the full n-gram sets.

1. sketch(): a row for each document with a 128-bit digest of its n-gram set and its band keys. Band and row counts
   are chosen for a target recall at the similarity threshold.
2. Documents with the same n-gram set are one class from here on; its size counts its copies.
3. Band keys are shuffled; a bucket is a key that two classes or more share. Buckets with the same members (most
   bands of a group of near copies) count once. A bucket is cut into tiles of TILE members and GRAMS_PER_TILE
   n-grams or so by a hash of its members, and each pair of tiles is verified by itself, so no task holds a whole large
   bucket. A set goes to as many places as its bucket has tiles: of a bucket of n texts n^2 / TILE sets are shuffled.
4. In a task, the n-gram sets of two tiles meet as one incidence matrix whose products are the intersection sizes, so
   every candidate pair is verified exactly. A pair that shares several buckets counts in the first of them. What
   leaves is one row a member: the weighted number of its links and the smallest member it links to; pairs never do.
5. Connected components of those star edges, by alternating large and small stars over written tables, give the
   class id: the smallest doc_id of the group.

Cases: an n-gram set is of lower-cased words split at [\\x20\\x09-\\x0D]; a text with fewer than n words has the one
n-gram of all its words. A null, empty or blank text has no n-grams and links to nothing, so it is a group of its
own. A null doc_id takes part in no link: its class_id is null and its n_links 0. Rows that repeat a doc_id are one
document if their sets are equal; else both sets count under the one doc_id. Very long texts are verified whole, in
slices of columns. Other columns of docs are not returned. Empty tables give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import SPACES, bounded, materialize, small

N = 5
THRESHOLD = 0.8
RECALL = 0.9999
MAX_HASHES = 128
TILE = 512
GRAMS_PER_TILE = 500_000
SLICE = 4096
LINKS_PER_PART = 1000
_SPLIT = str.maketrans({c: " " for c in SPACES})
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, most: int = MAX_HASHES) -> tuple[int, int]:
    """The most rows a band, and then the fewest bands, with which a pair at the threshold meets with probability `recall`."""
    best = (most, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = math.ceil(math.log(1 - recall) / math.log(1 - p)) if p < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * _MIX[0]
    h = (h ^ (h >> np.uint64(33))) * _MIX[1]
    return h ^ (h >> np.uint64(33))


class WordHashes(dict):
    """64-bit hashes of words, kept while there are not too many."""

    def __missing__(self, word: str) -> int:
        if len(self) > 50_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def ngram_set(text: str | None, hashes: WordHashes, n: int = N) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-grams."""
    words = (text or "").lower().translate(_SPLIT).split(" ")
    h = np.array([hashes[w] for w in words if w], np.uint64)
    if not len(h):
        return h
    with np.errstate(over="ignore"):
        width = min(n, len(h))
        grams = np.zeros(len(h) - width + 1, np.uint64)
        for k in range(width):
            grams = _mix(grams * np.uint64(31) + h[k : len(h) - width + 1 + k])
    return np.unique(grams)


def _permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    made = np.random.Generator(np.random.PCG64(20240229)).integers(0, 2**63, (2, count), dtype=np.uint64)
    return made[0] * np.uint64(2) + np.uint64(1), made[1]


def minhash(grams: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of (a g + b) >> 16 for each permutation, with bounded memory for long texts."""
    least = np.full(len(a), np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(grams), 4096):
            least = np.minimum(least, ((a[:, None] * grams[None, at : at + 4096] + b[:, None]) >> np.uint64(16)).min(axis=1))
    return least


def sketch(docs: DataFrame, n: int = N, bands: int | None = None, rows: int | None = None) -> DataFrame:
    """(doc_id, d1, d2, n_grams, keys): the digest of the n-gram set and a 64-bit key for each band."""
    chosen = choose_bands()
    bands, rows = bands or chosen[0], rows or chosen[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (a, b) = WordHashes(), _permutations(bands * rows)
        for batch in batches:
            digests, sizes, keys = [], [], []
            for text in batch.column(1):
                grams = ngram_set(text.as_py(), hashes, n)
                sizes.append(len(grams))
                digests.append(xxhash.xxh3_128_digest(grams.tobytes()))
                least = minhash(grams, a, b).reshape(bands, rows)
                with np.errstate(over="ignore"):
                    key = np.arange(bands, dtype=np.uint64)
                    for k in range(rows):
                        key = _mix(key * np.uint64(31) + least[:, k])
                keys.append(key.view(np.int64) if len(grams) else None)
            d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "d1", "d2", "n_grams", "keys"])

    return bounded(docs.select(F.col("doc_id").cast("long"), "text")).mapInArrow(run, "doc_id long, d1 long, d2 long, n_grams long, keys array<long>")


def _verify(tiles: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links of each pair of tiles. Rows come sorted by (bucket, i, j); a pair of tiles is held at a time."""
    held: list[pd.DataFrame] = []
    key = None
    for frame in tiles:
        ends = np.flatnonzero((frame[["bucket", "i", "j"]].to_numpy()[1:] != frame[["bucket", "i", "j"]].to_numpy()[:-1]).any(axis=1)) + 1
        for part in np.split(np.arange(len(frame)), ends):
            rows = frame.iloc[part]
            if len(rows) and (now := tuple(rows[["bucket", "i", "j"]].iloc[0])) != key:
                if held:
                    yield from _links(pd.concat(held), threshold)
                held, key = [], now
            if len(rows):
                held.append(rows)
    if held:
        yield from _links(pd.concat(held), threshold)


def _incidence(sets: list[np.ndarray], columns: int) -> np.ndarray:
    m = np.zeros((len(sets), columns), np.float32)
    for k, s in enumerate(sets):
        m[k, s] = 1
    return m


def _links(rows: pd.DataFrame, threshold: float) -> Iterator[pd.DataFrame]:
    left, right = rows[rows["tile"] == rows["i"].iloc[0]], rows[rows["tile"] == rows["j"].iloc[0]]
    same = rows["i"].iloc[0] == rows["j"].iloc[0]
    if not len(left) or not len(right) or (same and len(left) < 2):
        return
    both = left if same else pd.concat([left, right])
    sets = [np.frombuffer(g, np.uint64) for g in both["grams"]]
    common, codes = np.unique(np.concatenate(sets), return_inverse=True)
    seen = np.bincount(codes, minlength=len(common))
    where = np.cumsum(seen >= 2) - 1  # an n-gram that one member has alone is in no intersection
    coded = [where[c[seen[c] >= 2]] for c in np.split(codes, np.cumsum([len(s) for s in sets])[:-1])]
    split, width = len(left), int(where[-1] + 1) if len(where) else 0
    a, b = coded[:split], coded if same else coded[split:]
    shared = np.zeros((len(a), len(b)), np.float64)
    order = [np.sort(c) for c in coded]
    for at in range(0, width, SLICE):  # in slices, so that long texts don't need wide matrices
        cut = [c[np.searchsorted(c, at) : np.searchsorted(c, at + SLICE)] - at for c in order]
        x = _incidence(cut[:split], min(SLICE, width - at))
        shared += x @ (x if same else _incidence(cut[split:], min(SLICE, width - at))).T
    sizes = np.array([len(s) for s in sets], np.float64)
    union = sizes[:split, None] + (sizes[None, :split] if same else sizes[None, split:]) - shared
    linked = shared >= threshold * union - 1e-9
    if same:
        np.fill_diagonal(linked, False)
    bucket, ids, copies = rows["bucket"].iloc[0], both["doc_id"].to_numpy(np.int64), both["copies"].to_numpy(np.int64)
    earlier = [np.frombuffer(x, np.int64) for x in both["buckets"]]
    earlier = [x[x < bucket] for x in earlier]  # pairs that share an earlier bucket count there
    if linked.any() and any(len(x) for x in earlier):
        names, at = np.unique(np.concatenate(earlier), return_inverse=True)
        m = _incidence(np.split(at, np.cumsum([len(x) for x in earlier])[:-1]), len(names))
        linked &= ~((m[:split] @ (m if same else m[split:]).T) > 0)
    ra, rb = (ids[:split], ids) if same else (ids[:split], ids[split:])
    ca, cb = (copies[:split], copies) if same else (copies[:split], copies[split:])
    top = np.iinfo(np.int64).max
    out = pd.DataFrame({"doc_id": ra, "links": linked.astype(np.int64) @ cb, "to": np.where(linked, rb[None, :], top).min(axis=1)})
    if not same:
        out = pd.concat([out, pd.DataFrame({"doc_id": rb, "links": linked.T.astype(np.int64) @ ca, "to": np.where(linked, ra[:, None], top).min(axis=0)})])
    # the smallest neighbour of each member is not enough to join a tile: add the roots of its own components
    if linked.any():
        out = pd.concat([out, _roots(ra, rb, linked)])
    yield out[(out["links"] > 0) | (out["to"] < top)].astype({"doc_id": "int64", "links": "int64", "to": "int64"})


def _roots(ra: np.ndarray, rb: np.ndarray, linked: np.ndarray) -> pd.DataFrame:
    """A star for each component that the links of two tiles make: (member, 0, root)."""
    la, lb = ra.copy(), rb.copy()
    top = np.iinfo(np.int64).max
    while True:  # the least label spreads along the links
        na = np.minimum(la, np.where(linked, lb[None, :], top).min(axis=1))
        nb = np.minimum(lb, np.where(linked, na[:, None], top).min(axis=0))
        if (na == la).all() and (nb == lb).all():
            break
        la, lb = na, nb
    ids, roots = np.concatenate([ra, rb]), np.concatenate([la, lb])
    return pd.DataFrame({"doc_id": ids, "links": 0, "to": roots})[ids != roots]


def _in_parts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (u, v) joined with nodes (u, m, n), n edges each; the edges of a node with many are dealt to parts by v."""
    nodes = nodes.withColumn("parts", F.ceil(F.col("n") / LINKS_PER_PART).cast("int"))
    hot = materialize(nodes.where("parts > 1").select("u", "parts"), "hot-nodes")
    marked = edges.join(small(hot, hot.count()), "u", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("v"), "parts"), F.lit(0)).cast("int")).drop("parts")
    return marked.join(nodes.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("u", "m", "part"), ["u", "part"])


def components(edges: DataFrame, tag: str = "stars") -> DataFrame:
    """(doc_id, root) of every node of edges (doc_id, to): the smallest node it is connected to. Large and small stars in turn."""
    now = materialize(edges.where("doc_id <> to").select(F.greatest("doc_id", "to").alias("u"), F.least("doc_id", "to").alias("v")).distinct(), tag)
    last = None
    while True:
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = _in_parts(both, least).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = materialize(large.distinct(), tag)
        lows = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small_ = _in_parts(large, lows)
        now = materialize(small_.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(lows.select("u", F.col("m").alias("v"))).distinct(), tag)
        sign = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == last:
            return now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "doc_id")
        last = sign


def join(docs: DataFrame, threshold: float = THRESHOLD, n: int = N, recall: float = RECALL, tile: int = TILE) -> DataFrame:
    """(doc_id, class_id, n_links, copies, n_grams), a row for each row of docs. n_links counts the other documents at or over the threshold."""
    bands, rows = choose_bands(threshold, recall)
    sketched = materialize(sketch(docs, n, bands, rows), "sketches")
    known = sketched.where("doc_id is not null and n_grams > 0")
    classes = known.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count_distinct("doc_id").alias("copies"), F.first("keys").alias("keys"), F.max("n_grams").alias("n_grams"))
    classes = materialize(classes, "classes")
    member = classes.select("rep", "n_grams", F.posexplode("keys").alias("band", "key"))
    buckets = member.groupBy("key").agg(F.count("*").alias("n"), F.sum("n_grams").alias("grams"), F.sum(F.xxhash64("rep").cast("decimal(38,0)")).alias("s1"), F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high")
    buckets = buckets.groupBy("n", "grams", "s1", "low", "high").agg(F.min("key").alias("bucket"))
    kept = buckets.select("bucket", F.ceil(F.greatest(F.col("n") / tile, F.col("grams") / GRAMS_PER_TILE)).cast("int").alias("tiles"))
    held = materialize(member.join(kept, member["key"] == kept["bucket"]).select("rep", "bucket", "tiles"), "buckets")
    of = held.groupBy("rep").agg(F.array_sort(F.collect_set("bucket")).alias("all"))  # at most one for each band
    n_of = of.count()
    copies = classes.groupBy("rep").agg(F.max("copies").alias("copies"))
    wanted = of.join(copies, "rep")

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            found = [ngram_set(t.as_py(), hashes, n) for t in batch.column(1)]
            packed = [np.array(x, np.int64).tobytes() for x in batch.column(3).to_pylist()]
            digests = [int.from_bytes(xxhash.xxh3_128_digest(x.tobytes())[:8], "little", signed=True) for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(packed, pa.binary()), pa.array(digests, pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], ["doc_id", "copies", "buckets", "d1", "grams"])

    texts = docs.select(F.col("doc_id").cast("long"), "text").join(small(wanted.withColumnRenamed("rep", "doc_id"), n_of, 200_000), "doc_id").select("doc_id", "text", "copies", "all")
    sets = bounded(texts).mapInArrow(grams, "doc_id long, copies long, buckets binary, d1 long, grams binary").dropDuplicates(["doc_id", "d1"])
    tiled = held.withColumn("tile", F.pmod(F.xxhash64("rep", F.lit(7)), "tiles").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiled = tiled.select(F.col("rep").alias("doc_id"), "bucket", "tile", F.least("tile", "other").alias("i"), F.greatest("tile", "other").alias("j"))
    met = tiled.join(sets, "doc_id").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")
    links = materialize(bounded(met).mapInPandas(lambda x: _verify(x, threshold), "doc_id long, links long, to long"), "links")
    totals = links.groupBy("doc_id").agg(F.sum("links").alias("links"))
    roots = components(links.where(F.col("to") < 2**63 - 1).select("doc_id", "to"))
    each = classes.select("d1", "d2", "rep", "copies").join(totals.withColumnRenamed("doc_id", "rep"), "rep", "left").join(roots.withColumnRenamed("doc_id", "rep"), "rep", "left")
    each = each.select("d1", "d2", F.coalesce("root", "rep").alias("class_id"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "copies")
    out = sketched.select("doc_id", F.when(F.col("n_grams") > 0, F.col("d1")).alias("d1"), "d2", "n_grams").join(each, ["d1", "d2"], "left")
    real = F.col("doc_id").isNotNull()
    return out.select("doc_id", F.when(real, F.coalesce("class_id", "doc_id")).alias("class_id"), F.when(real, F.coalesce("links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(real, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"), "n_grams")

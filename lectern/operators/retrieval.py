"""Vector retrieval: exact cosine top-k with soft boosts, source weights and a second pass."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weights of source types; others weigh 1.
SOURCE_WEIGHTS = {"pdf": 1.2, "textbook": 1.2, "transcript": 0.9}
BOOST = 0.15
QUERIES_PER_PASS = 20_000


def _dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)


def cosine(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    norm = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when(norm > 0, _dot(a, b) / norm).otherwise(0.0)


def usable(chunks: DataFrame, dim: int) -> DataFrame:
    """The chunks whose embedding has dim numbers; the others can't be compared."""
    return chunks.where((F.size("embedding") == dim) & ~F.exists("embedding", lambda x: x.isNull()))


def top_k(chunks: DataFrame, query: list[float], k: int, module: str = "", boost: float = BOOST) -> DataFrame:
    """The k best chunks for one query vector with rank and score; the boost decides who is in, the score stays pure.

    Ids and vectors alone are scored and sorted; the other columns join the k ids. Ids are unique.
    """
    given, length = F.array(*(F.lit(float(x)) for x in query)), math.sqrt(sum(float(x) ** 2 for x in query))
    narrow = usable(chunks.select("id", "embedding", *(["mod"] if module else [])), len(query))
    norm = F.sqrt(_dot(F.col("embedding"), F.col("embedding"))) * length
    scored = narrow.withColumn("score", F.round(F.when(norm > 0, _dot(F.col("embedding"), given) / norm).otherwise(0.0), 6))
    lifted = F.round(F.col("score") + F.when(F.col("mod") == module, boost).otherwise(0.0), 6) if module else F.col("score")
    order = [F.desc("lifted"), F.col("id")]
    best = scored.select("id", "score", lifted.alias("lifted")).orderBy(*order).limit(k)
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(*order))).drop("lifted")  # over k rows
    return chunks.drop("score", "rank").join(F.broadcast(best), "id")  # k rows


def top_k_many(chunks: DataFrame, queries: DataFrame, k: int, boost: float = 0.0) -> DataFrame:
    """(qid, id, score, rank) for queries (qid, embedding): tasks hold a block of queries and the k best of all they read for each.

    With a boost, queries and chunks have mod as well, and chunks of a query's own module rank higher by it; the score stays pure.
    Vectors that are null or of another length than the queries' are left out, queries without a vector have no rows.
    """
    queries = queries.where("embedding is not null")
    n_passes = max(1, -(-queries.count() // QUERIES_PER_PASS))
    out = None
    for p in range(n_passes):
        asked = queries.where(F.pmod(F.xxhash64("qid"), F.lit(n_passes)) == p).orderBy("qid").toPandas()
        block = _block(chunks, asked, k, boost)
        out = block if out is None else out.unionAll(block)
    order = Window.partitionBy("qid").orderBy(F.desc("boosted"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("boosted")


def _block(chunks: DataFrame, asked: pd.DataFrame, k: int, boost: float) -> DataFrame:
    matrix = np.array(asked["embedding"].tolist(), np.float64).reshape(len(asked), -1) if len(asked) else np.zeros((0, 0))
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-300)
    modules = asked["mod"].fillna("").tolist() if boost else []
    shared = chunks.sparkSession.sparkContext.broadcast((asked["qid"].to_numpy(np.int64), matrix, modules))  # QUERIES_PER_PASS rows at most

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qids, q, mods = shared.value
        held: list[tuple[np.ndarray, ...] | None] = [None] * len(qids)  # (lifted, id, score) of the k best so far
        for frame in frames:
            if not len(frame) or not len(qids):
                continue
            v = np.array(frame["embedding"].tolist(), np.float64)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            ids = frame["id"].to_numpy(np.int64)
            of = frame["mod"].to_numpy() if boost else None
            for at in range(0, len(qids), 256):
                scores = np.round(q[at : at + 256] @ v.T, 6)
                for n, s in enumerate(scores):
                    own = boost and mods[at + n]
                    lifted = np.round(s + boost * (of == own), 6) if own else s
                    least = np.partition(lifted, len(lifted) - k)[-k] if len(lifted) > k else -np.inf
                    if held[at + n] is not None and len(held[at + n][0]) == k:
                        least = max(least, held[at + n][0][-1])
                    some = np.flatnonzero(lifted >= least)  # ties with the k-th as well
                    if len(some):
                        found = [(lifted[some], ids[some], s[some])] + ([held[at + n]] if held[at + n] is not None else [])
                        all_ = [np.concatenate(x) for x in zip(*found, strict=True)]
                        best = np.lexsort((all_[1], -all_[0]))[:k]
                        held[at + n] = tuple(x[best] for x in all_)
        for qid, best in zip(qids, held, strict=True):
            if best is not None:
                yield pd.DataFrame({"qid": qid, "id": best[1], "score": best[2], "boosted": best[0]})

    narrow = usable(chunks.select("id", "embedding", *(["mod"] if boost else [])), matrix.shape[1]) if len(asked) else chunks.select("id", "embedding", *(["mod"] if boost else [])).limit(0)
    return narrow.mapInPandas(rows, "qid long, id long, score double, boosted double")


def weigh(found: DataFrame) -> DataFrame:
    """Scores times the weight of their source, at most 1, in a stable order: new_rank."""
    weight = F.coalesce(*(F.when(F.col("source_type") == s, F.lit(w)) for s, w in SOURCE_WEIGHTS.items()), F.lit(1.0))
    weighed = found.withColumn("weighted", F.round(F.least(F.col("score") * weight, F.lit(1.0)), 6))
    return weighed.withColumn("new_rank", F.row_number().over(Window.orderBy(F.desc("weighted"), "rank")))  # over the k rows found


def second_pass(first: DataFrame, again: DataFrame) -> DataFrame:
    """first, then the rows of again with unseen ids behind them; nothing is sorted anew."""
    unseen = again.join(first.select("id"), "id", "left_anti")
    marked = first.select("*", F.lit(1).alias("pass")).unionByName(unseen.select(*first.columns, F.lit(2).alias("pass")))
    return marked.withColumn("position", F.row_number().over(Window.orderBy("pass", "new_rank")))  # over two result lists


def module_summary(found: DataFrame) -> DataFrame:
    return found.agg(F.array_join(F.sort_array(F.collect_set(F.when(F.col("mod") != "", F.col("mod")))), ", ").alias("modules"))


def context(found: DataFrame, limit: int) -> DataFrame:
    """One numbered context text of the chunks in order."""
    part = F.struct("rank", F.format_string("[%d] %s", F.col("rank"), F.substring("text", 1, limit)).alias("t"))
    return found.agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["t"]), "\n\n").alias("context"))


def locator(metadata: Column, *keys: str) -> Column:
    """Where in its file a chunk stands: the first of the keys that its metadata, a JSON object, has as text; null if none, or if it isn't JSON."""
    return F.coalesce(*(F.get_json_object(metadata, f"$.{k}") for k in keys), F.lit(None).cast("string"))

"""An inverted-file index of vectors: lists round centroids, cut into blocks by the angle to the centroid.

    path/centroids   list, centroid: a unit vector
    path/blocks      a folder a list; a row is a block of vectors of one list with the least and greatest angle to its centroid

Angles of unit vectors obey the triangle inequality: a vector at the angle a to a centroid is at least |a - t| from a query
at t. A search takes the best of the lists nearest to each query first (`probes`); the exact search goes on to the blocks
that this bound doesn't rule out. A list that holds much of the table is many blocks, and files end anywhere in it.

Queries are packed into blocks like the vectors, and a pair of blocks is one matrix product in a task, so neither
queries nor vectors pass through the driver. Only the centroids do, `lists` rows at most.

Cases: vectors that are null, of another length or not finite are left out, and so are queries with one. A vector of no length
has the score 0 with all. Ties go to the smaller id. No vectors: no rows. Ids and qids are unique; other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.operators.retrieval import usable
from lectern.sources.tables import staged

#: Rows that the centroids are fitted on; all rows are indexed.
SAMPLE = 100_000
#: Numbers in a block, 256 KB.
BLOCK = 65_536
#: Scores are compared at six digits.
MARGIN = 2e-6
PACKED = "list int, block long, low double, high double, ids array<long>, vectors array<float>"


def _units(v: np.ndarray) -> np.ndarray:
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _matrix(series: pd.Series, dim: int) -> np.ndarray:
    return np.array(series.tolist(), np.float64).reshape(-1, dim)


def _finite(vectors: DataFrame, dim: int) -> DataFrame:
    x = lambda v: F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return usable(vectors, dim).where(~F.exists("embedding", x))


def centroids(vectors: DataFrame, dim: int, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """Unit centroids by spherical k-means on the rows of the least hashes; a single zero where nothing can be fitted."""
    given = _finite(vectors.select("id", "embedding"), dim).where(F.exists("embedding", lambda x: x != 0))
    fitted = staged(given.orderBy(F.xxhash64("id"), "id").limit(sample).select("embedding"), "index-sample")
    if fitted.isEmpty():
        return np.zeros((1, dim))
    points = fitted.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"))
    model = KMeans(k=max(2, lists), distanceMeasure="cosine", maxIter=10, seed=7).fit(points)
    return _units(np.array(model.clusterCenters()))


def _pack(vectors: DataFrame, near: np.ndarray, dim: int) -> DataFrame:
    """Blocks of (id, embedding), each of one list, in order of the angle to its centroid."""
    shared = vectors.sparkSession.sparkContext.broadcast(near)  # `lists` rows
    rows_a_block = max(1, BLOCK // dim)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                cos = _units(_matrix(frame["embedding"], dim)) @ shared.value.T
                of = cos.argmax(axis=1)
                angle = np.arccos(np.clip(cos[np.arange(len(of)), of], -1, 1))
                yield pd.DataFrame({"list": of.astype(np.int32), "angle": angle, "id": frame["id"], "embedding": frame["embedding"]})

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = None, TaskContext.get().partitionId() << 32
        for frame in frames:
            held = frame if held is None else pd.concat([held, frame], ignore_index=True)
            blocks = []
            while len(held) and (len(held) > rows_a_block or held["list"].iloc[0] != held["list"].iloc[-1]):
                take = min(rows_a_block, int((held["list"] == held["list"].iloc[0]).sum()))
                blocks.append(held.iloc[:take])
                held = held.iloc[take:]
            for b in blocks:
                yield one(b, n)
                n += 1
        if held is not None and len(held):
            yield one(held, n)

    def one(b: pd.DataFrame, n: int) -> pd.DataFrame:
        b = b.sort_values("id")  # so that columns of equal scores are in order of their ids
        flat = _matrix(b["embedding"], dim).astype(np.float32).ravel()
        return pd.DataFrame({"list": [b["list"].iloc[0]], "block": [n], "low": [b["angle"].min()], "high": [b["angle"].max()], "ids": [b["id"].to_numpy(np.int64)], "vectors": [flat]})

    given = _finite(vectors.select("id", "embedding"), dim).select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    dealt = given.mapInPandas(assign, "list int, angle double, id long, embedding array<float>").repartitionByRange("list", "angle", "id")
    return dealt.sortWithinPartitions("list", "angle", "id").mapInPandas(cut, PACKED)


def build(vectors: DataFrame, path: str, dim: int = 64, lists: int = 64, sample: int = SAMPLE) -> None:
    """Writes the index of vectors (id, embedding) at a new path."""
    near = centroids(vectors, dim, lists, sample)
    spark = vectors.sparkSession
    spark.createDataFrame([(k, row.tolist()) for k, row in enumerate(near)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    _pack(vectors, near, dim).write.partitionBy("list").parquet(f"{path}/blocks")


def blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED).parquet(f"{path}/blocks")


def search(spark: SparkSession, path: str, queries: DataFrame, k: int, probes: int = 1, exact: bool = True) -> DataFrame:
    """(qid, id, score, rank): the k best of the index for each of queries (qid, embedding), by score, then id.

    Exact, or among the `probes` lists nearest to each query at least. Nothing is computed for blocks out of reach, and
    folders of lists that no query reaches aren't read.
    """
    near = np.array([r.centroid for r in spark.read.parquet(f"{path}/centroids").orderBy("list").collect()])  # `lists` rows
    dim = near.shape[1]
    asked = staged(_pack(queries.withColumnRenamed("qid", "id"), near, dim).select(F.col("block").alias("asked"), F.col("ids").alias("qids"), F.col("vectors").alias("asking"), F.transform("ids", lambda _: F.lit(-2.0)).alias("least")), "packed-queries")
    first = staged(_visits(spark, path, _reach(asked, near, probes)), "visits")
    found = staged(_ranked(_score(spark, path, first, asked, dim, k), k), "probed")
    if not exact:
        return found
    least = found.groupBy("qid").agg(F.when(F.count("*") == k, F.min("score")).otherwise(-2.0).alias("kth"))
    each = asked.select("asked", F.posexplode("qids").alias("at", "qid")).join(least, "qid", "left")
    bounds = each.groupBy("asked").agg(F.array_sort(F.collect_list(F.struct("at", F.coalesce("kth", F.lit(-2.0)).alias("kth")))).alias("b"))  # a block's queries
    bound = staged(asked.drop("least").join(bounds.select("asked", F.transform("b", lambda x: x["kth"]).alias("least")), "asked"), "bounded-queries")
    more = staged(_visits(spark, path, _reach(bound, near)).join(first, ["asked", "block"], "left_anti"), "further-visits")
    return _ranked(found.drop("rank").unionByName(_score(spark, path, more, bound, dim, k)), k)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _reach(asked: DataFrame, near: np.ndarray, probes: int | None = None) -> DataFrame:
    """(asked, list, least, most): for each block of queries the lists to visit, and between which angles; by the bound if there are no probes."""
    shared = asked.sparkSession.sparkContext.broadcast(near)

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        for frame in frames:
            for block, flat, least in zip(frame["asked"], frame["asking"], frame["least"], strict=True):
                cos = _units(np.asarray(flat, np.float64).reshape(-1, c.shape[1])) @ c.T
                if probes:
                    n = min(probes, len(c))
                    to = np.unique(np.argpartition(-cos, n - 1, axis=1)[:, :n])
                    low, high = np.zeros(len(to)), np.full(len(to), 4.0)
                else:
                    angle = np.arccos(np.clip(cos, -1, 1))
                    within = np.arccos(np.clip(np.asarray(least, np.float64) - MARGIN, -1, 1))[:, None] + 1e-6
                    to, low, high = np.arange(len(c)), (angle - within).min(axis=0), (angle + within).max(axis=0)
                yield pd.DataFrame({"asked": block, "list": to.astype(np.int32), "least": low, "most": high})

    return asked.select("asked", "asking", "least").mapInPandas(rows, "asked long, list int, least double, most double")


def _visits(spark: SparkSession, path: str, reach: DataFrame) -> DataFrame:
    """(asked, list, block) of the pairs of blocks within reach."""
    met = (F.col("high") >= F.col("least")) & (F.col("low") <= F.col("most"))
    return reach.join(blocks(spark, path).select("list", "block", "low", "high"), "list").where(met).select("asked", "list", "block")


def _score(spark: SparkSession, path: str, visits: DataFrame, asked: DataFrame, dim: int, k: int) -> DataFrame:
    """(qid, id, score): of each pair of blocks the k best for each query that aren't below its least."""
    reached = [r.list for r in visits.select("list").distinct().collect()]  # of `lists`

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for qids, asking, least, ids, vectors in frame.itertuples(index=False):
                q, v = (_units(np.asarray(x, np.float64).reshape(-1, dim)) for x in (asking, vectors))
                for at in range(0, len(q), 256):
                    s = np.round(q[at : at + 256] @ v.T, 6)
                    floor = np.asarray(least)[at : at + 256] - MARGIN
                    if s.shape[1] > k:
                        floor = np.maximum(floor, -np.partition(-s, k - 1, axis=1)[:, k - 1])
                    row, col = np.nonzero(s >= floor[:, None])
                    order = np.lexsort((col, -s[row, col], row))  # ids rise with the columns
                    row, col = row[order], col[order]
                    place = np.arange(len(row)) - np.searchsorted(row, row)
                    row, col = row[place < k], col[place < k]
                    if len(row):
                        yield pd.DataFrame({"qid": np.asarray(qids)[at + row], "id": np.asarray(ids)[col], "score": s[row, col] + 0.0})

    held = blocks(spark, path).where(F.col("list").isin(reached)).select("block", "ids", "vectors")
    pairs = visits.select("asked", "block").join(asked, "asked").join(held, "block")
    return pairs.select("qids", "asking", "least", "ids", "vectors").mapInPandas(rows, "qid long, id long, score double")

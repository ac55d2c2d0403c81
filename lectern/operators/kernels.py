"""Small numeric kernels as DataFrame expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def knn_vote(points: DataFrame, at: list[float], k: int) -> DataFrame:
    """The label of one point by the votes of its k nearest (id, x, y, label): 1 if more than half say so."""
    d = F.round(F.hypot(F.col("x") - at[0], F.col("y") - at[1]), 6)
    nearest = points.withColumn("d", d).orderBy("d", "id").limit(k)
    return nearest.agg(F.sum("label").alias("votes"), F.when(F.sum("label") > k / 2, 1).otherwise(0).alias("label"))


def kmeans(points: DataFrame, centroids: list[tuple[float, float]], steps: int) -> list[tuple[float, float]]:
    """Lloyd steps; of equally near centroids the first wins and an empty cluster stays. Only sums by cluster leave the tasks."""
    for _ in range(steps):
        near = F.array_min(F.array(*(F.struct(F.round((F.col("x") - x) ** 2 + (F.col("y") - y) ** 2, 9).alias("d"), F.lit(k).alias("c")) for k, (x, y) in enumerate(centroids))))["c"]
        moved = {r.c: (r.x, r.y) for r in points.groupBy(near.alias("c")).agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y")).collect()}
        centroids = [moved.get(k, old) for k, old in enumerate(centroids)]
    return centroids


def confusion(pairs: DataFrame) -> DataFrame:
    """tp, fp, fn, tn, precision, recall and f1 of (truth, guess); 0 where a denominator is."""
    t, g = F.col("truth") == 1, F.col("guess") == 1
    c = pairs.agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"), F.count_if(~t & ~g).alias("tn"))
    share = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    c = c.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    f1 = share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    return c.select("tp", "fp", "fn", "tn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(f1, 6).alias("f1"))


def normal_pdf(x: Column, mu: float, sigma: float) -> Column:
    return F.exp(-0.5 * ((x - mu) / sigma) ** 2) / (sigma * math.sqrt(2 * math.pi))


def signed_round(x: Column, digits: int) -> Column:
    """x rounded, halves away from zero; a zero keeps the sign of x, which Spark's round, going by decimals, drops."""
    return F.round(F.abs(x), digits) * F.signum(x)


#: 3 x 3 kernels by rows, with their divisors.
KERNELS = {"edge": ([-1, -1, -1, -1, 8, -1, -1, -1, -1], 1), "blur": ([1] * 9, 9), "sharpen": ([0, -1, 0, -1, 5, -1, 0, -1, 0], 1)}


def convolve(image: Column, width: int, kernel: str) -> Column:
    """An image, its rows one after the other in an array, with each inner pixel replaced by its clamped weighted neighbourhood.

    The border stays, and so does what is left of a last row that isn't whole. An image is a value of a row: nothing is shuffled.
    """
    weights, norm = KERNELS[kernel]
    whole = F.floor(F.size(image) / width)

    def pixel(v: Column, i: Column) -> Column:
        near = sum(F.get(image, i + (k // 3 - 1) * width + k % 3 - 1).cast("double") * w for k, w in enumerate(weights) if w)
        x, y = i % width, F.floor(i / width)
        inner = (x > 0) & (x < width - 1) & (y > 0) & (y < whole - 1)
        return signed_round(F.when(inner, F.greatest(F.lit(0.0), F.least(F.lit(1.0), near / norm))).otherwise(v.cast("double")), 6)

    return F.transform(image, pixel)


def optimiser(start: Column, rate: Column, variant: str, steps: int) -> Column:
    """Where SGD, momentum or Adam is on (w - 1.4)^2 + 0.15 sin 5w + 0.3 after each step from start: one run a row."""
    zero = F.struct(start.cast("double").alias("w"), F.lit(0.0).alias("m"), F.lit(0.0).alias("v"), F.array().cast("array<double>").alias("h"))

    def step(acc: Column, t: Column) -> Column:
        g = 2 * (acc["w"] - 1.4) + 0.15 * 5 * F.cos(5 * acc["w"])
        m, v = 0.9 * acc["m"] + (1 - 0.9) * g, 0.999 * acc["v"] + (1 - 0.999) * g * g
        move = {"sgd": g, "momentum": m, "adam": (m / (1 - F.pow(F.lit(0.9), t))) / (F.sqrt(v / (1 - F.pow(F.lit(0.999), t))) + 1e-8)}[variant]
        w = acc["w"] - rate * move
        return F.struct(w.alias("w"), m.alias("m"), v.alias("v"), F.concat(acc["h"], F.array(w)).alias("h"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), zero, step)["h"]


def coefficients(i: Column, base: Column, lam: Column) -> Column:
    """Ridge, lasso and elastic paths of coefficient i."""
    ridge, lasso = base / (1 + 4 * lam), F.greatest(F.lit(0.0), base - lam * 1.1 * (1 + i * 0.4))
    return F.struct(F.round(ridge, 6).alias("ridge"), F.round(lasso, 6).alias("lasso"), F.round(0.5 * lasso + 0.5 * ridge, 6).alias("elastic"))


def bias_variance(x: Column, complexity: float) -> Column:
    bias = F.greatest(F.lit(0.04), 1.0 / (0.8 + complexity * x * 0.9))
    variance = F.greatest(F.lit(0.02), F.pow(complexity * x * 0.8, F.lit(1.6)) * 0.5)
    return F.struct(F.round(bias, 6).alias("bias"), F.round(variance, 6).alias("variance"), F.round(bias + variance + 0.05, 6).alias("total"))


def trend_season(i: Column, trend: float, season: float, observed: int = 48) -> Column:
    noise = F.when(i < observed, ((F.sin(i * 12.9898) * 43758.5453) % 1 - 0.5) * 0.25).otherwise(0.0)
    return F.round(trend * (i / observed) + season * F.sin(i / 6 * math.pi) + noise + 1, 6)


def scaled(df: DataFrame, value: str) -> DataFrame:
    """value between the least and the most of its column, as 0 to 1; 0 where all are equal."""
    ends = df.agg(F.min(value).alias("a"), F.max(value).alias("b")).first()
    return df.withColumn("scaled", F.round((F.col(value) - ends.a) / (ends.b - ends.a), 6) if ends.a != ends.b else F.when(F.col(value).isNotNull(), 0.0))


def heat(df: DataFrame, value: str) -> DataFrame:
    most = df.agg(F.max(value)).first()[0]
    return df.withColumn("heat", F.round(0.12 + 0.55 * F.col(value) / most, 6) if most else F.when(F.col(value).isNotNull(), 0.12))


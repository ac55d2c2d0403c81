"""Topics of questions by keyword, and the modules they light up."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Topics in order, the first match wins; their keywords and modules.
TOPICS = {
    "confusion-matrix": (["confusion matrix", "precision", "recall", "f1", "false positive", "false negative", "true positive"], ["3.3"]),
    "bias-variance": (["bias", "variance", "overfit", "underfit"], ["3.3", "3.4"]),
    "regularization": (["regular", "lasso", "ridge", "elastic"], ["3.4"]),
    "knn": (["knn", "nearest", "neighbour", "neighbor"], ["3.2", "3.3"]),
    "gradient-descent": (["gradient", "descent", "sgd", "adam", "learning rate"], ["3.7"]),
    "distributions": (["distribution", "gaussian", "normal", "probability", "std", "standard deviation", "bell curve"], ["3.1"]),
    "kmeans": (["k-means", "kmeans", "k means", "cluster", "centroid", "unsupervised"], ["3.5"]),
    "time-series": (["time series", "time-series", "forecast", "seasonality", "trend", "arima"], ["3.6"]),
    "convolution": (["convolution", "convolutional", "cnn", "kernel", "filter", "computer vision", "edge detection"], ["3.8"]),
    "embeddings": (["embedding", "word vector", "word2vec", "cosine similarity", "nlp", "semantic"], ["3.9", "3.10"]),
}
MODULES = [f"3.{k}" for k in range(1, 11)]
#: An older router's routes with their patterns, in order; the first that a question matches wins.
PATTERNS = {
    "overfit": r"overfit|decision tree|prune|bias.?varianc|max_depth",
    "reg": r"l1|l2|lasso|ridge|regular|sparsit|elastic|penalt",
    "knn": r"knn|nearest neighbou?r|\bk\b|neighbou?r",
    "grad": r"gradient|descent|learning rate|backprop|optimi|train.* net|loss surface|epoch",
}


def detect(question: Column, topics: dict[str, tuple[list[str], list[str]]] = TOPICS) -> Column:
    """The first topic one of whose keywords the question holds, else null; other vocabularies can be given."""
    low = F.lower(question)
    out = F.lit(None).cast("string")
    for topic, (words, _) in reversed(topics.items()):
        out = F.when(reduce(Column.__or__, (F.contains(low, F.lit(w)) for w in words)), topic).otherwise(out)
    return out


def route_by_pattern(question: Column, patterns: dict[str, str] = PATTERNS, default: str | None = None) -> Column:
    """The first route whose pattern the lower-cased question holds, else default; so for a null question."""
    low = F.lower(question)
    matched = (F.when(low.rlike(pattern), F.lit(route)) for route, pattern in patterns.items())
    return F.coalesce(*matched, F.lit(default).cast("string"))


def with_cards(rows: DataFrame, cards: DataFrame) -> DataFrame:
    """rows (topic, ...) with cards, array<struct<eq, note>>: those of (topic, position, eq, note) of its topic in order; none is an empty array.

    A topic's cards are one value; the planner broadcasts them by their size. Rows keep their own columns but one named cards.
    """
    card = F.struct("position", "eq", "note")
    held = cards.groupBy(F.col("topic").alias("_card_topic")).agg(F.array_sort(F.collect_list(card)).alias("_cards"))
    shown = F.transform("_cards", lambda c: F.struct(c["eq"].alias("eq"), c["note"].alias("note")))
    none = F.array().cast("array<struct<eq:string,note:string>>")
    given = rows.drop("cards")
    return given.join(held, F.col("topic") == F.col("_card_topic"), "left").select(*given.columns, F.coalesce(shown, none).alias("cards"))


def modules(topic: Column, topics: dict[str, tuple[list[str], list[str]]] = TOPICS) -> Column:
    return F.coalesce(*(F.when(topic == t, F.array(*map(F.lit, m))) for t, (_, m) in topics.items()), F.array().cast("array<string>"))


def coverage(questions: DataFrame, topics: dict[str, tuple[list[str], list[str]]] = TOPICS, names: list[str] = MODULES) -> DataFrame:
    """(mod, n): how many questions light up each module, 0 included."""
    lit = questions.select(F.explode(modules(detect(F.col("text"), topics), topics)).alias("mod")).groupBy("mod").agg(F.count("*").alias("n"))
    each = questions.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, names))).alias("mod"))
    return each.join(lit, "mod", "left").select("mod", F.coalesce("n", F.lit(0)).cast("long").alias("n"))

"""A training corpus from documents: toxic texts out, shared lines once, near copies once, benchmark texts out, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. The columns of documents are kept
by all stages but the last, with their types and values, whatever else docs has; rows stay or go whole, but that line
dedup changes text and n_chars.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from lectern.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from lectern.llm.base import SPACES, materialize, small, table
from lectern.llm.queries import tokenizer_path

_REST, _KEY = "_columns_aside", "_document_key"


def _aside(docs: DataFrame) -> DataFrame:
    """doc_id, text and one column with all others, so that no name of theirs meets an operator's."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    return docs.select("doc_id", "text", *([F.struct(*(docs[f"`{c}`"] for c in rest)).alias(_REST)] if rest else []))


def _back(df: DataFrame, docs: DataFrame, **changed: Column) -> DataFrame:
    """The columns of docs again, some of them changed, with their types."""
    of = lambda c: F.col(c) if c in ("doc_id", "text") else F.col(_REST).getField(c)
    return df.select(*(changed.get(f.name, of(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal model doesn't reject."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return _back(toxicity.score(_aside(docs), model).where("not rejected"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that a smaller doc_id holds; one that has lost all its text goes, one that was blank before stays.

    n_chars, if it is a number, becomes the length of a text that has lost lines."""
    kept = line_dedup.dedup_lines(_aside(docs))
    lost = F.col("n_dropped") > 0
    kept = kept.where(~lost | (F.length(F.btrim("text", F.lit(SPACES))) > 0))
    counted = "n_chars" in docs.columns and isinstance(docs.schema["n_chars"].dataType, NumericType)
    return _back(kept, docs, **({"n_chars": F.when(lost, F.length("text")).otherwise(F.col(_REST).getField("n_chars"))} if counted else {}))


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with a key: doc_id, but for ids that repeat: of equal rows of one id and text one stays, and each further text has a key beyond all ids."""
    ids = materialize(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated-ids")
    n = ids.count()
    plain = docs.withColumn(_KEY, F.col("doc_id").cast("long"))
    if not n:
        return plain
    top = docs.agg(F.max(F.col("doc_id").cast("long"))).first()[0]
    once = materialize(docs.join(small(ids, n), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).select(*docs.columns, F.xxhash64("text").alias(_KEY)), "repeated-rows")
    own = once.groupBy(F.col("doc_id").alias("_of")).agg(F.min(_KEY).alias("_first"))
    key = F.when(F.col(_KEY) == F.col("_first"), F.col("doc_id").cast("long")).otherwise(F.monotonically_increasing_id() + top + 1)
    more = materialize(once.join(small(own, n), F.col("doc_id") == F.col("_of")).select(*docs.columns, key.alias(_KEY)), "repeated-rows")
    return plain.join(small(ids, n), "doc_id", "left_anti").select(*plain.columns).unionAll(more)


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the smallest doc_id where ids are unique; rows that repeat id and text are one document,
    unlike texts of one id are judged each by itself, and rows with a null doc_id are no group."""
    keyed = _keyed(_aside(docs))
    classes = ngram_join.join(keyed.select(F.col(_KEY).alias("doc_id"), "text")).where("doc_id <> class_id").select(F.col("doc_id").alias(_KEY)).distinct()
    classes = materialize(classes, "copies")
    return _back(keyed.join(small(classes, classes.count()), _KEY, "left_anti"), docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    judged = decontaminate.verdicts(_aside(docs), table(spark, sf_dir, "benchmark"))
    return _back(judged.where("not contaminated"), docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontaminate", decontaminate_stage),
    ("packing", packing_stage),
]
#: A fitted model and an order-dependent packing are no SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

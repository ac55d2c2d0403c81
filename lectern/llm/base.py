"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts strip and split at: [\x20\x09-\x0D].
SPACES = " \t\n\x0b\x0c\r"
#: Bytes of an Arrow batch that Python tasks get, unless the session sets them.
BATCH_BYTES = 4 << 20
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"

_own_dir: str | None = None


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a folder of our own only where that is unset and Spark runs in one process."""
    global _own_dir
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.conf.get("spark.master", "local").split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _own_dir is None:
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        _own_dir = "file://" + tempfile.mkdtemp(dir="/tmp/checkpoints")
    return _own_dir


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int, most: int = 1_000_000) -> DataFrame:
    """A broadcast hint if df, which has so many narrow rows, is within the bound; beyond it the join is to be shuffled."""
    return F.broadcast(df) if rows <= most else df.hint("shuffle_merge")


def bounded(df: DataFrame) -> DataFrame:
    """df, whose rows go to Python in batches of BATCH_BYTES or so: else a batch is 10,000 rows, however long. Spark has
    this for a session alone; one that the user has set stays."""
    conf = df.sparkSession.conf
    if conf.get(_BATCH_BYTES, None) is None:
        conf.set(_BATCH_BYTES, str(BATCH_BYTES))
    return df


def fresh(df: DataFrame, name: str) -> str:
    """name, or the first longer one that isn't a column of df."""
    held = {c.lower() for c in df.columns}
    while name.lower() in held:
        name += "_"
    return name


def let(value: Column, body) -> Column:
    """body(value) with the value computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]

"""Readers: Parquet tables, JSON lines with a fixed schema, whole text files."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: One schema for all dialects of chunk files; fields that a dialect lacks are null.
CHUNK = (
    "chunk_id string, source_file string, source_type string, lesson_title string, topic string, section_title string, chunk_index int, page_start int, page_end int, page_number int, chunk_text string, clean_markdown string, "
    "retrieval_keywords array<string>, sample_questions array<string>, token_estimate int, metadata struct<pipeline_owner:string,suffix:string,extractor:string,chunking_method:string,llm_model:string,timestamp_start:string,timestamp_end:string,speakers:array<string>,segment_type:string>, embedding array<float>"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str = CHUNK) -> DataFrame:
    """Blank lines are skipped; a line that isn't JSON gives a row of nulls."""
    return spark.read.schema(schema).json(path)


def text_files(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """(path, file, text): whole files below path, with line ends as line feeds; path tells files of one name apart."""
    read = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", recursive).text(path, wholetext=True)
    at = F.col("_metadata.file_path")
    return read.select(at.alias("path"), F.substring_index(at, "/", -1).alias("file"), F.regexp_replace("value", "\r\n?", "\n").alias("text"))


def in_order(files: DataFrame) -> DataFrame:
    """Rows of files (path, ...) sorted by path, with position from 0: numbered within ranges of paths, no file passes through one task."""
    ranged = files.repartitionByRange("path").sortWithinPartitions("path")
    held = staged(ranged.withColumn("_part", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "files")
    sizes = held.groupBy("_part").agg(F.count("*").alias("_n"))  # a row a partition
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    placed = held.join(before, "_part").withColumn("position", F.col("_before") + F.col("_row"))
    return placed.drop("_part", "_row", "_before", "_n").orderBy("path")


def write_json_lines(df: DataFrame, path: str) -> None:
    df.write.option("ignoreNullFields", False).json(path)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir, or below a folder of our own where that is unset and Spark runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "local")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="staged-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet at a new shared path and read again, so that what made it runs once."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

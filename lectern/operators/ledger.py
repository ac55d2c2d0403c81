"""Model calls that can be resumed: replies are kept by the digest of model and prompt, and only what is missing is asked.

A ledger is a folder of Parquet files (digest, reply) that all executors reach, at a path that pyarrow opens (a local or
mounted folder, s3://, gs://, hdfs://). Tasks write each batch of replies to it as soon as the batch is back, so that a
killed run, a lost executor or a task's second attempt loses no more than the batch in flight. A batch is a part of a
task's digests in order, so that a second attempt finds the files of the first by their names before it calls.

Cases: a null prompt is not asked, its reply is null and its error "no prompt". Repeated prompts are asked once.
A prompt that fails has an error and no entry, so that the next run asks it again. An empty table asks nothing.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from lectern.operators.providers import Completer, Limit, by_halves
from lectern.sources.tables import staged

_ENTRY = "digest string, reply string"


def digest(model: str, prompt: Column) -> Column:
    """The key of a prompt for a model."""
    return F.sha2(F.concat(F.lit(f"{len(model)}:{model}"), prompt), 256)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(digest, reply): the entries of a ledger, one a digest; none if it doesn't exist yet."""
    try:
        found = spark.read.schema(_ENTRY).option("pathGlobFilter", "*.parquet").parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], _ENTRY)
    return found.groupBy("digest").agg(F.min("reply").alias("reply"))


def _file(path: str, name: str) -> tuple[fs.FileSystem, str]:
    system, at = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, f"{at.rstrip('/')}/{name}"


def _load(path: str, name: str) -> dict[str, str]:
    system, at = _file(path, name)
    if system.get_file_info(at).type == fs.FileType.NotFound:
        return {}
    with system.open_input_file(at) as file:
        got = pq.read_table(file)
    return dict(zip(got["digest"].to_pylist(), got["reply"].to_pylist(), strict=True))


def _keep(path: str, name: str, entries: dict[str, str]) -> None:
    """Writes a batch's entries whole or not at all: beside, then moved into place."""
    system, at = _file(path, name)
    folder, _, base = at.rpartition("/")
    system.create_dir(folder, recursive=True)
    held = io.BytesIO()
    pq.write_table(pa.table({"digest": pa.array(entries.keys(), pa.string()), "reply": pa.array(entries.values(), pa.string())}), held)
    beside = f"{folder}/_{base}.{hashlib.blake2b(held.getvalue(), digest_size=8).hexdigest()}"
    with system.open_output_stream(beside) as file:
        file.write(held.getvalue())
    system.move(beside, at)


def ask(prompts: DataFrame, completer: Completer, path: str, model: str, column: str = "prompt", batch: int = 64, limit: Limit | None = None) -> DataFrame:
    """prompts with reply and error, asked of a completer by way of the ledger at path; batches of at most `batch` prompts."""
    limit = limit and limit.of(prompts.sparkSession)
    prompts = prompts.drop("reply", "error")
    key = next(n for n in ("digest" + "_" * k for k in range(len(prompts.columns) + 1)) if n not in prompts.columns)
    keyed = prompts.withColumn(key, digest(model, F.col(column)))
    known = read(prompts.sparkSession, path)
    # digests alone tell what is missing; prompts are shuffled only where they are asked
    wanted = staged(keyed.where(F.col(key).isNotNull()).select(F.col(key).alias("digest")).distinct().join(known, "digest", "left_anti"), "missing")
    texts = keyed.select(F.col(key).alias("digest"), F.col(column).alias("prompt"))
    found = texts.join(wanted, "digest").groupBy("digest").agg(F.min("prompt").alias("prompt")) if not wanted.isEmpty() else texts.limit(0)
    missing = found.repartition("digest").sortWithinPartitions("digest")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = limit.spaced(completer) if limit else completer
        for found in batches:
            for at in range(0, found.num_rows, batch):
                digests, texts = (c.to_pylist() for c in found.slice(at, batch).columns)
                name = hashlib.sha256("".join(digests).encode()).hexdigest() + ".parquet"
                had = _load(path, name)  # of an attempt before
                left = [(d, t) for d, t in zip(digests, texts, strict=True) if d not in had]
                made = dict(zip((d for d, _ in left), by_halves(call, [t for _, t in left]), strict=True))
                good = {d: r for d, (r, e) in made.items() if e is None}
                if good:
                    _keep(path, name, had | good)
                all_ = {d: (r, None) for d, r in had.items()} | made
                yield pa.RecordBatch.from_arrays([pa.array(digests), pa.array([all_[d][0] for d in digests], pa.string()), pa.array([all_[d][1] for d in digests], pa.string())], ["digest", "reply", "error"])

    asked = staged(missing.mapInArrow(rows, f"{_ENTRY}, error string"), "asked")
    told = known.withColumn("error", F.lit(None).cast("string")).join(asked, "digest", "left_anti").unionByName(asked)
    joined = keyed.join(told.withColumnRenamed("digest", key), key, "left")
    error = F.when(F.col(key).isNull(), "no prompt").otherwise(F.col("error"))  # a prompt has a digest; it is itself not read for this
    return joined.select(*prompts.columns, "reply", error.alias("error"))


def merge_new(existing: DataFrame, made: DataFrame, source: str = "source_file") -> DataFrame:
    """Existing chunks, all kept, and the made ones of sources that have none yet; a null source counts as a source."""
    had = existing.select(F.col(source).alias("_had")).distinct()
    return existing.unionByName(made.join(had, made[source].eqNullSafe(F.col("_had")), "left_anti").select(*existing.columns))

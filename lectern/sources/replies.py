"""Replies of a provider as a data source, batch and stream: the tokens of each request as they come, then how it ended.

    spark.dataSource.register(replies.Replies)
    spark.readStream.format("replies").option("path", folder).option("provider", "package.module:function").load()

Requests (request_id long, prompt string) arrive as Parquet files in a folder; the provider is a function from a prompt
to an iterator of tokens, named so that tasks import it. Each request gives token records, numbered from 0, then an event
(compose is done) or an error with its detail, and last a done record. The offset is the number of files in the order of
their names, so names must rise as files come; a file is a partition, read and asked in a task. A stream that restarts
reads on after the offsets of its checkpoint; a batch read is the stream's whole content.

Cases: an empty token is left out; a null prompt is an error ("no prompt"); a provider that fails after some tokens has
those tokens before its error. An empty folder or file has no records. Hidden files (. and _) are no requests.
"""

from __future__ import annotations

import importlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

RECORD = "request_id bigint, seq bigint, kind string, stage string, status string, detail string, token string"
_ARROW = pa.schema([("request_id", pa.int64()), ("seq", pa.int64()), *((c, pa.string()) for c in ("kind", "stage", "status", "detail", "token"))])


def words(prompt: str) -> Iterator[str]:
    """A stand-in provider: the words of the first sentence; a prompt without one fails after its first word."""
    head, stop, _ = prompt.partition(".")
    for word in head.split(" "):
        if word:
            yield word
            if not stop:
                raise ValueError("no sentence")
    if not stop:
        raise ValueError("no sentence")


def _named(name: str):
    module, _, function = name.partition(":")
    return getattr(importlib.import_module(module), function)


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if path.startswith("file:") or "://" in path else (fs.LocalFileSystem(), path)


def records(request_id: int, prompt: str | None, provider) -> Iterator[tuple]:
    """The records of one request."""
    seq, error = 0, None if prompt is not None else "no prompt"
    try:
        for token in provider(prompt) if prompt is not None else ():
            if token:
                yield request_id, seq, "token", None, None, None, token
                seq += 1
    except Exception as e:
        error = str(e)
    yield (request_id, seq, "event", "compose", "done", None, None) if error is None else (request_id, seq, "error", "compose", "error", error, None)
    yield request_id, seq + 1, "done", None, None, None, None


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reading:
    def __init__(self, options: dict):
        self.path, self.provider, self.rows = options["path"], options.get("provider", "lectern.sources.replies:words"), int(options.get("rowsPerBatch", 1000))

    def files(self) -> list[str]:
        system, at = _system(self.path)
        found = system.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return sorted(f.path for f in found if f.is_file and f.base_name[0] not in "._")

    def read(self, partition: _File) -> Iterator[pa.RecordBatch]:
        provider, held = _named(self.provider), []
        system, _ = _system(self.path)
        with system.open_input_file(partition.path) as file:
            for batch in pq.ParquetFile(file).iter_batches(256, columns=["request_id", "prompt"]):
                for request_id, prompt in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    for record in records(request_id, prompt, provider):
                        held.append(record)
                        if len(held) == self.rows:
                            yield self._batch(held)
                            held = []
        if held:
            yield self._batch(held)

    @staticmethod
    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


class _Batch(_Reading, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(f) for f in self.files()]


class _Stream(_Reading, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(self.files())}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(f) for f in self.files()[start["files"] : end["files"]]]


class Replies(DataSource):
    @classmethod
    def name(cls) -> str:
        return "replies"

    def schema(self) -> str:
        return RECORD

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)

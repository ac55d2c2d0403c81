"""Completion and embedding providers behind one interface, with deterministic offline stand-ins."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


class Completer(Protocol):
    def __call__(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def __call__(self, texts: list[str]) -> list[list[float]]: ...


def extractive(prompts: list[str]) -> list[str]:
    """The first sentence of each prompt, cited as [1]."""
    return [f"{p.split('.')[0].strip()} [1]." for p in prompts]


def plain_question(prompts: list[str]) -> list[str]:
    """Each question without the phrases people put before it: a stand-in for a rewriter."""
    return [re.sub(r"(?i)^\W*((please|can you|could you|tell me|i want to know|hi|hello|um)\b\W*)+", "", p).strip() for p in prompts]


def key_words(prompts: list[str]) -> list[str]:
    """The long words of each prompt's first line that the rest doesn't hold, else that all is covered: a stand-in for reflection."""
    out = []
    for p in prompts:
        head, _, rest = p.partition("\n\n")
        missing = [w for w in dict.fromkeys(re.findall(r"\w{5,}", head.lower())) if w != "question" and w not in rest.lower()]
        out.append(" ".join(missing) or "coverage adequate")
    return out


def named_completer(name: str, known: dict[str, Completer], aliases: dict[str, str] | None = None) -> Completer:
    """The completer of that name or alias."""
    found = (aliases or {}).get(name, name)
    if found not in known:
        raise ValueError(f"no provider {name}; there are {', '.join(sorted(known))}")
    return known[found]


def hashed_embedder(dim: int = 64) -> Embedder:
    """Unit vectors of hashed words; where these cancel out, or there are none, of the whole text as one word."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            v = np.zeros(dim)
            for word in text.lower().split():
                h = hashlib.blake2b(word.encode(), digest_size=8).digest()
                v[int.from_bytes(h[:4], "little") % dim] += 1 if h[4] % 2 else -1
            if not v.any():
                v[int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=4).digest(), "little") % dim] = 1
            out.append((v / np.linalg.norm(v)).tolist())
        return out

    return embed


def suggested_wait(error: str) -> float | None:
    """The seconds that a provider's error asks to wait, as in "retry in 7s" or "retryDelay': '7s'"."""
    found = re.search(r"retry(?:[ _-]?delay|[ _-]?after| in)\W{0,8}(\d+(?:\.\d+)?)", error, re.IGNORECASE)
    return float(found[1]) if found else None


def used_up(error: str) -> bool:
    """Whether a limit error says that the model's quota of the day is gone, so that no wait helps."""
    # fixed values: what the provider's error bodies hold
    return "quotaValue" in error and ("limit: 0" in error or "GenerateRequestsPerDay" in error)


def with_retry(calls: list[Callable] | Callable, attempts: int = 5, pause: Callable[[float], None] = time.sleep) -> Callable:
    """Calls again after a pause, `attempts` times at most; the last failure is raised.

    A limit waits as long as the error asks and 2 s more, else 4, 8, 16, ... s; an overloaded provider 15, 30, ... s; any
    other error 5 s. Of several calls (models), the next takes over at once, for good, when the quota of the day of one is
    used up, which counts as an attempt too.
    """
    calls = [calls] if callable(calls) else list(calls)
    now = [0]  # the model in use, kept between batches

    def run(batch: list[str]):
        for n in range(attempts):
            try:
                return calls[now[0]](batch)
            except Exception as e:
                said, small = str(e), str(e).lower()
                limited = "429" in said or "quota" in small
                if limited and used_up(said):
                    if now[0] + 1 == len(calls):
                        raise
                    now[0] += 1
                    if n + 1 == attempts:
                        raise
                    continue
                if n + 1 == attempts:
                    raise
                asked = suggested_wait(said)
                if limited:
                    pause(asked + 2 if asked else 2.0 ** (n + 2))
                else:
                    pause(15.0 * (n + 1) if "503" in said or "unavailable" in small else 5.0)

    return run


@dataclass(frozen=True)
class Limit:
    """At most `per_second` calls over all tasks, of which `tasks` run at once; each attempt is a call.

    A task keeps 1 / (its share) s between its calls, from its start on, so that any t seconds see per_second * t + tasks
    calls at most, however many tasks follow each other. tasks is the session's parallelism by default: give it where
    executors may be added. Where an error names a delay, its task waits as long before the next call.
    """

    per_second: float
    tasks: int | None = None
    attempts: int = 1

    def __post_init__(self):
        if not self.per_second > 0 or (self.tasks is not None and self.tasks < 1):
            raise ValueError("per_second and tasks must be positive")

    def of(self, spark: SparkSession) -> Limit:
        """This limit with tasks set."""
        return Limit(self.per_second, self.tasks or max(1, spark.sparkContext.defaultParallelism), self.attempts)

    def spaced(self, call: Callable, clock: Callable[[], float] = time.monotonic, pause: Callable[[float], None] = time.sleep) -> Callable:
        """call under the share of one task, made in the task."""
        gap = (self.tasks or 1) / self.per_second
        free = [clock() + gap]  # when the next call may be made

        def run(batch: list):
            wait = free[0] - clock()
            if wait > 0:
                pause(wait)
            free[0] = clock() + gap
            try:
                return call(batch)
            except Exception as e:
                free[0] = max(free[0], clock() + (suggested_wait(str(e)) or 0.0))
                raise

        return run if self.attempts == 1 else with_retry(run, self.attempts, pause)


def by_halves(call: Callable, given: list) -> list[tuple]:
    """(result, error) of each; a batch that fails is asked in halves, so that one bad row costs about 2 log2(n) calls and no other row its result."""
    if not given:
        return []
    try:
        found = list(call(given))
        if len(found) != len(given):
            raise ValueError(f"{len(found)} results for {len(given)} rows")
        return [(x, None) for x in found]
    except Exception as e:
        if len(given) == 1:
            return [(None, str(e))]
    half = len(given) // 2
    return by_halves(call, given[:half]) + by_halves(call, given[half:])


#: Rows that a task hands to a provider at once, and holds as Python objects.
BATCH = 256


def complete(prompts: DataFrame, completer: Completer, column: str = "prompt", limit: Limit | None = None, batch: int = BATCH) -> DataFrame:
    """prompts with reply and error: a prompt that fails has an error in place of a reply, and the run goes on."""
    limit = limit and limit.of(prompts.sparkSession)
    schema = prompts.limit(0).withColumns({"reply": F.lit(None).cast("string"), "error": F.lit(None).cast("string")}).schema

    def answered(given: list, call: Completer) -> dict[str, list]:
        found = by_halves(call, given)
        return {"reply": [x for x, _ in found], "error": [e for _, e in found]}

    return _in_batches(prompts, completer, column, limit, batch, schema, answered)


def embed_each(texts: DataFrame, embedder: Embedder, column: str = "text", dim: int = 64, limit: Limit | None = None, batch: int = BATCH) -> DataFrame:
    """texts with embedding and error: a null text, a failed call and a vector of another length than dim are errors of their rows."""
    limit = limit and limit.of(texts.sparkSession)
    schema = texts.limit(0).withColumns({"embedding": F.lit(None).cast("array<float>"), "error": F.lit(None).cast("string")}).schema

    def embedded(given: list, call: Embedder) -> dict[str, list]:
        some = [k for k, x in enumerate(given) if isinstance(x, str)]
        found: list[tuple] = [(None, "no text")] * len(given)
        for k, (v, e) in zip(some, by_halves(call, [given[k] for k in some]), strict=True):
            found[k] = (None, f"a vector of length {len(v)}, not {dim}") if e is None and len(v) != dim else (v, e)
        return {"embedding": [v for v, _ in found], "error": [e for _, e in found]}

    return _in_batches(texts, embedder, column, limit, batch, schema, embedded)


def _in_batches(rows: DataFrame, call: Callable, column: str, limit: Limit | None, batch: int, schema: StructType, made: Callable) -> DataFrame:
    """rows with the columns that made(values of column, call) gives; only these and the values are Python objects, of `batch` rows at a time."""
    names, types = rows.columns, to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        calls = limit.spaced(call) if limit else call
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                new = made(part.column(names.index(column)).to_pylist(), calls)
                columns = [pa.array(new[f.name], f.type) if f.name in new else part.column(names.index(f.name)) for f in types]
                yield pa.RecordBatch.from_arrays(columns, types.names)

    return rows.mapInArrow(run, schema)


def embed(texts: DataFrame, embedder: Embedder, column: str = "text", dim: int = 64) -> DataFrame:
    """texts with embedding; a vector of another length than dim is an error."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors = embedder(frame[column].fillna("").tolist())
            if any(len(v) != dim for v in vectors):
                raise ValueError(f"the embedder gave a vector that isn't of length {dim}")
            yield frame.assign(embedding=vectors)

    schema = texts.limit(0).withColumn("embedding", F.array().cast("array<float>")).schema
    return texts.mapInPandas(rows, schema)

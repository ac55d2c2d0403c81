"""Order-dependent folds over the rows of each key, one row at a time with a small state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


_ARROW = {"long": pa.int64(), "boolean": pa.bool_()}


def fold(rows: DataFrame, key: str, order: list[str], value: str, step: Callable[[Any, Any], tuple[Any, Any]], name: str, kind: str) -> DataFrame:
    """rows with a column `name` of type `kind`, long or boolean: what step(state, value) gives beside the next state; a key starts with None.

    The sort is Spark's and spills; a task streams its partition, so that a hot key needs time, but no memory. Rows with
    a null key are one group.
    """
    columns = [c for c in rows.columns if c != name]
    at, of = columns.index(key), columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), None
        for batch in batches:
            out = []
            for k, v in zip(batch.column(at).to_pylist(), batch.column(of).to_pylist(), strict=True):
                if k != now:
                    now, state = k, None
                state, found = step(state, v)
                out.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, _ARROW[kind])], [*columns, name])

    schema = rows.select(*columns).limit(0).withColumn(name, F.lit(None).cast(kind)).schema
    return rows.select(*columns).repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, schema)

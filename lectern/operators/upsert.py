"""Upserts over plain tables: full outer joins and anti joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def one_each(rows: DataFrame, key: str, order: str | None, last: bool = False) -> DataFrame:
    """The first or last row of each key by `order`, without one any; sums of no more than a row a key leave the tasks."""
    pick = F.struct(*rows.columns)
    if order is None:
        found = F.first(pick)
    else:
        found = (F.max_by if last else F.min_by)(pick, F.struct(F.col(order), F.xxhash64(*rows.columns)))
    return rows.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_of")).agg(found.alias("_row")).select("_row.*")


def insert_if_absent(old: DataFrame, new: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """old and the rows of new with keys it hasn't; of equal keys in new the first by `order` comes in. Rows of new without a key don't."""
    return old.unionByName(one_each(new, key, order).join(old.select(key), key, "left_anti").select(*old.columns))


def upsert(old: DataFrame, new: DataFrame, key: str, pinned: tuple[str, ...] = (), order: str | None = None) -> DataFrame:
    """Rows of new replace those of old with their key, but for pinned columns, which keep their first value; of equal keys in new the last by `order` counts."""
    new = one_each(new, key, order, last=True)
    o, n = old.alias("o"), new.alias("n")
    joined = o.join(n, F.col(f"o.{key}") == F.col(f"n.{key}"), "full")
    new_wins = lambda c: F.when(F.col(f"n.{key}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    old_wins = lambda c: F.when(F.col(f"o.{key}").isNotNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return joined.select(*((old_wins(c) if c in pinned or c == key else new_wins(c)).alias(c) for c in old.columns))


def beside(old: DataFrame, new: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """new and the rows of old whose key isn't in keys. Keys are counted first: where all rows of old stay, or none, old isn't shuffled."""
    n, gone = old.count(), old.select(key).join(keys, key, "left_semi").count()
    if n == gone:
        return new
    return new.unionByName(old if not gone else old.join(keys, key, "left_anti").select(*old.columns))


def skip_existing(sources: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return sources.join(done.select(key).distinct(), key, "left_anti")

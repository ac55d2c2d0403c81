"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from lectern.plans import catalog


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v.isoformat() if isinstance(v, (datetime.datetime, datetime.date)) else v


def compare(spark, sf, query, sql):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    found = query(spark, sf)
    names = sorted(found.columns)
    got = sorted(repr(tuple(map(plain, r))) for r in found.select(*names).collect())
    result = con.execute(sql)
    order = [[d[0] for d in result.description].index(c) for c in names]
    assert len(result.description) == len(names)
    assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in result.fetchall())


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query(spark, sf, name):
    compare(spark, sf, catalog.QUERIES[name], catalog.ORACLE[name])


def test_all_have_sql():
    assert set(catalog.QUERIES) - set(catalog.ORACLE) == {"stub_answer_pipeline"}  # models are no SQL; test_questions has it

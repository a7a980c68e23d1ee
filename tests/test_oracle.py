"""Every query that has SQL returns the same rows as DuckDB does on the same tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pytest

from evidora.plans.catalogue import ORACLE, QUERIES


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for path in glob.glob(f"{small}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)) or str(value) in ("NaT", "<NA>"):
        return None
    kind = type(value).__name__
    if kind in ("bool", "bool_"):
        return bool(value)
    if kind.startswith(("int", "float", "Decimal")):
        return round(float(value), 6)
    return str(value)[:19].replace(" 00:00:00", "") if kind in ("Timestamp", "date", "datetime") else str(value)


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(([plain(v) for v in r] for r in frame.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(name, spark, small, duck):
    got, want = QUERIES[name](spark, small).toPandas(), duck.sql(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(name, spark, small):
    assert QUERIES[name](spark, small).count() > 0

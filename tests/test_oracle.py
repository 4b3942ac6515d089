"""Every registered query against its DuckDB oracle on the smallest tables
(the driver repeats this at sf0.01)."""

import math

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from convprep.sources.tables import TABLES
from convprep.plans.catalog import ORACLE as LIBRARY_SQL
from convprep.plans.catalog import QUERIES as LIBRARY

ORACLE = LIBRARY_SQL


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _rows(cols, rows):
    order = sorted(cols)
    idx = [cols.index(c) for c in order]
    return sorted((tuple(_norm(r[i]) for i in idx) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = LIBRARY[name](spark, SF_SMALL)
    rel = con.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _rows(df.columns, df.collect()) == _rows(rel.columns, rel.fetchall())


def test_every_query_has_oracle():
    assert set(LIBRARY) == set(ORACLE)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.columns == ["row_id", "conv_id", "turn", "n_tokens", "ids"]
    assert df.count() >= 0

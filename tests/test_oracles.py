"""Registered queries against DuckDB on the smallest tables.

Every third query by name, or all of them with ALL_QUERIES=1.
"""

import math
import os

import duckdb
import pytest

from pointweave.plans import catalog
from pointweave.sources.fixtures import TABLES

NAMES = sorted(catalog.oracle_sql())
CHOSEN = NAMES if os.environ.get("ALL_QUERIES") else NAMES[::3]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_equals_sql(name, spark, sf, duck):
    df = catalog.queries()[name](spark, sf)
    other = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    cols = sorted(df.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in df.select(cols).collect()), key=repr)
    theirs = sorted((tuple(plain(x) for x in r) for r in other.select(*[f'"{c}"' for c in cols]).fetchall()), key=repr)
    assert len(ours) == len(theirs)
    for a, b in zip(ours, theirs):
        assert a == pytest.approx(b, abs=2e-6) if all(isinstance(x, (int, float)) for x in a) else a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(NAMES)))
def test_query_without_sql_gives_rows(name, spark, sf):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_registry_is_whole():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert len(catalog.queries()) > 200

"""Every query with SQL gives DuckDB's rows on the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from graphloom.plans import catalog

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else str(v)


@pytest.mark.skipif(not DATA.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, str(DATA))
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    # a query over tables with rows that returns none shows nothing
    assert got
    if name not in catalog.ORACLE_SQL:
        return
    r = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    assert got == sorted(tuple(plain(x[names.index(c)]) for c in columns) for x in r.fetchall())


def test_entry(spark):
    assert set(catalog.QUERIES) <= set(entry.queries())
    assert set(catalog.ORACLE_SQL) <= set(entry.oracle_sql())
    assert entry.entry(spark).columns == ["item"]

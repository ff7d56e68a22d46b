"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import datetime
import math
from pathlib import Path

import duckdb
import pytest

from codeglint.plans import registry

QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v
    return v


def key(row):
    return tuple((v is not None, round(v, 4) if isinstance(v, float) else v if isinstance(v, (int, str, datetime.datetime)) else str(v)) for v in row)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    names = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=key)
    res = con.execute(SQL[name])
    have = [d[0] for d in res.description]
    assert sorted(have) == names
    want = sorted((tuple(plain(r[have.index(c)]) for c in names) for r in res.fetchall()), key=key)
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for a, b in zip(g, w):
            assert type(a) is type(b) or a is None or b is None, (a, b)
            assert a == (pytest.approx(b, abs=2e-6) if isinstance(b, float) else b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_other_queries_run(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())

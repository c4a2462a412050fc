"""Every registered query against its independent DuckDB SQL (sf0.001)."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as E
from eventlens.plans import PLANS

from .conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def canon(cols, rows):
    def norm(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v)
        if isinstance(v, decimal.Decimal):
            return str(v)
        return repr(v)
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


def test_every_query_has_oracle_sql():
    assert set(PLANS) <= set(SQL)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_query_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF_SMALL)
    got = canon(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(SQL[name])
    want = canon(rel.columns, rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["year", "num_companies", "total_laid_off", "yoy_change", "yoy_growth_pct"]
    assert df.count() >= 0

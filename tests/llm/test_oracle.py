"""Queries of the subpackage with DuckDB SQL, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as E
from eventlens.llm import queries
from tests.conftest import SF_SMALL
from tests.test_oracle import TABLES, canon


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    got, rel = canon(df.columns, [tuple(r) for r in df.collect()]), con.sql(E.oracle_sql()[name])
    assert got == canon(rel.columns, rel.fetchall())


def test_all_are_registered():
    assert set(queries.QUERIES) <= set(E.queries()) and set(queries.ORACLE_SQL) <= set(E.oracle_sql())

"""Queries that SQL can express, against DuckDB on the test tables."""

import duckdb
import pytest

from tessitura.llm.registry import ORACLE_SQL, QUERIES


def plain(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted(map(tuple, df.astype(object).where(df.notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, sf, name):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert plain(QUERIES[name](spark, sf).toPandas()) == plain(c.execute(ORACLE_SQL[name]).df())

"""Every query against its SQL in DuckDB."""

import duckdb
import pandas as pd
import pytest

from tessitura.registry import FLAGSHIP, ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    number = lambda c: pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c)
    return sorted(map(tuple, df.apply(lambda c: c.astype(float).round(9).map(repr) if number(c) else c.map(str)).values.tolist()))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    got, expected = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert plain(got) == plain(expected)


def test_flagship_plan(spark, sf):
    plan = QUERIES[FLAGSHIP](spark, sf)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "Python" not in plan


def test_no_rows(spark, sf, tmp_path):
    """Queries that look at rows on the driver do so on empty tables as well."""
    for t in TABLES:
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    for name in ("chunk_embed_search", "similarity_topk", "style_row_lookup", "spm_char_encode", "whisper_segments", "sentence_chunks"):
        assert QUERIES[name](spark, str(tmp_path)).collect() == []

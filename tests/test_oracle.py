"""Every registered query against its oracle in DuckDB, and against being empty."""

import duckdb
import pandas as pd
import pytest

from foliant.plans import entity_queries, graph_queries, registry, search_queries, text_queries  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: May be empty on the smallest tables.
SMALL = {"similar_pairs"}


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def canonical(df):
    def text(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "NULL"
        return f"{float(v):.6g}" if isinstance(v, float) else str(v)

    df = df[sorted(df.columns)].map(text)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, sf, duck, name):
    got = registry.QUERIES[name](spark, sf).toPandas()
    assert len(got) or name in SMALL
    if name in registry.ORACLES:
        want = duck.sql(registry.ORACLES[name]).df()
        a, b = canonical(got), canonical(want)
        assert list(a.columns) == list(b.columns)
        pd.testing.assert_frame_equal(a, b, check_dtype=False)


def test_entry_without_the_llm_package(spark):
    import __spark_entry__

    assert set(registry.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every query of the registry against its SQL on DuckDB. Those without SQL have value tests of their own (test_detector, test_documents, test_values)."""

import os

import duckdb
import pytest

from millrace.plans import registry


@pytest.fixture(scope="module")
def database(small):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for name in os.listdir(small):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{small}/{name}')")
    return con


def plain(value):
    if value is None or value != value:
        return None
    return round(value, 6) if isinstance(value, float) else str(value)


def rows_of(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(str([plain(x) for x in r]) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_equals_sql(spark, small, database, name):
    found, wanted = registry.queries()[name](spark, small).toPandas(), database.execute(registry.oracle_sql()[name]).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


#: mth02 and stm10: test_detector; etl05 and etl06: test_documents; str21: test_values.
WITHOUT_SQL = {"mth02_detector", "stm10_online_detector", "etl05_chunks", "etl06_mentions", "str21_hash_embedding"}


def test_only_these_have_no_sql():
    assert registry.queries().keys() - registry.oracle_sql().keys() == WITHOUT_SQL


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL - {"etl06_mentions"}))
def test_runs_without_sql(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0

"""Registered queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from obsward.plans.registry import ORACLE_SQL, QUERIES
from obsward.plans.stations import entry

SF = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    db.sql("SET timezone = 'UTC'")
    for p in SF.glob("*.parquet"):
        db.sql(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, tables, name):
    df = QUERIES[name](spark, str(SF))
    columns = sorted(df.columns)
    expected = tables.sql(ORACLE_SQL[name])
    assert sorted(expected.columns) == columns
    rows = [tuple(r) for r in df.select(*columns).collect()]
    assert sorted(rows, key=str) == sorted(expected.select(*columns).fetchall(), key=str) and rows


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_have_rows(spark, name):
    assert QUERIES[name](spark, str(SF)).count() > 0


def test_entry(spark):
    assert entry(spark, str(SF)).columns == ["station_id", "flag"]

"""Every registered query against its SQL."""

from __future__ import annotations

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tidemark.plans import oracle, queries

QUERIES, SQL = queries.QUERIES, oracle.ORACLE_SQL


@pytest.fixture(scope="module")
def database(data_dir):
    connection = duckdb.connect()
    for path in Path(data_dir).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_all_are_registered():
    assert set(QUERIES) <= set(contract.queries())
    assert set(SQL) <= set(contract.oracle_sql()) <= set(contract.queries())


def test_entry(spark):
    flagged = contract.entry(spark)
    assert len(flagged.columns) == 16
    assert flagged.count() == 1000


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, data_dir, database, name):
    rows = QUERIES[name](spark, data_dir)
    columns = sorted(rows.columns)
    answer = database.execute(SQL[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == columns
    places = [names.index(c) for c in columns]
    expected = Counter(tuple(r[i] for i in places) for r in answer.fetchall())
    assert Counter(tuple(r) for r in rows.select(*columns).collect()) == expected
    assert expected

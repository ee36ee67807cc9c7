"""Every query with an oracle against DuckDB on the smallest tables, apart from the training-data operators."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql() if not n.startswith("op") and n in entry.queries())


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
    return con


def flat(value):
    if isinstance(value, float):
        return repr(round(value, 9))
    if isinstance(value, (list, tuple)):
        return repr([flat(v) for v in value])
    return repr(value)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    got = entry.queries()[name](spark, SF)
    want = db.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    rows = want.fetchall()
    assert sorted(tuple(map(flat, r)) for r in got.select(*columns).collect()) == sorted(tuple(map(flat, r)) for r in rows)


def test_every_query_has_a_docstring_or_oracle():
    assert set(NAMES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomsearch.plans import oracle

NAMES = sorted(oracle.oracle_sql())


@pytest.fixture(scope="module")
def tables(sf_dir):
    db = duckdb.connect()
    for name in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{name}'")
    return db


def text(value):
    return "" if value is None or value != value else str(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else str(value)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, sf_dir, tables, name):
    got = entry.queries()[name](spark, sf_dir)
    want = tables.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted([text(v) for v in r] for r in want.fetchall())
    assert sorted([text(r[c]) for c in columns] for r in got.collect()) == rows


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() == 10

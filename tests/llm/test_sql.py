import os

import duckdb
import pytest

from loomsearch.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, sf_dir, name):
    db = duckdb.connect()
    for file in os.listdir(sf_dir):
        db.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{sf_dir}/{file}'")
    want = db.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, sf_dir)
    assert sorted(columns) == sorted(got.columns)
    assert sorted([str(r[c]) for c in columns] for r in got.collect()) == sorted([str(v) for v in r] for r in want.fetchall())

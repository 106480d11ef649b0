import os

import pytest

import __spark_entry__ as entry
from tagtrail.plans import code_index, tracking

CORE = {**tracking.REGISTRY.queries, **code_index.REGISTRY.queries}


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda v: round(v, 6) if isinstance(v, float) else tuple(v) if isinstance(v, list) else v
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(CORE))
def test_query_and_its_sql_agree(spark, data, name):
    got = CORE[name](spark, data)
    rows = got.collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for file in os.listdir(data):
        db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
    want = db.sql(sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, rows) == rows_of(want.columns, want.fetchall())


def test_entry(spark, data):
    assert entry.entry(spark).count() > 0 and set(entry.oracle_sql()) <= set(entry.queries())

import os

import pytest

from tagtrail.llm.queries import REGISTRY


@pytest.mark.parametrize("name", sorted(REGISTRY.queries))
def test_query_runs_and_agrees_with_its_sql(spark, data, name):
    if not os.path.isdir("/opt/tokenizers") and name.startswith(("p6", "p7")):
        pytest.skip("no vocabulary here")
    got = REGISTRY.queries[name](spark, data)
    rows = got.collect()
    assert rows
    if name in REGISTRY.sql:
        duckdb = pytest.importorskip("duckdb")
        db = duckdb.connect()
        for file in os.listdir(data):
            db.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{data}/{file}'")
        want = db.sql(REGISTRY.sql[name])
        assert sorted(got.columns) == sorted(want.columns) and sorted(map(tuple, rows)) == sorted(want.fetchall())


def test_results_have_the_stated_columns(spark, data):
    columns = {
        "p2_found": ["row_id"], "p3_found": ["content_sha_a", "content_sha_b"], "p5_found": ["point_id", "function_name"],
        "p6_ids": ["doc_id", "ids"], "p8_found": ["doc_id"],
    }
    assert {n: REGISTRY.queries[n](spark, data).columns for n in columns} == columns

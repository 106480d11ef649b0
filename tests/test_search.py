import numpy as np
import pytest
from pyspark.sql import functions as F

from tagtrail.operators import search

SCHEMA = (
    "point_id string, vector array<float>, version string, area string, language string, file_path string, symbol_kind string, symbol_name string, "
    "symbol_fqn string, deprecated_in string, start_line int, end_line int, content string"
)


def points(spark, rows):
    return spark.createDataFrame([
        (i, v, *(more.get(k, d) for k, d in (("version", "6.7.0.0"), ("area", "core"), ("language", "php"), ("file_path", "f"))), "class",
         more.get("symbol_name", "n"), "", None, 1, 2, more.get("content", "text")) for i, v, more in rows
    ], SCHEMA)


def test_top_k_ties_filters_and_unusable_vectors(spark):
    df = points(spark, [("b", [1.0, 0.0], {}), ("a", [2.0, 0.0], {}), ("c", [0.0, 1.0], {"language": "vue"}), ("d", None, {}), ("e", [0.0, 0.0], {}), ("f", [1.0], {})])
    assert [r["point_id"] for r in search.top_k(df, [1.0, 0.0], 5).collect()] == ["a", "b", "c"]
    assert [r["point_id"] for r in search.search(df, [1.0, 0.0], 5, language="vue", version=None).collect()] == ["c"]
    hit = search.search(df, [1.0, 1.0], 1).first()
    assert (hit["score"], hit["lines"], hit["snippet"]) == (0.7071, "1-2", "text")


def test_repeated_changelog_entries_collapse(spark):
    entry = {"area": "changes", "symbol_name": "T", "content": "same"}
    rows = [
        ("1", [1.0, 0.1], entry | {"file_path": "changelog/release-6-7-0-0/a.md"}), ("2", [1.0, 0.0], entry | {"file_path": "x/changelog/release-6-7-0-0/a.md"}),
        ("3", [1.0, 0.2], entry | {"file_path": "changelog/release-6-7-0-0/a.md", "content": "other section"}),
        ("4", [1.0, 0.3], entry | {"file_path": "UPGRADE-6.6.md"}), ("5", [1.0, 0.4], entry | {"file_path": "UPGRADE-6.7.md"}),
    ]
    got = [r["point_id"] for r in search.search(points(spark, rows), [1.0, 0.0], 10, area="changes").collect()]
    assert got == ["2", "3", "4", "5"]


def test_filter_reaches_the_scan(spark, tmp_path):
    points(spark, [("a", [1.0, 0.0], {})]).write.parquet(str(tmp_path / "p"))
    plan = search.equal_filters(spark.read.parquet(str(tmp_path / "p")), version="6.7.0.0")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(version), EqualTo(version,6.7.0.0)]" in plan


@pytest.mark.parametrize("block", [1 << 20, 8 * 6 * 3])
def test_top_k_of_each(spark, monkeypatch, block):
    monkeypatch.setattr(search, "QUERY_BYTES", block)
    rng = np.random.default_rng(1)
    v = rng.normal(size=(200, 6)).astype(np.float32)
    df = spark.createDataFrame([(f"p{i:03}", x.tolist()) for i, x in enumerate(v)] + [("z", None), ("y", [0.0] * 6)], "point_id string, vector array<float>")
    asked = df.limit(200).filter("point_id like '%0'").select(F.col("point_id").alias("q"), "vector")
    got = {(r["q"], r["rank"]): r["point_id"] for r in search.top_k_of_each(df, asked, 4, 6).collect()}
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    want = {}
    for i in range(0, 200, 10):
        for rank, j in enumerate(np.argsort(-(unit @ unit[i]), kind="stable")[:4], 1):
            want[(f"p{i:03}", rank)] = f"p{j:03}"
    assert got == want
    assert search.top_k_of_each(df, asked.limit(0), 4, 6).count() == 0

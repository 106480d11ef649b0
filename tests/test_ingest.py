import json

import pytest
from pyspark.sql import functions as F

from tagtrail.api import Tools
from tagtrail.functions.embedding import hashing_embedder
from tagtrail.operators import caching
from tagtrail.plans.ingest import ingest
from tagtrail.sources import tree
from tagtrail.sources.store import Store
from tagtrail.streaming.ingest import deprecations_seen, ingest_available, ingest_landed, stream_files

EMBED = hashing_embedder(16)
FILES = {
    "v6.6.0.0": {"src/Core/A.php": "<?php\nclass A {\n  function a() {}\n}", "src/Core/vendor/B.php": "<?php class B {}", "README": "x",
                 "src/Storefront/a.scss": ".card { }"},
    "v6.7.0.0": {"src/Core/A.php": "<?php\n/** @deprecated tag:v6.8.0 */\nclass A {\n  function a($x) {}\n  function b() {}\n}",
                 "src/Storefront/v.html.twig": "{% block x %}card{% endblock %}",
                 "changelog/release-6-7-0-0/n.md": "---\ntitle: T\nissue: I\n---\n# Core\n* src/Core/A.php changed\n"},
}


def land(folder):
    for tag, files in FILES.items():
        for path, content in files.items():
            file = folder / tag / path
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(content)
    return str(folder)


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    return tree.landed(spark, land(tmp_path_factory.mktemp("tree")))


@pytest.fixture(scope="module")
def store(spark, landed, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    ingest(landed, store, EMBED)
    return store


def test_tree(spark, landed):
    assert [r[0] for r in tree.tags(landed).collect()] == ["v6.6.0.0", "v6.7.0.0"]
    assert tree.walked(landed).count() == 5
    assert [r[0] for r in tree.paths(landed, "v6.6.0.0", "src/Storefront").collect()] == ["src/Storefront/a.scss"]
    assert tree.file_at(landed, "v6.6.0.0", "nothing").count() == 0
    export = spark.createDataFrame([("t", "a.php", "1")], "tag string, file_path string, content string")
    rest = spark.createDataFrame([("t", "a.php", "2"), ("t", "changelog/x.md", "2"), ("t", "UPGRADE-6.md", "2"), ("t", "d/UPGRADE-6.md", "2")], export.schema)
    assert sorted(r[1:] for r in tree.supplemented(export, rest).collect()) == [("UPGRADE-6.md", "2"), ("a.php", "1"), ("changelog/x.md", "2")]


def test_ingest_is_idempotent(store, landed):
    first = sorted(r["point_id"] for r in store.chunks().collect())
    vectors = store.read("vector_cache").count()
    assert len(first) == len(set(first)) == store.read("chunk_index").count() and store.chunks().filter("vector is null").count() == 0
    assert [(r["tag"], r["chunk_count"]) for r in store.tag_summary().collect()] == [("v6.6.0.0", 3), ("v6.7.0.0", 6)]
    assert ingest(landed, store, EMBED).count() == 0
    assert sorted(r["point_id"] for r in store.chunks().collect()) == first and store.read("vector_cache").count() == vectors
    assert store.is_done("v6.7.0.0") and not store.is_done("v6.9.0.0")
    assert store.has_point(first[0]) and not store.has_point("x") and store.known_point_ids().count() == len(first)


def test_first_write_of_a_vector_stays(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    schema = "content_sha string, vector array<float>"
    store.cache_vectors(spark.createDataFrame([("a", [1.0, 2.5]), (None, [1.0]), ("n", None)], schema))
    store.cache_vectors(spark.createDataFrame([("a", [9.0]), ("b", [3.0, 4.0])], schema))
    assert {r[0]: list(r[1]) for r in store.vectors().collect()} == {"a": [1.0, 2.5], "b": [3.0, 4.0]}
    assert tuple(caching.cache_statistics(store.read("vector_cache")).first()) == (2, 16)
    assert tuple(caching.cache_statistics(store.read("vector_cache").limit(0)).first()) == (0, 0)
    store.upsert_chunks(spark.createDataFrame([("p1", "f", "core", "6.7.0.0", 0, [7.0])], "point_id string, file_path string, area string, version string, chunk_idx int, vector array<float>"))
    store.record_points(spark.createDataFrame([("p1", "v6.7.0.0", "f", "new")], "point_id string, tag string, file_path string, content_sha string"))
    store.record_points(spark.createDataFrame([("p1", "v6.8.0.0", "f", "later")], "point_id string, tag string, file_path string, content_sha string"))
    assert [r["content_sha"] for r in store.read("chunk_index").collect()] == ["new"]
    store.warm_cache()
    assert {r[0] for r in store.vectors().collect()} == {"a", "b", "new"}


def test_pending_and_unknown(spark):
    tags = spark.createDataFrame([("a",), ("b",), ("c",)], "tag string")
    done = spark.createDataFrame([("a", 1), ("b", None)], "tag string, finished_at int")
    assert sorted(r[0] for r in caching.pending_tags(tags, done).collect()) == ["b", "c"]
    assert caching.unknown(tags, done.limit(0), ["tag"]).count() == 3


def test_streaming_takes_in_what_has_landed(spark, store, tmp_path):
    inbox, other = tmp_path / "in", Store(spark, str(tmp_path / "store"))
    rows = [(t, p, c) for t, files in FILES.items() for p, c in files.items()]
    schema = "tag string, file_path string, content string"
    for part in (rows[:3], rows[3:], rows[:2]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(inbox))
        query = ingest_available(stream_files(spark, str(inbox)), other, EMBED, str(tmp_path / "seen"))
        query.awaitTermination()
    ids = lambda s: sorted((r["version"], r["file_path"], r["content_sha"]) for r in s.chunks().collect())
    assert ids(other) == ids(store)
    assert other.read("chunk_index").count() == other.chunks().count() and not other.is_done("v6.7.0.0")
    ingest_landed(stream_files(spark, str(inbox)), other, EMBED, str(tmp_path / "seen"))
    ingest_landed(stream_files(spark, str(inbox)), other, EMBED, str(tmp_path / "seen"))
    assert [(r["tag"], r["chunk_count"]) for r in other.read("tag_status").orderBy("tag").collect()] == [("v6.6.0.0", 3), ("v6.7.0.0", 6)]


def test_the_commit_of_a_release_is_kept(spark, tmp_path):
    files = spark.createDataFrame([("v6.6.0.0", "src/Core/A.php", "<?php class A {}", "abc"), ("v6.7.0.0", "README", "x", None)], "tag string, file_path string, content string, sha string")
    store = Store(spark, str(tmp_path))
    ingest(files, store, EMBED)
    assert sorted((r["tag"], r["sha"], r["chunk_count"]) for r in store.read("tag_status").collect()) == [("v6.6.0.0", "abc", 1), ("v6.7.0.0", "", 0)]


def test_streaming_counts_with_late_data(spark, tmp_path):
    df = spark.createDataFrame([("2024-01-01 10:00:00", "@deprecated tag:v6.8.0"), ("2024-01-01 12:00:00", "@deprecated tag:v6.8.0"), ("2024-01-09 00:00:00", "none")], "t string, content string")
    df.select(F.col("t").cast("timestamp").alias("landed_at"), "content").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("landed_at timestamp, content string").parquet(str(tmp_path / "in"))
    query = deprecations_seen(stream).writeStream.format("memory").queryName("marks").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [(r["deprecated_in"], r["n"]) for r in spark.table("marks").collect()] == [("v6.8.0", 2)]


def test_tools(store, landed):
    tools = Tools(store.chunks(), landed, EMBED)
    hits = tools.call("search_core", query="class A", version="6.7.0.0")
    assert hits["collection"] == "core" and {h["version"] for h in hits["hits"]} == {"6.7.0.0"}
    assert tools.call("search_flow_builder", query="x") == "No matches for: 'x'"
    found = tools.call("find_deprecations")
    assert [r["symbol_fqn"] for r in found["deprecations"]] == ["A"] and found["count"] == 1
    css = tools.call("find_css_class", class_name=".card")
    assert len(css["definitions"]) == 1 and len(css["usages"]) == 2
    path = json.loads(tools.call_json("upgrade_path", from_version="6.6.0.0", to_version="6.7.0.0"))
    assert path["total_entries"] == 1 and path["sections"]["core"][0]["issue"] == "I"
    assert tools.call("upgrade_path", from_version="6.7.0.0", to_version="6.6.0.0")["error"] == "invalid version range"
    why = tools.call("why_changed", file_path="src/Core/A.php", from_version="6.6.0.0", to_version="6.7.0.0")
    assert why["structural_diff"] == {"added": ["b"], "removed": [], "changed": ["a"]}
    assert why["new_deprecations"] == ["@deprecated tag:v6.8.0"] and len(why["related_changelog_entries"]) == 1
    gone = tools.call("why_changed", file_path="src/none.php", from_version="6.6.0.0", to_version="6.7.0.0")
    assert (gone["file_exists_from"], gone["file_exists_to"], gone["language"]) == (False, False, "php")
    with pytest.raises(ValueError):
        tools.call("nothing")
    with pytest.raises(ValueError):
        tools.call("find_deprecations", limit=0)


def test_command_line(spark, tmp_path, capsys):
    from tagtrail import cli

    land(tmp_path / "tree")
    at = ["--store", str(tmp_path / "store"), "--dim", "16"]
    cli.main([*at, "tags", str(tmp_path / "tree")], spark)
    cli.main([*at, "ingest", str(tmp_path / "tree"), "--dry-run"], spark)
    assert Store(spark, str(tmp_path / "store")).read("chunks").count() == 0
    for command in (["ingest", str(tmp_path / "tree"), "--tags", "v6.7.*"], ["status"], ["warm-cache"], ["query", "class A", "--limit", "1"]):
        cli.main([*at, *command], spark)
    said = capsys.readouterr().out
    assert "v6.6.0.0" in said and "symbol_fqn" in said
    assert [r["tag"] for r in Store(spark, str(tmp_path / "store")).tag_summary().collect()] == ["v6.7.0.0"]

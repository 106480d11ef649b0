from pathlib import Path
from types import SimpleNamespace

import pytest

from tagtrail.plans import work
from tagtrail.plans.registry import Registry, ship


def test_materialise_and_release(spark):
    df = spark.range(10).withColumnRenamed("id", "n")
    kept = work.materialise(df, "numbers")
    assert sorted(r[0] for r in kept.collect()) == list(range(10)) and kept.schema["n"].dataType == df.schema["n"].dataType
    assert work.materialise(df.limit(0), "none").count() == 0
    assert work.work_path(spark, "x") != work.work_path(spark, "x")
    other = Path(work.shared_dir(spark)) / "tagtrail-work" / "another-application"
    other.mkdir(parents=True)
    work.release(spark)
    assert other.is_dir()
    with pytest.raises(Exception):
        kept.count()


def test_a_cluster_needs_a_shared_folder():
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="spark://host:7077", applicationId="a"))
    with pytest.raises(RuntimeError):
        work.shared_dir(session)


def test_the_folder_of_the_session_is_used(spark, tmp_path):
    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: str(tmp_path)), sparkContext=spark.sparkContext)
    assert work.shared_dir(session) == str(tmp_path) and work.work_path(session, "x").startswith(str(tmp_path))
    assert work.shared_dir(spark) == work.shared_dir(spark)


def test_queries_are_registered_with_their_sql(spark):
    registry = Registry()
    registry.add("one", "SELECT 1 AS one")(lambda s, root: s.sql("SELECT 1 AS one"))
    registry.add("two")(lambda s, root: s.range(2))
    assert set(registry.queries) == {"one", "two"} and set(registry.sql) == {"one"}
    assert registry.queries["two"](spark, "").count() == 2
    ship(spark)
    ship(spark)

"""Tables written between stages, in the folder that all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a
local session gets a folder of its own; a cluster session is refused, since a machine-local
folder would not survive the loss of an executor.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"
_OWN: dict[str, str] = {}  # the folder of a local application for which none is set


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; also set as the session's checkpoint folder."""
    where = spark.conf.get(_KEY, None)
    if not where:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError(f"set {_KEY} to a folder that all executors share")
        where = _OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="tagtrail-")
        _OWN[context.applicationId] = where
    spark.sparkContext.setCheckpointDir(where)
    return where


def work_path(spark: SparkSession, name: str) -> str:
    """A path that nothing else uses, for one run, in the application's own folder."""
    return f"{_folder(spark, shared_dir(spark))}/{name}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, where: str) -> str:
    return f"{where.rstrip('/')}/tagtrail-work/{spark.sparkContext.applicationId}"


def materialise(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses read the written rows and lineage ends here."""
    spark = df.sparkSession
    path = work_path(spark, name)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove every table this application wrote by :func:`materialise`; those of others in the shared folder stay."""
    where = spark.conf.get(_KEY, None) or _OWN.get(spark.sparkContext.applicationId)
    if where:
        path = spark._jvm.org.apache.hadoop.fs.Path(_folder(spark, where))
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

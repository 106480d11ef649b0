"""The index's tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtrail.functions import reading


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the tables under ``root``; columns and filters reach its Parquet scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def version_key(tag: str) -> list:
    """Sort columns of the numeric order of a tag of four numbers."""
    return [F.split_part(F.substring(F.col(tag), 2, 40), F.lit("."), F.lit(i)).cast("bigint") for i in (1, 2, 3, 4)]


def snapshots(tag_status: DataFrame) -> DataFrame:
    """(tag, snapshot, finished_at): the finished tags of four numbers, numbered from 1 in numeric order.

    The input has one row per release, so the one ordered partition holds as many rows as there
    are releases, whatever the size of the index.
    """
    stable = (
        tag_status.select(reading.tag("tag").alias("tag"), "finished_at")
        .filter(F.col("finished_at").isNotNull() & F.col("tag").rlike(r"^v6\.\d+\.\d+\.\d+$"))
        .groupBy("tag")
        .agg(F.max("finished_at").alias("finished_at"))
    )
    return stable.withColumn("snapshot", F.row_number().over(Window.orderBy(*version_key("tag"), "tag")))


def sql_snapshots() -> str:
    """:func:`snapshots` as SQL text."""
    parts = [f"CAST(split_part(substr(tag, 2), '.', {i}) AS BIGINT)" for i in (1, 2, 3, 4)]
    return f"""SELECT tag, finished_at, row_number() OVER (ORDER BY {', '.join(parts)}, tag) AS snapshot FROM (
        SELECT {reading.sql_tag('tag')} AS tag, max(finished_at) AS finished_at FROM tag_status
        WHERE finished_at IS NOT NULL AND regexp_full_match({reading.sql_tag('tag')}, 'v6\\.\\d+\\.\\d+\\.\\d+') GROUP BY 1)"""

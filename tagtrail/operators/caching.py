"""Idempotent ingest: what is new, what is known, and whose value counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order (first write wins)."""
    at = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(at)).filter("_n = 1").drop("_n")


def last_of_each(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key in a stated order (last write wins)."""
    return first_of_each(rows, keys, [c.desc_nulls_last() for c in order])


def unknown(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not known; rows with a null key are unknown."""
    return rows.join(known.select(*keys), keys, "left_anti")


def with_vectors(chunks: DataFrame, cache: DataFrame, key: str = "content_sha") -> DataFrame:
    """Chunks with the vector held for their content, or null (in place of one they had). The cache has one row per key."""
    return chunks.drop("vector").join(cache.select(key, "vector"), key, "left")


def pending_tags(tags: DataFrame, done: DataFrame) -> DataFrame:
    """Tags (tag) not yet ingested to the end."""
    return unknown(tags, done.filter(F.col("finished_at").isNotNull()), ["tag"])


def backfill(points: DataFrame, chunk_index: DataFrame, cache: DataFrame) -> DataFrame:
    """(content_sha, vector) the cache lacks, from stored points (point_id, vector): the point with the least id counts."""
    joined = points.select("point_id", "vector").filter(F.col("vector").isNotNull()).join(chunk_index.select("point_id", "content_sha"), "point_id")
    new = unknown(joined.filter(F.col("content_sha").isNotNull()), cache, ["content_sha"])
    return new.groupBy("content_sha").agg(F.min_by("vector", "point_id").alias("vector"))


def cache_statistics(cache: DataFrame) -> DataFrame:
    """One row: vectors held, and bytes of their numbers."""
    size = F.coalesce(F.sum(F.when(F.col("vector").isNotNull(), F.size("vector") * 4)), F.lit(0)).cast("bigint")
    return cache.agg(F.count("*").alias("vectors"), size.alias("bytes"))

"""Source trees of tagged releases, landed as folders, as a table of files.

A landed tree is ``root/<tag>/<path>``. Export of a repository into such folders is left to the
version control system; everything from there on is a Spark scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.functions import routing, versions


def landed(spark: SparkSession, root: str) -> DataFrame:
    """(tag, file_path, content) of all files below ``root``; content as bytes, read only where used."""
    base = root.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    inner = F.substring_index(F.col("path"), f"{base}/", -1)
    tag = F.substring_index(inner, "/", 1)
    return files.select(
        tag.alias("tag"), F.substring(inner, F.char_length(tag) + 2, F.lit(100_000)).alias("file_path"), "content"
    )


def supplemented(archive: DataFrame, supplement: DataFrame) -> DataFrame:
    """Files of an export together with ones the export leaves out (changelog, upgrade notes); the export counts first."""
    kept = (
        F.col("file_path").startswith("changelog/")
        | (F.col("file_path").startswith("UPGRADE-") & F.col("file_path").endswith(".md") & ~F.contains("file_path", F.lit("/")))
    )
    return archive.unionByName(supplement.filter(kept).join(archive, ["tag", "file_path"], "left_anti"))


def walked(files: DataFrame) -> DataFrame:
    """(version, file_path, area, language, content) of the files that are indexed: filters before any content is read."""
    return (
        files.filter(routing.is_candidate("file_path"))
        .select(
            F.regexp_replace("tag", "^v", "").alias("version"), "file_path", routing.area("file_path").alias("area"),
            routing.language("file_path").alias("language"), "content",
        )
        .filter(F.col("area") != routing.OTHER)
    )


def tags(files: DataFrame, pattern: str = "v6.*", skip_prerelease: bool = True) -> DataFrame:
    """(tag) that match a shell pattern, in numeric order."""
    like = pattern.replace(".", r"\.").replace("*", ".*").replace("?", ".")
    found = files.select("tag").distinct().filter(F.col("tag").rlike(f"^{like}$"))
    found = found.filter(versions.is_stable("tag")) if skip_prerelease else found
    return found.orderBy(versions.tag_order("tag"), "tag")


def paths(files: DataFrame, tag: str, prefix: str = "") -> DataFrame:
    """(file_path) of one release below a prefix."""
    return files.filter((F.col("tag") == tag) & F.col("file_path").startswith(prefix)).select("file_path")


def file_at(files: DataFrame, tag: str, path: str) -> DataFrame:
    """(content) of one file of one release: no row if it isn't there."""
    return files.filter((F.col("tag") == tag) & (F.col("file_path") == path)).select("content")

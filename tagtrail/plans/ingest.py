"""From files of releases to chunks with vectors in the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrail.functions import embedding
from tagtrail.functions import text as T
from tagtrail.operators import caching
from tagtrail.operators.chunking import chunk_files
from tagtrail.plans.work import materialise
from tagtrail.sources.store import Store
from tagtrail.sources.tree import walked


def embedded(chunks: DataFrame, store: Store, embedder: embedding.Embedder) -> DataFrame:
    """Chunks with vectors: held ones are reused, and each new content is embedded once and kept."""
    text = T.embedding_text("language", "symbol_fqn", "symbol_name", "file_path", "content")
    new = caching.unknown(chunks, store.vectors(), ["content_sha"]).groupBy("content_sha").agg(F.min(text).alias("text"))
    store.cache_vectors(new.select("content_sha", embedding.embed("text", embedder).alias("vector")))
    return caching.with_vectors(chunks, store.vectors())


def ingest(files: DataFrame, store: Store, embedder: embedding.Embedder) -> DataFrame:
    """Take in the releases of ``files`` (tag, file_path, content) that are not done; returns (version, area, n).

    A column ``sha``, if there is one, holds the commit a release points at, and is kept with it.

    Every step may be repeated: chunks replace their partitions, points and vectors keep the first
    record, and a release is marked done last.
    """
    store.ensure()
    todo = files.join(store.read("tag_status").filter("finished_at is not null").select("tag").distinct(), "tag", "left_anti")
    chunks = materialise(chunk_files(walked(todo)), "chunks")
    store.upsert_chunks(embedded(chunks, store, embedder))
    tag = F.concat(F.lit("v"), F.col("version")).alias("tag")
    store.record_points(chunks.select("point_id", tag, "file_path", "content_sha"))
    counts = chunks.groupBy("version", "area").agg(F.count("*").alias("n"))
    store.mark_all_done(finished(todo, chunks.groupBy(tag).agg(F.count("*").alias("chunk_count"))))
    return counts


def finished(files: DataFrame, counts: DataFrame) -> DataFrame:
    """(tag, sha, chunk_count) of the releases of files (tag, maybe sha) from counts (tag, chunk_count)."""
    sha = F.coalesce(F.max("sha"), F.lit("")) if "sha" in files.columns else F.lit("")
    return files.groupBy("tag").agg(sha.alias("sha")).join(counts, "tag", "left").fillna(0, ["chunk_count"])

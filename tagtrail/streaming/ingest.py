"""Incremental ingest of landed files with Structured Streaming.

The file source's checkpoint remembers which files were seen; each batch runs the same plan as a
full ingest, so a batch that is run again after a failure changes nothing. Points and vectors are
de-duplicated against the store's tables, not in streaming state, which would grow without bound.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tagtrail.functions import embedding
from tagtrail.functions import text as T
from tagtrail.operators.chunking import chunk_files
from tagtrail.plans.ingest import embedded
from tagtrail.plans.work import materialise
from tagtrail.sources.store import Store
from tagtrail.sources.tree import walked


def ingest_batch(store: Store, embedder: embedding.Embedder):
    """The function a stream of files (tag, file_path, content) calls with every batch."""

    def run(batch: DataFrame, _: int) -> None:
        store.ensure()
        chunks = materialise(chunk_files(walked(batch)), "stream-chunks")
        touched = chunks.select("area", "version").distinct()
        # files of a partition that came before stay: the partition is rewritten with both
        held = materialise(
            store.chunks().join(touched, ["area", "version"], "left_semi").join(
                chunks.select("area", "version", "file_path").distinct(), ["area", "version", "file_path"], "left_anti"
            ), "stream-held",
        )
        store.upsert_chunks(embedded(chunks, store, embedder).unionByName(held, allowMissingColumns=True))
        tag = F.concat(F.lit("v"), F.col("version")).alias("tag")
        store.record_points(chunks.select("point_id", tag, "file_path", "content_sha"))

    return run


def stream_files(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of files landed as Parquet rows (tag, file_path, content)."""
    return spark.readStream.schema("tag string, file_path string, content string").parquet(folder)


def ingest_available(files: DataFrame, store: Store, embedder: embedding.Embedder, checkpoint: str) -> StreamingQuery:
    """Take in all that has landed since the last call, in bounded batches, and stop."""
    return (
        files.writeStream.foreachBatch(ingest_batch(store, embedder)).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )


def ingest_landed(files: DataFrame, store: Store, embedder: embedding.Embedder, checkpoint: str) -> None:
    """As :func:`ingest_available`, waited for; then every release that has points and isn't done is marked done.

    Files of a release that land later still are taken in, as each call reads what is new, and don't unmark it.
    """
    ingest_available(files, store, embedder, checkpoint).awaitTermination()
    counts = store.read("chunk_index").groupBy("tag").agg(F.countDistinct("point_id").alias("chunk_count"))
    done = store.read("tag_status").filter("finished_at is not null").select("tag").distinct()
    store.mark_all_done(materialise(counts.join(done, "tag", "left_anti").select("tag", F.lit("").alias("sha"), "chunk_count"), "stream-done"))


def deprecations_seen(files: DataFrame, delay: str = "1 day") -> DataFrame:
    """(window, deprecated_in, n) of a stream of files with ``landed_at``: marks counted by day, late files up to ``delay``."""
    marks = files.withWatermark("landed_at", delay).select("landed_at", F.explode(T.found("content", T.DEPRECATED)).alias("deprecated_in"))
    return marks.groupBy(F.window("landed_at", "1 day"), "deprecated_in").agg(F.count("*").alias("n"))

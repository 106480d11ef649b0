"""The index as partitioned Parquet tables under one folder.

``chunks`` lies partitioned by (area, version), sorted by symbol, so that a search in an area or a
release prunes partitions and row groups. ``chunk_index``, ``vector_cache`` and ``tag_status`` are
append-only; their first (or, for ``tag_status``, last) row of a key counts, which makes every
write safe to repeat. One writer at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.functions import versions
from tagtrail.operators import caching
from tagtrail.operators.chunking import FIELDS

_CHUNKS = (
    "point_id string, version string, version_tuple array<int>, area string, file_path string, language string, chunk_idx int, "
    + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", content_sha string, vector array<float>"
)
SCHEMAS = {
    "chunks": _CHUNKS,
    "chunk_index": "point_id string, tag string, file_path string, content_sha string, recorded_at timestamp",
    "vector_cache": "content_sha string, vector array<float>, cached_at timestamp",
    "tag_status": "tag string, sha string, finished_at timestamp, chunk_count int",
}


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self._ensured = spark, root.rstrip("/"), False

    def _path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def ensure(self) -> None:
        """Create what isn't there; safe to repeat, done once a session."""
        if self._ensured:
            return
        for name in SCHEMAS:
            at = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(name))
            at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(at)
        self._ensured = True

    def read(self, name: str) -> DataFrame:
        """A table; empty if nothing was written yet."""
        self.ensure()
        return self.spark.read.schema(SCHEMAS[name]).parquet(self._path(name))

    # chunks

    def upsert_chunks(self, chunks: DataFrame) -> None:
        """Replace the (area, version) partitions that occur in ``chunks``; of rows with one point_id the last in path order counts."""
        kinds = dict(self.read("chunks").dtypes)
        rows = caching.last_of_each(chunks, ["point_id"], [F.col("file_path"), F.col("chunk_idx")])
        (
            rows.select(*[c if c in rows.columns else F.lit(None).cast(kind).alias(c) for c, kind in kinds.items()])
            .repartition("area", "version", F.pmod(F.xxhash64("file_path"), F.lit(8)))  # a large partition is written by several tasks
            .sortWithinPartitions("area", "version", "symbol_fqn")
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("area", "version").parquet(self._path("chunks"))
        )

    def chunks(self) -> DataFrame:
        return self.read("chunks")

    # chunk index

    def record_points(self, rows: DataFrame) -> None:
        """Add points not yet recorded; the first record of a point stays."""
        new = caching.unknown(rows, self.read("chunk_index"), ["point_id"])
        order = [F.col(c).asc_nulls_last() for c in ("recorded_at", "tag", "file_path", "content_sha")]
        first = caching.first_of_each(new.withColumn("recorded_at", F.col("recorded_at") if "recorded_at" in rows.columns else F.current_timestamp()), ["point_id"], order)
        first.select("point_id", "tag", "file_path", "content_sha", "recorded_at").write.mode("append").parquet(self._path("chunk_index"))

    def has_point(self, point_id: str) -> bool:
        return not self.read("chunk_index").filter(F.col("point_id") == point_id).limit(1).isEmpty()

    def known_point_ids(self) -> DataFrame:
        return self.read("chunk_index").select("point_id").distinct()

    # vector cache

    def cache_vectors(self, pairs: DataFrame) -> None:
        """Keep vectors (content_sha, vector) not yet held; the first write of a content stays."""
        new = caching.unknown(pairs.filter("content_sha is not null and vector is not null"), self.read("vector_cache"), ["content_sha"])
        one = new.groupBy("content_sha").agg(F.min("vector").alias("vector"))
        one.withColumn("cached_at", F.current_timestamp()).write.mode("append").parquet(self._path("vector_cache"))

    def vectors(self) -> DataFrame:
        """(content_sha, vector): one row per content."""
        first = F.min(F.struct("cached_at", "vector")).alias("first")
        return self.read("vector_cache").groupBy("content_sha").agg(first).select("content_sha", F.col("first.vector").alias("vector"))

    def warm_cache(self) -> None:
        """Fill the cache from stored chunks."""
        self.cache_vectors(caching.backfill(self.chunks(), self.read("chunk_index"), self.vectors()))

    # releases

    def mark_done(self, tag: str, sha: str, chunk_count: int) -> None:
        self.mark_all_done(self.spark.createDataFrame([(tag, sha, int(chunk_count))], "tag string, sha string, chunk_count int"))

    def mark_all_done(self, releases: DataFrame) -> None:
        """Releases (tag, sha, chunk_count) as done, in one write."""
        count = F.col("chunk_count").cast("int").alias("chunk_count")
        releases.select("tag", "sha", F.current_timestamp().alias("finished_at"), count).write.mode("append").parquet(self._path("tag_status"))

    def tag_summary(self) -> DataFrame:
        """The last state of every tag, in numeric order."""
        last = caching.last_of_each(self.read("tag_status"), ["tag"], [F.col("finished_at")])
        return last.orderBy(versions.tag_order("tag"), "tag")

    def is_done(self, tag: str) -> bool:
        return not self.read("tag_status").filter((F.col("tag") == tag) & F.col("finished_at").isNotNull()).limit(1).isEmpty()

"""History of changing entity attributes.

An entity's *chain* is its list of versions: longest runs of consecutive periods in which the
entity was delivered with the same attribute values. Chains are kept in a store and rebuilt one
entity at a time (affected-chain rebuild):

1. a delivery, on time, late or corrected, is appended to the raw changes;
2. the raw changes of the entities it touches are read back: of the buckets they lie in, and of
   those only the touched entities go on;
3. all intervals of those entities are built anew, and written with the other chains of their
   buckets, which are taken over as they are;
4. the new files are published together by one manifest, which names the delivery that wrote each
   bucket last. A reader takes the files of the newest manifest and no others, so it sees either
   all old or all new chains, each once; nothing is compared on reading.

Raw changes and chains lie in hash buckets of the entity, sorted by it. The number of buckets
follows from the entities of the first delivery (``PER_BUCKET`` each) and stays, so a delivery
reads and writes as many buckets as it touches entities, at most. What no manifest names any more
can be removed (:meth:`EntityHistory.compact`).

Defined results
    * rows without entity or period are ignored; an empty delivery changes nothing;
    * of several rows for one entity and period the latest ``recorded_at`` counts (null is the
      earliest; of a tie the greater attribute values count), so repeated rows change nothing;
    * a null attribute says nothing: the value before holds on, also over a gap; without a value
      before it stays null, which is a value of its own;
    * a period without the entity ends the version;
    * other columns of a delivery, of whatever name, are dropped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_NEWEST = "_latest"
#: Fewest buckets, and entities of a bucket.
BUCKETS, PER_BUCKET = 8, 20_000


def latest_changes(changes: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(entity, period, recorded_at, *attributes): the row that counts for each entity and period.

    An aggregate with partial sums per task: a hot entity is reduced before the shuffle, and
    leaves at most one row per period.
    """
    values = F.struct("recorded_at", *attributes)
    return (
        changes.filter(F.col("entity").isNotNull() & F.col("period").isNotNull())
        .groupBy("entity", "period")
        .agg(F.max(values).alias(_NEWEST))
        .select("entity", "period", f"{_NEWEST}.*")
    )


def build_chains(latest: DataFrame, attributes: Sequence[str]) -> DataFrame:
    """(entity, valid_from, valid_to, *attributes) from one row per entity and period.

    The windows hold one row per period of an entity. They share one partitioning, so there is
    one shuffle.
    """
    by_period = Window.partitionBy("entity").orderBy("period")
    so_far = by_period.rowsBetween(Window.unboundedPreceding, 0)
    filled = latest.select(
        "entity", "period", *[F.last(a, ignorenulls=True).over(so_far).alias(a) for a in attributes]
    )
    state = F.struct(*attributes)
    starts = (
        F.lag("period").over(by_period).isNull()
        | (F.lag("period").over(by_period) != F.col("period") - 1)
        | ~F.lag(state).over(by_period).eqNullSafe(state)
    )
    runs = filled.withColumn("starts", starts.cast("int")).withColumn("run", F.sum("starts").over(so_far))
    return runs.groupBy("entity", "run").agg(
        F.min("period").alias("valid_from"),
        F.max("period").alias("valid_to"),
        *[F.first(a).alias(a) for a in attributes],
    ).drop("run")


class EntityHistory:
    """Raw changes and chains of one kind of entity under ``path``, a folder all executors share.

    One writer at a time; any number of readers. Deliveries are DataFrames with the columns
    entity (string), period (int; consecutive periods differ by 1), recorded_at (timestamp) and
    the attributes.
    """

    def __init__(self, spark: SparkSession, path: str, attributes: Sequence[str], buckets: int | None = None):
        self.spark, self.path, self.attributes, self.buckets = spark, path.rstrip("/"), list(attributes), buckets

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str, prefix: str = "") -> list[int]:
        """The numbers that name the entries of a folder."""
        at, fs = self._fs(folder)
        names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix) and n[len(prefix) :].isdigit())

    def published(self) -> list[int]:
        """Numbers of the published deliveries."""
        return self._listed("published")

    def manifest(self) -> dict[int, int]:
        """The delivery that last wrote each bucket's chains."""
        done = self.published()
        if not done:
            return {}
        at, fs = self._fs(f"published/{done[-1]}")
        stream = fs.open(at)
        lines = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split()
        stream.close()
        return {int(b): int(d) for b, d in (x.split("=") for x in lines)}

    def _publish(self, number: int, manifest: dict[int, int]) -> None:
        """One rename makes a delivery seen."""
        draft, fs = self._fs(f"draft-{number}")
        out = fs.create(draft, True)
        out.write(bytearray("\n".join(f"{b}={d}" for b, d in sorted(manifest.items())).encode()))
        out.close()
        at, _ = self._fs(f"published/{number}")
        fs.mkdirs(at.getParent())
        if not fs.rename(draft, at):
            raise RuntimeError(f"delivery {number} is published already")

    def _layout(self, changes: DataFrame) -> int:
        """The store's number of buckets; a new store is laid out for its first delivery."""
        if laid_out := self._listed("buckets"):
            return laid_out[0]
        count = self.buckets
        if count is None:
            entities = changes.agg(F.approx_count_distinct("entity")).first()[0]  # one number, from partial sketches
            count = max(BUCKETS, -(-entities // PER_BUCKET))
        at, fs = self._fs(f"buckets/{count}")
        fs.create(at, False).close()
        return count

    def _write(self, rows: DataFrame, kind: str, number: int, buckets: int, *order: str) -> None:
        rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", *order).write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.path}/{kind}/delivery={number}"
        )

    def _read(self, kind: str, schema, numbers: Sequence[int]) -> DataFrame:
        reader = self.spark.read.option("basePath", f"{self.path}/{kind}")
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(*[f"{self.path}/{kind}/delivery={n}" for n in numbers])

    def _current(self, manifest: dict[int, int], schema=None) -> DataFrame:
        """The chains a manifest names."""
        reader = self.spark.read.option("basePath", f"{self.path}/chains")
        if schema is not None:
            reader = reader.schema(schema)
        return reader.parquet(*[f"{self.path}/chains/delivery={d}/bucket={b}" for b, d in sorted(manifest.items())])

    def deliver(self, changes: DataFrame) -> None:
        """Take in changes of any periods and rebuild the chains of the entities they touch."""
        done, manifest = self.published(), self.manifest()
        number = (done[-1] if done else 0) + 1
        buckets = self._layout(changes)
        bucket = F.pmod(F.xxhash64("entity"), F.lit(buckets)).cast("int").alias("bucket")
        latest = latest_changes(changes, self.attributes).select("*", bucket)
        self._write(latest, "raw", number, buckets, "entity")
        touched = self._listed(f"raw/delivery={number}", "bucket=")
        if not touched:
            return
        mine = F.col("bucket").isin(touched)
        new = self._read("raw", latest.schema, [number])
        raw = self._read("raw", latest.schema, [*done, number]).filter(mine)
        entities = new.select("entity").distinct()
        if done:
            raw = raw.join(entities, "entity", "left_semi")
        chains = build_chains(latest_changes(raw, self.attributes), self.attributes).select("*", bucket)
        before = {b: d for b, d in manifest.items() if b in set(touched)}
        if before:
            kept = self._current(before, chains.schema).join(entities, "entity", "left_anti")
            chains = chains.unionByName(kept.select(chains.columns))
        self._write(chains, "chains", number, buckets, "entity", "valid_from")
        self._publish(number, {**manifest, **dict.fromkeys(touched, number)})

    def chains(self) -> DataFrame:
        """(entity, valid_from, valid_to, *attributes) of every entity as last published."""
        manifest = self.manifest()
        columns = ["entity", "valid_from", "valid_to", *self.attributes]
        if not manifest:
            kinds = "entity string, valid_from int, valid_to int, " + ", ".join(f"{a} string" for a in self.attributes)
            return self.spark.createDataFrame([], kinds)
        return self._current(manifest).select(*columns)

    def compact(self) -> None:
        """Remove chains that the newest manifest doesn't name; no reader of an older one may be at work."""
        named = {(d, b) for b, d in self.manifest().items()}
        for delivery in self._listed("chains", "delivery="):
            for bucket in self._listed(f"chains/delivery={delivery}", "bucket="):
                if (delivery, bucket) not in named:
                    at, fs = self._fs(f"chains/delivery={delivery}/bucket={bucket}")
                    fs.delete(at, True)

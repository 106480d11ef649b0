"""What changed between consecutive full snapshots.

Method: content-defined chunks of key-sorted snapshots. All snapshots are sorted by key through
one range exchange. A key whose hash falls on a fixed residue opens a chunk, so chunk bounds
depend on the keys alone and an added or removed row disturbs only its own chunk. Each chunk is
reduced to a digest of its rows; chunks whose digest is the same in two consecutive snapshots
are discarded, and only rows of the remaining chunks are joined to tell added, removed and
changed keys apart.

Defined results
    * rows without snapshot, key or value are ignored (they say nothing);
    * a key's content in a snapshot is its *set* of values: order and repetition don't count;
    * an empty input, or a single snapshot, gives no rows;
    * columns other than snapshot, key and value, of whatever name, are dropped.

Sets and chunks are compared by a count and two independent 64-bit digests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.plans.work import materialise

#: Mean number of rows of a chunk. Small chunks discard more rows, large ones need fewer digests.
CHUNK_ROWS = 16


def key_states(rows: DataFrame) -> DataFrame:
    """(snapshot, key, n, d1, d2): the set of values of each key in each snapshot, as a digest.

    Values are hashed before the first shuffle. Repetitions are dropped under the whole
    (snapshot, key, value), so a key with a great share of all rows is spread over tasks.
    """
    hashed = rows.select(
        "snapshot", "key", F.xxhash64("value").alias("h1"), F.xxhash64(F.lit(0x5EED), F.reverse("value")).alias("h2"),
        F.col("value").isNull().alias("gone"),
    ).filter(F.col("snapshot").isNotNull() & F.col("key").isNotNull() & ~F.col("gone"))
    return (
        hashed.select("snapshot", "key", "h1", "h2").distinct().groupBy("snapshot", "key")
        .agg(F.count("*").alias("n"), F.bit_xor("h1").alias("d1"), F.bit_xor("h2").alias("d2"))
    )


def chunked(states: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """States with ``part``, the range of keys they lie in, and ``chunk``, the key that opens their chunk.

    The first key of a range opens a chunk too. Written to the shared folder, so that both uses
    below see the same ranges.
    """
    ranged = states.repartitionByRange("key").withColumn("part", F.spark_partition_id())
    in_order = Window.partitionBy("part", "snapshot").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    opens = F.when(F.pmod(F.xxhash64("key"), F.lit(chunk_rows)) == 0, F.col("key"))
    return ranged.withColumn("chunk", F.coalesce(F.last(opens, ignorenulls=True).over(in_order), F.lit("")))


def snapshot_changes(rows: DataFrame, snapshots: DataFrame | None = None, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(snapshot, key, change) from rows of (snapshot int, key string, value string).

    ``snapshot`` is the later one of the two compared; snapshots are numbered without gaps.
    ``snapshots`` lists them, so that an empty one counts; by default those that hold rows.
    """
    states = materialise(chunked(key_states(rows), chunk_rows), "snapshot-chunks")
    digests = states.groupBy("part", "chunk", "snapshot").agg(
        F.count("*").alias("rows"),
        F.bit_xor(F.xxhash64("key", "n", "d1", "d2")).alias("x1"),
        F.bit_xor(F.xxhash64("d2", "n", "key", "d1")).alias("x2"),
    )
    by_time = Window.partitionBy("part", "chunk").orderBy("snapshot")
    same = lambda step: (
        step(F.struct(F.col("snapshot"), "rows", "x1", "x2")).over(by_time)
    )
    before, after = same(F.lag), same(F.lead)
    equal = lambda other, gap: F.coalesce(
        (other["snapshot"] == F.col("snapshot") + gap) & (other["rows"] == F.col("rows"))
        & (other["x1"] == F.col("x1")) & (other["x2"] == F.col("x2")), F.lit(False),
    )
    unmatched = (
        digests.withColumns({"b": before, "a": after})
        .select("part", "chunk", "snapshot", equal(F.col("b"), -1).alias("as_before"), equal(F.col("a"), 1).alias("as_after"))
        .filter(~(F.col("as_before") & F.col("as_after")))
    )
    left = states.join(unmatched, ["part", "chunk", "snapshot"])
    state = F.struct("n", "d1", "d2")
    new = left.filter(~F.col("as_before")).select("snapshot", "key", state.alias("new"))
    old = left.filter(~F.col("as_after")).select((F.col("snapshot") + 1).alias("snapshot"), "key", state.alias("old"))
    first, last = (snapshots or states).agg(F.min("snapshot"), F.max("snapshot")).first()  # two numbers
    change = (
        F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed")
        .when(F.col("old") != F.col("new"), "changed")
    )
    return (
        new.join(old, ["snapshot", "key"], "full_outer")
        .select("snapshot", "key", change.alias("change"))
        .filter(F.col("change").isNotNull() & (F.col("snapshot") > F.lit(first)) & (F.col("snapshot") <= F.lit(last)))
    )

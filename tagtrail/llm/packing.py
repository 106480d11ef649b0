"""Filling fixed-capacity containers, mixture-controlled.

Items wait in one queue per source, in the order of a hash of their keys, so that runs of like items
don't end up in one window. Deficit round-robin serves the queues in
rounds: each round adds the source's quantum (its target share of a window) to its deficit, and
the source sends items from the head while the deficit covers them. What one round serves is a
*window*; it holds every source in its target proportion up to one item.

A queue that is never empty when served needs no loop: its item j is sent in the first round r
with r * quantum >= the sizes of items 1..j together. So the round follows from a running sum.
Running sums are carried over partitions: each range of keys is summed where it lies, the few
sums are added up per source, and each range starts from its carry. No source is gathered in one
task, however large its share.

A window holds about ``WINDOW`` containers' worth of tokens whatever the corpus, and is packed by
best fit, largest items first, in one task; windows are packed in parallel.

Defined results
    * an item larger than the capacity is cut into full containers of its own and a rest, which
      is packed like an item; no other item is split;
    * an item of size 0 (null or empty text) needs no container: container, piece and start are null;
    * a null source is a source of its own; ties and repeated sizes go by key;
    * with ``targets`` (shares by source), a source that ends early leaves its part of later
      windows unused; sources not named get the share of their sizes in what is left of 1;
    * an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.plans.work import materialise

#: Capacity of a container, and containers' worth of tokens in a window.
CAPACITY, WINDOW = 2048, 512


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """Container number of each item, largest first into the fullest container it fits; and how many containers."""
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    room: list[tuple[int, int]] = []  # (space left, container), sorted
    place, count = [0] * len(sizes), 0
    for i in order:
        at = bisect_left(room, (sizes[i], -1))
        if at < len(room):
            space, box = room.pop(at)
        else:
            space, box, count = capacity, count, count + 1
        place[i] = box
        if space > sizes[i]:
            insort(room, (space - sizes[i], box))
    return place, count


def rounds(items: DataFrame, capacity: int, window: int, targets: dict[str, float] | None = None) -> DataFrame:
    """Items (key, source, size > 0) with ``round``, the deficit round-robin round that sends them."""
    laid = materialise(
        items.withColumn("turn", F.xxhash64("key")).repartitionByRange("source", "turn").withColumn("part", F.spark_partition_id()),
        "packing-queues",
    )
    sums = laid.groupBy("source", "part").agg(F.sum("size").alias("here"))
    by_source = Window.partitionBy("source")
    carries = sums.select(
        "source", "part",
        (F.sum("here").over(by_source.orderBy("part")) - F.col("here")).alias("carry"),
        F.sum("here").over(by_source).alias("of_source"),
    )
    of_all = laid.agg(F.sum("size")).first()[0] or 1  # a number
    if targets:
        rest = max(0.0, 1.0 - sum(targets.values()))
        unnamed = laid.filter(~F.coalesce(F.col("source").isin(list(targets)), F.lit(False)))
        share = F.lit(rest / (unnamed.agg(F.sum("size")).first()[0] or 1)) * F.col("of_source")
        for source, target in targets.items():
            share = F.when(F.col("source") == source, F.lit(float(target))).otherwise(share)
    else:
        share = F.col("of_source") / F.lit(of_all)
    # as many whole windows as the corpus fills, so that the last is as full as the others
    windows = max(1, round(of_all / (capacity * window)))
    quantum = F.greatest(share * F.lit(of_all / windows), F.lit(1e-9))
    queues = carries.select("source", "part", "carry", quantum.alias("quantum"))
    queues = queues.withColumnRenamed("source", "q_source").withColumnRenamed("part", "q_part")
    sent = F.sum("size").over(Window.partitionBy("source", "part").orderBy("turn", "key", "piece"))
    summed = laid.withColumn("sent", sent)
    joined = summed.join(queues, F.col("source").eqNullSafe(F.col("q_source")) & (F.col("part") == F.col("q_part")))
    number = F.ceil((F.col("carry") + F.col("sent")) / F.col("quantum") - F.lit(1e-9)).cast("bigint")
    return joined.select("key", "piece", "source", "size", "start", number.alias("round"))


def pack(
    items: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, targets: dict[str, float] | None = None
) -> DataFrame:
    """(key, piece, start, size, source, container) of items (key, source, size).

    ``container`` is a string: the window's number and the container's in it. A piece of an item
    begins at ``start`` and is ``size`` long.
    """
    kind = items.schema["key"].dataType.simpleString()
    items = materialise(items.select("key", "source", F.coalesce("size", F.lit(0)).cast("bigint").alias("size")), "packing-items")
    whole = F.floor(F.col("size") / capacity).cast("bigint")
    rest = F.col("size") % capacity
    large = items.filter(F.col("size") >= capacity)
    full = large.select(
        "key", "source", F.explode(F.sequence(F.lit(0).cast("bigint"), whole - 1)).alias("piece")
    ).select(
        "key", "piece", (F.col("piece") * capacity).alias("start"), F.lit(capacity).cast("bigint").alias("size"), "source",
        F.concat_ws("-", F.lit("full"), F.col("key").cast("string"), F.col("piece").cast("string")).alias("container"),
    )
    parts = items.filter(rest > 0).select(
        "key", "source", whole.alias("piece"), (whole * capacity).alias("start"), rest.alias("size")
    )
    nothing = F.lit(None).cast("bigint")
    empty = items.filter(F.col("size") <= 0).select(
        "key", nothing.alias("piece"), nothing.alias("start"), F.lit(0).cast("bigint").alias("size"), "source",
        F.lit(None).cast("string").alias("container"),
    )

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for batch in batches:  # sorted by round; a window may go on in the next batch
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            last = rows["round"].iloc[-1] if len(rows) else None
            left = rows[rows["round"] == last]
            yield from packed(rows[rows["round"] != last])
        if left is not None:
            yield from packed(left)

    def packed(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for number, of_window in rows.groupby("round", sort=False):
            of_window = of_window.sort_values(["size", "key", "piece"], ascending=[False, True, True], kind="stable")
            place, _ = best_fit(of_window["size"].tolist(), capacity)
            of_window = of_window.assign(container=[f"{number}-{p}" for p in place])
            yield of_window[["key", "piece", "start", "size", "source", "container"]]

    schema = f"key {kind}, piece bigint, start bigint, size bigint, source string, container string"
    by_round = rounds(parts, capacity, window, targets).repartition("round").sortWithinPartitions("round")
    return by_round.mapInPandas(fill, schema).unionByName(full).unionByName(empty)

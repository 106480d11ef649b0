import random

import pytest
from pyspark.sql import functions as F

from tagtrail.llm.packing import best_fit, pack, rounds


def items(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "key bigint, source string, size bigint, container string")


def checked(rows, got, capacity):
    size = {k: s or 0 for k, _, s in rows}
    boxes, pieces = {}, {}
    for r in got:
        pieces.setdefault(r["key"], []).append((r["piece"], r["start"], r["size"]))
        if r["container"] is not None:
            boxes.setdefault(r["container"], []).append((r["key"], r["size"]))
    assert set(pieces) == set(size)
    for k, parts in pieces.items():
        if size[k] <= 0:
            assert parts == [(None, None, 0)]
        elif size[k] <= capacity:
            assert [p[2] for p in parts] == [size[k]]
        else:
            parts.sort()
            assert sum(p[2] for p in parts) == size[k] and all(p[2] == capacity for p in parts[:-1])
            assert [p[1] for p in parts] == [i * capacity for i in range(len(parts))]
    assert all(sum(s for _, s in box) <= capacity for box in boxes.values())
    return boxes


def test_best_fit_leaves_little_room():
    rng = random.Random(1)
    sizes = [rng.randrange(1, 101) for _ in range(500)]
    place, count = best_fit(sizes, 100)
    assert count <= -(-sum(sizes) // 100) * 1.05 and len(place) == 500
    assert best_fit([], 100) == ([], 0) and best_fit([100, 100], 100)[1] == 2


def test_every_item_is_placed_whole(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["a", "b", "c", None]), rng.choice([None, 0, 1, 5, 40, 99, 100, 101, 350, rng.randrange(1, 100)])) for i in range(600)]
    boxes = checked(rows, pack(items(spark, rows), 100, 8).collect(), 100)
    used = sum(s or 0 for _, _, s in rows)
    assert len(boxes) <= used / 100 * 1.06
    assert pack(items(spark, []), 100, 8).count() == 0


def test_rounds_are_those_of_a_deficit_loop_and_keep_the_mixture(spark):
    rng = random.Random(3)
    rows = [(i, rng.choices(["a", "b", "c"], [5, 3, 1])[0], rng.randrange(1, 60)) for i in range(900)]
    capacity, window = 100, 20
    df = items(spark, rows).select("key", F.lit(0).alias("piece"), F.lit(0).alias("start"), "source", "size")
    got = {r["key"]: r["round"] for r in rounds(df, capacity, window).collect()}
    turn = {r["key"]: r["turn"] for r in df.select("key", F.xxhash64("key").alias("turn")).collect()}
    queues = {s: sorted((r for r in rows if r[1] == s), key=lambda r: turn[r[0]]) for s in "abc"}
    total = sum(r[2] for r in rows)
    windows = max(1, round(total / (capacity * window)))
    want = {}
    for s, queue in queues.items():
        quantum, deficit, number = sum(r[2] for r in queue) / windows, 0.0, 0
        for k, _, size in queue:
            while deficit < size - 1e-6:
                deficit, number = deficit + quantum, number + 1
            want[k], deficit = number, deficit - size
    assert got == want
    for number in range(1, windows + 1):
        tokens = {s: sum(r[2] for r in rows if got[r[0]] == number and r[1] == s) for s in "abc"}
        for s in "abc":
            assert abs(tokens[s] - sum(r[2] for r in queues[s]) / windows) <= 60  # one item


def test_given_targets(spark):
    rows = [(i, "ab"[i % 2], 10) for i in range(400)]
    df = items(spark, rows).select("key", F.lit(0).alias("piece"), F.lit(0).alias("start"), "source", "size")
    got = rounds(df, 100, 4, {"a": 0.75}).groupBy("round", "source").agg(F.sum("size").alias("n")).collect()
    first = {r["source"]: r["n"] for r in got if r["round"] == 1}
    assert first == {"a": 300, "b": 100}
    assert sum(r["n"] for r in got) == 4000


@pytest.mark.parametrize("share", [1.0, 0.34])
def test_one_source_holds_a_great_share(spark, share):
    rows = [(i, "hot" if i < 3000 * share else f"s{i % 50}", 1 + i % 97) for i in range(3000)]
    boxes = checked(rows, pack(items(spark, rows), 100, 256).collect(), 100)
    assert len(boxes) <= sum(r[2] for r in rows) / 100 * 1.05

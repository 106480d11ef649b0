import random
from datetime import datetime, timedelta

import pytest

from tagtrail.operators.history import EntityHistory
from tagtrail.plans.work import work_path

SCHEMA = "entity string, period int, recorded_at timestamp, a string, b string, bucket string, delivery string"
START = datetime(2024, 1, 1)


def row(entity, period, at, a, b):
    return (entity, period, None if at is None else START + timedelta(hours=at), a, b, "extra", "extra")


def expected(rows):
    """The chains of plain Python: latest row per period, values filled, runs of consecutive periods."""
    key = lambda x: (x is not None, x or "")
    latest = {}
    for r in rows:
        if r[0] is None or r[1] is None:
            continue
        k, rank = (r[0], r[1]), ((r[2] is not None, r[2] or START), key(r[3]), key(r[4]))
        if k not in latest or rank > latest[k][0]:
            latest[k] = (rank, r[3], r[4])
    out, state = [], {}
    for (e, p), (_, a, b) in sorted(latest.items()):
        held = state.get(e)
        a, b = (a if a is not None else held and held[2]), (b if b is not None else held and held[3])
        if held and held[1] == p - 1 and held[2:] == (a, b):
            state[e] = (held[0], p, a, b)
        else:
            if held:
                out.append((e, *held))
            state[e] = (p, p, a, b)
    return sorted([*out, *((e, *s) for e, s in state.items())], key=str)


def chains(store):
    return sorted([tuple(r) for r in store.chains().collect()], key=str)


def test_late_and_corrected_rows_rebuild_only_their_chains(spark):
    rng = random.Random(3)
    rows = [
        row(rng.choice(["x", "y", "z", None]), rng.choice([1, 2, 3, 4, 5, 7, None]), rng.choice([None, *range(40)]), rng.choice(["p", "q", None]), rng.choice(["r", None]))
        for _ in range(120)
    ]
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"], buckets=3)
    sent = []
    for part in (rows[:60], rows[60:], [], [row("x", 3, 99, "new", "r")], rows[:20]):
        sent += part
        store.deliver(spark.createDataFrame(part, SCHEMA))
        assert chains(store) == expected(sent)


def test_blank_history_and_gaps(spark):
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"])
    assert store.chains().count() == 0
    store.deliver(spark.createDataFrame([row("x", p, 0, "v", None) for p in (1, 2, 4)], SCHEMA))
    assert chains(store) == [("x", 1, 2, "v", None), ("x", 4, 4, "v", None)]


def test_a_hot_entity_is_one_chain(spark):
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"])
    store.deliver(spark.createDataFrame([row("x", i % 3, i, "v", "w") for i in range(3000)] + [row(f"e{i}", 1, 1, "v", "w") for i in range(50)], SCHEMA))
    got = chains(store)
    assert len(got) == 51 and ("x", 0, 2, "v", "w") in got


def test_a_delivery_that_was_not_published_is_not_seen(spark, monkeypatch):
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"])
    store.deliver(spark.createDataFrame([row("x", 1, 0, "v", "w")], SCHEMA))
    before = chains(store)
    monkeypatch.setattr("tagtrail.operators.history.build_chains", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        store.deliver(spark.createDataFrame([row("x", 1, 5, "late", "w")], SCHEMA))
    assert chains(store) == before
    monkeypatch.undo()
    store.deliver(spark.createDataFrame([row("x", 1, 5, "late", "w")], SCHEMA))
    assert chains(store) == [("x", 1, 1, "late", "w")]


def test_a_small_delivery_touches_its_buckets_alone(spark):
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"], buckets=16)
    rows = [row(f"e{i}", p, 0, "v", "w") for i in range(200) for p in (1, 2)]
    store.deliver(spark.createDataFrame(rows, SCHEMA))
    assert set(store.manifest().values()) == {1} and len(store.manifest()) == 16
    late = [row("e7", 2, 9, "new", "w"), row("e9", 3, 9, "v", "w")]
    store.deliver(spark.createDataFrame(late, SCHEMA))
    newer = [b for b, d in store.manifest().items() if d == 2]
    assert 1 <= len(newer) <= 2
    want = expected([*rows, *late])
    assert chains(store) == want
    store.compact()
    left = {(d, b) for d in store._listed("chains", "delivery=") for b in store._listed(f"chains/delivery={d}", "bucket=")}
    assert left == {(d, b) for b, d in store.manifest().items()} and chains(store) == want
    again = EntityHistory(spark, store.path, ["a", "b"])
    again.deliver(spark.createDataFrame([row("e8", 9, 1, "x", "w")], SCHEMA))
    assert chains(again) == expected([*rows, *late, row("e8", 9, 1, "x", "w")])


def test_buckets_follow_the_entities(spark, monkeypatch):
    monkeypatch.setattr("tagtrail.operators.history.PER_BUCKET", 10)
    store = EntityHistory(spark, work_path(spark, "t"), ["a", "b"])
    store.deliver(spark.createDataFrame([row(f"e{i}", 1, 0, "v", "w") for i in range(300)], SCHEMA))
    assert 25 <= store._listed("buckets")[0] <= 35 and len(chains(store)) == 300

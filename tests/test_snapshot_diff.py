import random

import pytest

from tagtrail.operators.snapshot_diff import snapshot_changes

SCHEMA = "snapshot int, key string, value string, chunk string, part int"


def expected(rows, last=None):
    sets = {}
    for s, k, v in rows:
        if None not in (s, k, v):
            sets.setdefault(s, {}).setdefault(k, set()).add(v)
    out = set()
    for s in range(min(sets, default=0) + 1, (last or max(sets, default=0)) + 1):
        a, b = sets.get(s - 1, {}), sets.get(s, {})
        out |= {(s, k, "added") for k in b.keys() - a.keys()} | {(s, k, "removed") for k in a.keys() - b.keys()}
        out |= {(s, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


def got(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)
    return {tuple(r) for r in snapshot_changes(df, **args).collect()}


@pytest.mark.parametrize("chunk_rows", [1, 4, 1000])
def test_against_plain_sets(spark, chunk_rows):
    rng = random.Random(chunk_rows)
    state = {f"k{i}": {f"v{rng.randrange(9)}"} for i in range(300)}
    rows = []
    for s in range(1, 6):
        for k in rng.sample(sorted(state), 10):
            state[k] = {f"v{rng.randrange(9)}" for _ in range(rng.randrange(1, 4))}
        for k in rng.sample(sorted(state), 3):
            del state[k]
        state[f"n{s}"] = {"v"}
        rows += [(s, k, v) for k, vs in state.items() for v in vs] + [(s, k, v) for k, vs in list(state.items())[:40] for v in vs]
    rows += [(None, "a", "b"), (1, None, "b"), (2, "only", None)]
    rng.shuffle(rows)
    assert got(spark, rows, chunk_rows=chunk_rows) == expected(rows)


def test_empty_single_and_missing_snapshots(spark):
    assert got(spark, []) == set()
    assert got(spark, [(1, "a", "b")]) == set()
    numbers = spark.createDataFrame([(1,), (2,), (3,)], "snapshot int")
    assert got(spark, [(1, "a", "b")], snapshots=numbers) == {(2, "a", "removed")}


def test_one_key_holds_a_third_of_all_rows(spark):
    rows = [(s, "hot", f"v{i}") for s in (1, 2) for i in range(2000)] + [(s, f"k{i}", "v") for s in (1, 2) for i in range(500)]
    assert got(spark, [*rows, (2, "hot", "one more")]) == {(2, "hot", "changed")}

from datetime import datetime

import numpy as np
import pytest

from tagtrail.llm import neighbours as nb


def frame(spark, rows, extra="x"):
    return spark.createDataFrame([(*r, extra, extra) for r in rows], "id string, vector array<float>, copy string, n string")


def exact(rows, k):
    names = [r[0] for r in rows]
    v = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    sim = v @ v.T
    np.fill_diagonal(sim, -2)
    return {a: [(names[j], sim[i, j]) for j in sorted(range(len(names)), key=lambda j: (-round(sim[i, j], 12), names[j]))[:k]] for i, a in enumerate(names)}


def clustered(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(n // 8, dim))
    v = centres[rng.integers(len(centres), size=n)] + 0.3 * rng.normal(size=(n, dim))
    return [(f"v{i:05}", (x * rng.uniform(0.1, 9)).astype(np.float32).tolist()) for i, x in enumerate(v)]


def test_recall_against_brute_force(spark):
    rows = clustered(1500, 16, 1)
    links = nb.nearest(frame(spark, rows), 5, dim=16, leaf=64, trees=8, probes=24).collect()
    want = exact(rows, 5)
    got = {}
    for r in links:
        got.setdefault(r["id"], []).append((r["rank"], r["other"], r["similarity"]))
    hits = sum(len({o for _, o, _ in got.get(a, [])} & {o for o, _ in best}) for a, best in want.items())
    assert hits / (5 * len(rows)) >= 0.95
    true = {(a, o): s for a, best in exact(rows, len(rows) - 1).items() for o, s in best}
    assert all(abs(true[(a, o)] - s) < 1e-6 for a, v in got.items() for _, o, s in v)
    assert all([r for r, _, _ in sorted(v)] == list(range(1, len(v) + 1)) for v in got.values())


def test_pairs_above_a_similarity(spark):
    rows = clustered(800, 16, 2)
    links = nb.nearest(frame(spark, rows), 5, least=0.9, dim=16, leaf=64)
    got = {tuple(r) for r in nb.mutual(links).collect()}
    near = {a: {o for o, s in best if s >= 0.9} for a, best in exact(rows, 5).items()}
    want = {(a, b) for a in near for b in near[a] if a < b and a in near[b]}
    assert len(got & want) >= 0.95 * len(want) and len(got - want) <= 0.02 * len(want)


def test_split_leaves_give_the_same(spark, monkeypatch):
    rows = clustered(600, 8, 3)
    whole = {tuple(r)[:2] for r in nb.nearest(frame(spark, rows), 3, dim=8, leaf=1000).collect()}
    monkeypatch.setattr(nb, "BLOCK", 50)
    split = {tuple(r)[:2] for r in nb.nearest(frame(spark, rows), 3, dim=8, leaf=1000).collect()}
    assert whole == split == {(a, o) for a, best in exact(rows, 3).items() for o, _ in best}


def test_large_leaves_get_a_forest_of_their_own(spark, monkeypatch):
    rows = clustered(1500, 16, 12)
    monkeypatch.setattr(nb, "LOCAL", 300)
    monkeypatch.setattr(nb, "LEAF", 100)
    links = nb.nearest(frame(spark, rows), 5, dim=16, leaf=5000).collect()  # one leaf of the first forest
    want, got = exact(rows, 5), {}
    for r in links:
        got.setdefault(r["id"], set()).add(r["other"])
    assert sum(len(got[a] & {o for o, _ in best}) for a, best in want.items()) >= 0.9 * 5 * len(rows)


def test_copies_and_ties(spark):
    copies = [(f"c{i:03}", [1.0, 2.0, 3.0]) for i in range(300)]
    others = clustered(200, 3, 4)
    got = {}
    for r in nb.nearest(frame(spark, [*copies, *others]), 5, dim=3, leaf=64, probes=40).collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert sorted(got["c299"]) == ["c000", "c001", "c002", "c003", "c004"] and sorted(got["c002"]) == ["c000", "c001", "c003", "c004", "c005"]
    assert all(len(got[c]) == 5 for c, _ in copies)


def test_a_crowd_of_near_copies_is_ranked_exactly(spark):
    rng = np.random.default_rng(8)
    one = rng.normal(size=64)
    rows = [(f"n{i:03}", (one + 0.01 * rng.normal(size=64)).astype(np.float32).tolist()) for i in range(240)]
    want = exact(rows, 5)
    for least in (None, 0.9):
        got = {(r["id"], r["rank"]): r["other"] for r in nb.nearest(frame(spark, rows), 5, least=least, leaf=1000).collect()}
        assert got == {(a, i + 1): o for a, best in want.items() for i, (o, _) in enumerate(best)}


def test_multiples_of_a_vector_are_copies(spark):
    rng = np.random.default_rng(9)
    one = rng.integers(-99, 99, size=8)
    multiples = [(f"m{i:03}", (one * float(f)).tolist()) for i, f in enumerate(rng.integers(1, 9999, size=60))]
    rows = [*multiples, *clustered(80, 8, 10), ("opposite", (one * -1.0).tolist())]
    got = {}
    for r in nb.nearest(frame(spark, rows), 5, dim=8, leaf=1000).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {a: [o for o, _ in best] for a, best in exact(rows, 5).items()}


def test_stated_queries(spark):
    rows = clustered(400, 8, 5)
    links = nb.nearest(frame(spark, rows), 5, one_in=20, dim=8, leaf=500).collect()
    asked = sorted({r["id"] for r in links})
    assert asked == [f"v{i:05}" for i in range(0, 400, 20)] or len(asked) == 20
    want = exact(rows, 5)
    assert all(r["other"] in {o for o, _ in want[r["id"]]} for r in links)


def test_copies_are_asked_for_too_however_rows_are_spread(spark):
    rows = [*[(f"c{i:03}", [1.0, 2.0, 3.0]) for i in range(130)], *clustered(70, 3, 11)]
    want = sorted(r[0] for r in rows)[::20]
    parts, adaptive = (spark.conf.get(f"spark.sql.{c}") for c in ("shuffle.partitions", "adaptive.enabled"))
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for n in (1, 3):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {}
            for r in nb.nearest(frame(spark, rows), 5, one_in=20, dim=3, leaf=500).orderBy("id", "rank").collect():
                got.setdefault(r["id"], []).append(r["other"])
            assert sorted(got) == want and all(len(v) == 5 for v in got.values())
            assert got["c120"] == [f"c{i:03}" for i in range(5)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@pytest.mark.parametrize("rows", [[], [("a", [1.0, 0.0])]])
def test_too_few(spark, rows):
    assert nb.nearest(frame(spark, rows), 5, dim=2).count() == 0


def test_usable(spark):
    day = lambda d: datetime(2024, 1, d)
    nan, inf = float("nan"), float("inf")
    rows = [("a", [1.0, 2.0], day(2)), ("a", [3.0, 4.0], day(1)), ("a", [5.0, 6.0], None), ("b", [nan, 1.0], day(1)), ("b", [1.0, inf], day(1)), ("c", [0.0, 0.0], day(1)),
            ("d", [1.0], day(1)), ("e", None, day(1)), ("f", [], day(1)), (None, [1.0, 1.0], day(1)), ("g", [None, 1.0], day(1)), ("h", [1.0, 1.0], None)]
    df = spark.createDataFrame(rows, "id string, vector array<float>, at timestamp")
    assert {r[0]: list(r[1]) for r in nb.usable(df, 2).collect()} == {"a": [3.0, 4.0], "h": [1.0, 1.0]}


def test_the_shared_queue_takes_the_nearest_branch_first():
    rng = np.random.default_rng(6)
    v = rng.normal(size=(500, 8)).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    forest = nb.fit(v, 500, 3, 32)
    seen = forest.walk(v[:50], 3 * 16 + 5)
    assert forest.depth == 4 and seen.shape == (50, 48)
    assert all(sorted(row) == list(range(48)) for row in seen.tolist())  # every leaf of every tree, once
    few = forest.walk(v[:50], 6)
    assert (few == seen[:, :6]).all()

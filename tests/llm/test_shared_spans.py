import random

import numpy as np
import pytest

from tagtrail.llm import shared_spans as s

SPAN, GRAM = 24, 12


def expected(rows, span):
    """Shared positions by a table of all windows."""
    holders = {}
    for k, t in rows:
        for i in range(len(t or "") - span + 1):
            if k is not None:
                holders.setdefault(t[i : i + span], set()).add(k)
    out = {}
    for k, t in rows:
        if k is None:
            continue
        for i in range(len(t or "") - span + 1):
            if len(holders[t[i : i + span]]) > 1:
                out.setdefault(k, set()).update(range(i, i + span))
    return out


def spans(spark, rows, span=SPAN, gram=GRAM, **more):
    df = spark.createDataFrame([(k, t, 1, "x") for k, t in rows], "doc_id bigint, text string, anchor int, key string")
    out = {}
    found = [tuple(r) for r in s.shared_spans(df, span, gram, **more).collect()]
    for k, a, b in found:
        assert b - a >= span
        assert not out.setdefault(k, set()) & set(range(a, b))
        out[k].update(range(a, b))
    assert len(found) == len(set(found))
    return out


def corpus(seed, docs=60):
    rng = random.Random(seed)
    letters = "abcdeé𝒳 \n"
    text = lambda n: "".join(rng.choices(letters, k=n))
    pool = [text(rng.choice([10, 23, 24, 25, 40, 90])) for _ in range(12)]
    rows = [(i, "".join(rng.choice([rng.choice(pool), text(rng.randrange(30))]) for _ in range(rng.randrange(6)))) for i in range(docs)]
    return [*rows, (900, None), (901, ""), (902, rows[3][1]), (903, "ab" * 100), (904, "ab" * 60), (905, " " * 500), (906, "z" * 300), (None, rows[3][1])]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_all_windows(spark, seed):
    rows = corpus(seed)
    assert spans(spark, rows) == expected(rows, SPAN)


def test_anchors_with_many_classes_go_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(s, "MANY", 1)
    rows = corpus(4)
    assert spans(spark, rows) == expected(rows, SPAN)


def test_a_sketch_that_is_far_too_small_loses_nothing(spark):
    rows = corpus(5, 400)
    assert spans(spark, rows, counters=1 << 16) == expected(rows, SPAN)


def test_a_header_shared_by_a_third_of_all(spark):
    rng = random.Random(6)
    header = "".join(rng.choices("abcdefgh", k=60))
    rows = [(i, (header if i % 3 == 0 else "") + "".join(rng.choices("abcdefgh", k=50))) for i in range(900)]
    got = spans(spark, rows)
    assert {k for k, v in got.items() if len(v) >= 60} == set(range(0, 900, 3))
    assert got == expected(rows, SPAN)


def test_repetition_inside_one_record_is_no_case(spark):
    text = "".join(random.Random(7).choices("abcdefgh", k=40))
    rows = [(1, text + text), (2, "other" * 20)]
    assert spans(spark, rows) == {} and spans(spark, [(1, text), (1, text)]) == {} and spans(spark, []) == {}


def test_production_parameters_and_coverage(spark):
    rng = random.Random(8)
    text = lambda n: "".join(rng.choices("abcdefgh \n", k=n))
    shared, short = text(240), text(239)
    rows = [(1, text(300) + shared + text(100)), (2, shared + text(400)), (3, text(50) + short + text(300)), (4, short + text(300)), (5, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in s.coverage(df, s.shared_spans(df)).collect()}
    assert {k: r["shared_chars"] for k, r in got.items()} == {1: 240, 2: 240, 3: 0, 4: 0, 5: 0} and got[5]["n_chars"] == 0


def test_every_span_holds_the_same_anchor():
    rng = random.Random(9)
    shared = "".join(rng.choices("abc", k=SPAN))
    texts = ["".join(rng.choices("abc", k=rng.randrange(40))) + shared + "".join(rng.choices("abc", k=rng.randrange(40))) for _ in range(30)]
    which, at, h = s.anchors(texts, SPAN, GRAM)
    inside = []
    for i, t in enumerate(texts):
        begin = t.index(shared)
        mine = which == i
        inside.append({int(x) for p, x in zip(at[mine], h[mine], strict=True) if begin <= p <= begin + SPAN - GRAM})
    assert set.intersection(*inside)
    assert np.all(at >= 0)


def test_a_repeated_anchor_without_a_shared_span(spark, monkeypatch):
    text = lambda seed, n: "".join(random.Random(seed).choices("abcdefgh", k=n))
    hashed = lambda g: int(s.rolling(np.array([ord(c) for c in g], np.uint32), GRAM)[0])
    gram = min((text(seed, GRAM) for seed in range(500)), key=hashed)
    found = []
    for seed in range(60):  # the gram is an anchor of both records, and no span around it is shared
        a, b = text(1000 + seed, 20) + gram + text(2000 + seed, 20), text(3000 + seed, 20) + gram + text(4000 + seed, 20)
        held = [set(s.anchors([t], SPAN, GRAM)[2].tolist()) for t in (a, b)]
        if held[0] & held[1]:
            found.append([(1, a), (2, b)])
    assert found
    for rows in found[:3]:
        assert expected(rows, SPAN) == {} and spans(spark, rows) == {}
    monkeypatch.setattr(s, "MANY", 1)
    assert spans(spark, found[0]) == {}


@pytest.mark.parametrize("docs", [300, 3000])
def test_few_anchors_that_stand_once_get_through_at_any_size(spark, monkeypatch, docs):
    monkeypatch.setattr(s, "LEAST", 1 << 16)
    rng = random.Random(docs)
    rows = [(i, i, "".join(rng.choices("abcdefghijklmnop \n", k=2000))) for i in range(docs)]
    texts = spark.createDataFrame(rows, "key bigint, record bigint, text string")
    counters = s.sketch_size(texts, SPAN, GRAM)
    total = s._places(texts, SPAN, GRAM).count()
    assert counters >= s.PER_ANCHOR * 0.9 * total
    assert s.repeated_places(texts, SPAN, GRAM, counters).count() < 0.02 * total


def test_each_row_of_the_sketch_tells_anchors_apart():
    rng = random.Random(10)
    h = np.unique(s.anchors(["".join(rng.choices("abcdefghijklmnop \n", k=400_000))], s.SPAN, s.GRAM)[2])
    counters = 1 << 17
    for row in range(s.ROWS):  # a counter is shared with about 5 % of the others, in either row
        assert len(np.unique(s._counter(h, row, counters))) > 0.93 * len(h) > 5000


def test_texts_of_one_key_keep_their_own_anchors(spark):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefgh", k=n))
    shared = [text(40) for _ in range(4)]
    rows = [(1, text(90) + shared[0]), (1, shared[1]), (1, text(200) + shared[2] + text(9)), (2, shared[0] + shared[2]), (3, text(30) + shared[1]), (3, "x" * 12 + shared[3])]
    found = s.shared_spans(spark.createDataFrame(rows, "doc_id bigint, text string"), SPAN, GRAM)
    assert {(r["doc_id"], r["stop"] - r["start"]) for r in found.collect()} >= {(1, 40), (2, 80), (3, 40)}
    assert {r["doc_id"] for r in found.collect()} == {1, 2, 3}

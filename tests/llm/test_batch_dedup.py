import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tagtrail.llm.batch_dedup import AcceptedIndex, point_key, sha_key, within
from tagtrail.plans.work import work_path
from pyspark.sql import functions as F

ROWS = "row_id bigint, batch_no int, point_id string, content_sha string, content string, rank int, cls string, key string"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=12), st.lists(st.integers(0, 3), max_size=12), st.integers(0, 6))
def test_bounded_distance(a, b, limit):
    assert within(a, b, limit) == (distance(a, b) <= limit)


def words(text):
    return re.findall(r"\w+", text.lower())


def loop(held, batch):
    points, shas, texts = {p for p, _, _ in held}, {s for _, s, _ in held}, [words(t) for _, _, t in held if t]
    found = set()
    for r in sorted(batch, key=lambda r: (r[1], r[0])):
        row, _, point, sha, text = r
        sha = sha or (hashlib.sha256(text.encode()).hexdigest() if text is not None else None)
        w = words(text) if text is not None else []
        near = w and any(abs(len(w) - len(t)) <= max(len(w), len(t)) // 10 and distance(w, t) <= max(len(w), len(t)) // 10 for t in texts)
        if (point is not None and point in points) or (sha is not None and sha in shas) or near:
            found.add(row)
        else:
            points.add(point), shas.add(sha)
            if w:
                texts.append(w)
    return found


def judged(spark, index, batch):
    df = spark.createDataFrame([(*r, 1, "c", "k") for r in batch], ROWS)
    return {r[0] for r in index.judge(df).collect()}


def loaded(spark, held):
    index = AcceptedIndex(spark, work_path(spark, "accepted"))
    df = spark.createDataFrame(held, "point_id string, content_sha string, content string")
    keys = df.select(F.explode(F.array(point_key(F.col("point_id")), sha_key(F.col("content_sha")))).alias("key"))
    index.load(keys, df)
    return index


def edited(rng, text, edits):
    out = text.split()
    for _ in range(edits):
        i = rng.randrange(len(out))
        kind = rng.randrange(3)
        out[i : i + 1] = [] if kind == 0 and len(out) > 1 else [f"n{rng.randrange(99)}"] if kind == 1 else [out[i], f"n{rng.randrange(99)}"]
    return " ".join(out)


def case(seed, n=70):
    rng = random.Random(seed)
    base = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.choice([1, 5, 8, 9, 10, 17, 18, 19, 35, 36, 54, 80, 130]))) for _ in range(14)]
    text = lambda: edited(rng, t := rng.choice(base), rng.choice([0, 0, len(t.split()) // 10, len(t.split()) // 10 + 1, len(t.split()) // 9]))
    held = [(f"p{i}", f"s{i}", text()) for i in range(10)] + [("p0", "s0", None)]
    batch = []
    for i in range(n):
        content = rng.choice([text(), text(), text(), None, "", "!!"])
        batch.append((i, rng.randrange(4), rng.choice([None, f"p{rng.randrange(99)}"]), rng.choice([None, f"s{rng.randrange(99)}"]), content))
    return held, batch


def test_against_a_loop(spark):
    for seed in (1,):
        held, batch = case(seed, 140)
        assert judged(spark, loaded(spark, held), batch) == loop(held, batch)


def test_later_deliveries_meet_what_was_accepted(spark):
    held, batch = case(3)
    index, want = loaded(spark, held), loop(held, batch)
    got = set()
    for number in range(4):
        part = [r for r in batch if r[1] == number]
        got |= judged(spark, index, part) if part else set()
    assert got == want


def test_empty_tables_and_a_delivery_sent_again(spark):
    index = loaded(spark, [])
    assert judged(spark, index, []) == set()
    batch = [(1, 1, "p", None, "a b c"), (2, 1, "q", None, "A, b C!"), (3, 2, "p", None, None), (4, 2, None, None, None), (5, 2, None, None, None)]
    assert judged(spark, index, batch) == {2, 3}
    assert judged(spark, index, [(r[0] + 10, *r[1:]) for r in batch]) == {11, 12, 13}


def test_a_third_repeats_one_key_and_a_phrase_stands_in_all(spark):
    rng = random.Random(4)
    phrase = "auto generated stub documentation has to be written later on"
    text = lambda: phrase + " " + " ".join(f"x{rng.randrange(9999)}" for _ in range(30))
    held = [(f"p{i}", f"s{i}", text()) for i in range(150)]
    batch = [(i, 1, "hot" if i % 3 == 0 else f"b{i}", None, text()) for i in range(300)]
    assert judged(spark, loaded(spark, held), batch) == {i for i in range(3, 300, 3)}


def test_parts_of_a_delivery_change_nothing(spark, monkeypatch):
    from tagtrail.llm import batch_dedup

    monkeypatch.setattr(batch_dedup, "FIRST", 16)
    monkeypatch.setattr(batch_dedup, "GROWTH", 2)
    monkeypatch.setattr(batch_dedup, "SMALL", 32)
    for seed in (5,):
        held, batch = case(seed, 120)
        assert judged(spark, loaded(spark, held), batch) == loop(held, batch)
    held, batch = case(7, 15)
    batch = [(r[0], None if r[1] == 0 else r[1], *r[2:]) for r in batch]  # a missing batch number comes first
    assert judged(spark, loaded(spark, held), batch) == loop(held, [(r[0], -1 if r[1] is None else r[1], *r[2:]) for r in batch])


def test_every_near_copy_is_a_candidate():
    """Of every choice of segments one is probed by each near copy, at any length and in any order of edits."""
    from tagtrail.llm.batch_dedup import _BASES, _NUMBERS, _WIDTHS, EVERY

    for base, above, number, width in zip(_BASES, _BASES[1:], _NUMBERS, _WIDTHS, strict=False):
        assert number * width <= base and number >= (above - 1) // (EVERY - 1) + 1


def test_segments_meet_their_near_copies(spark):
    from tagtrail.llm.batch_dedup import _text_columns, near_pairs, probes, ranked, segments

    rng = random.Random(11)
    rows, want = [], set()
    for i, n in enumerate([9, 10, 17, 18, 26, 27, 35, 36, 54, 71, 72, 100, 140, 350, 700]):
        a = " ".join(f"w{i}x{rng.randrange(40)}" for _ in range(n))
        for j in range(3):
            b = edited(rng, a, n // 10)
            rows.append((f"{i}a{j}", a if j else "!", b))
            if distance(words(a), words(b)) <= max(len(words(a)), len(words(b))) // 10 and words(a) != words(b) and len(words(b)) >= 9:
                want.add((" ".join(words(b)), " ".join(words(a))))
    names = {w: None for pair in want for w in pair}
    cut = lambda texts: _text_columns(spark.createDataFrame([(t, t) for t in texts], "name string, content string"))
    asked, held = cut({q for q, _ in want}), cut({c for _, c in want})
    every = segments(held)
    kept = ranked(every, every.groupBy("h").agg(F.count("*").alias("often"))).filter("kept")
    found = near_pairs(probes(asked.select("cls", "codes")), asked.select("cls", "codes"), kept, held.select("cls", "codes"))
    digest = {bytes(hashlib.md5(w.encode()).digest()): w for w in names}
    got = {(digest[bytes(r["q"])], digest[bytes(r["cls"])]) for r in found.collect()}
    assert want <= got and len(want) > 20


def test_an_append_that_was_cut_off_is_not_seen(spark, monkeypatch):
    held, batch = case(8, 12)
    index = loaded(spark, held)
    before = index.published()
    mark = AcceptedIndex._mark
    monkeypatch.setattr(AcceptedIndex, "_mark", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
    try:
        judged(spark, index, batch)
    except RuntimeError:
        pass
    monkeypatch.setattr(AcceptedIndex, "_mark", mark)
    again = AcceptedIndex(spark, index.path)
    assert again.published() == before and judged(spark, again, batch) == loop(held, batch)


def test_the_history_is_not_shuffled(spark):
    held, batch = case(9, 20)
    index = loaded(spark, held)
    asked = spark.createDataFrame([(bytes(16),)], "key binary")
    from tagtrail.llm.batch_dedup import _hashed

    for small in (True, False):
        plan = index._table("keys").join(_hashed(asked, small), "key")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and ("ShuffledHashJoin" in plan) == small


def test_the_history_is_scanned_once_a_call(spark, monkeypatch):
    from tagtrail.llm import batch_dedup

    monkeypatch.setattr(batch_dedup, "FIRST", 16)
    held, batch = case(12, 60)
    index, asked, kept = loaded(spark, held), [], AcceptedIndex._table

    def table(self, kind, *appends):
        asked.append((kind, appends[0] if appends else self.published()))
        return kept(self, kind, *appends)

    monkeypatch.setattr(AcceptedIndex, "_table", table)
    assert judged(spark, index, batch) == loop(held, batch) and len(index.published()) > 2
    assert [sum(k == kind and 1 in appends for k, appends in asked) for kind in ("keys", "segments", "texts")] == [1, 1, 1]


def test_a_sieve_lets_through_what_was_put_in_and_little_else(spark, monkeypatch):
    import numpy as np
    from tagtrail.llm import batch_dedup

    monkeypatch.setattr(batch_dedup, "SIEVE_BLOCK", 1 << 16)
    rng = np.random.default_rng(13)
    put, others = (rng.integers(-(1 << 63), 1 << 63, n) for n in (30_000, 200_000))
    hashes = spark.createDataFrame([(int(h),) for h in put], "h bigint").repartition(3)
    packed = batch_dedup.sieve(hashes, batch_dedup.sieve_blocks(len(put)))
    assert len(packed) >= 8 and batch_dedup._passes(put, packed).all() and batch_dedup._passes(others, packed).mean() < 0.02
    assert not batch_dedup._passes(put, np.zeros_like(packed)).any()

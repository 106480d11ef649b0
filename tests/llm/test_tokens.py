import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tagtrail.llm import tokens
from tagtrail.llm.pretokens import starts

VOCABULARY = f"{tokens.VOCABULARIES}/byte_bpe_50k.tiktoken"
pytestmark = pytest.mark.skipif(not os.path.exists(VOCABULARY), reason="no vocabulary here")
CORNERS = [
    "", " ", "\n\n  x", "it's we're I'll 's 'stop ''s x'S", "don't'tre", "a  b\t\tc \n d ", "ß€ 　x 𝒳٣", "<|endoftext|>",
    "tail   ", "\r\n", "x" * 3000, "12345 abc_def!!! ...?", "'", "''", " '", "'r", "'re", "\x85y", "é́", "\x00\x01",
]


@pytest.fixture(scope="module")
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    return lambda texts: [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def encoder():
    with open(VOCABULARY, "rb") as file:
        return tokens._Encoder(file.read())


def encoded(encoder, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    ids, sizes = encoder.encode(np.frombuffer(b"".join(raw), np.uint8), offsets)
    return [p.tolist() for p in np.split(ids, np.cumsum(sizes)[:-1])]


def test_equals_the_library(encoder, reference):
    rng = random.Random(2)
    parts = "ab  \n\t'stmdrevl12.,!äß€  　𝒳٣\r"
    texts = CORNERS + ["".join(rng.choices(parts, k=rng.randrange(50))) for _ in range(3000)]
    assert encoded(encoder, texts) == reference(texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=30), min_size=1, max_size=4))
def test_texts_do_not_influence_each_other(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    alone = [starts(np.frombuffer(t.encode(), np.uint8), np.array([0])).tolist() if t else [] for t in texts]
    raw = [t.encode() for t in texts]
    begin = np.cumsum([0] + [len(r) for r in raw])[:-1]
    joined = starts(np.frombuffer(b"".join(raw), np.uint8), np.array([b for b, r in zip(begin, raw, strict=True) if r], np.int64))
    assert joined.tolist() == [int(b) + s for b, a in zip(begin, alone, strict=True) for s in a]


def test_a_full_cache_changes_nothing(encoder, reference, monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    assert [encoded(encoder, [t])[0] for t in CORNERS] == reference(CORNERS)


def test_column_round_trip_offsets_and_empty_cases(spark, reference):
    ranks = tokens.vocabulary(spark)
    rows = [(i, t, "extra") for i, t in enumerate(CORNERS)] + [(100, None, "extra"), (101, CORNERS[3], None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r for r in tokens.encode(docs, ranks, offsets=True).collect()}
    want = reference(CORNERS)
    assert [list(got[i]["ids"]) for i in range(len(CORNERS))] == want
    assert got[100]["ids"] == [] and got[101]["ids"] == got[3]["ids"]
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs, ranks), ranks).collect()}
    assert [back[i] for i in range(len(CORNERS))] == CORNERS and back[100] == ""
    placed = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(docs, ranks, offsets=True), ranks, offsets="offsets").collect()}
    assert placed == back
    late = spark.createDataFrame([(1, want[1][:1], [2]), (2, None, None)], "doc_id bigint, ids array<int>, offsets array<int>")
    assert {r["doc_id"]: (r["text"] or "")[:2] for r in tokens.decode(late, ranks, offsets="offsets").collect()} == {1: "\0\0" if want[1] else "", 2: ""}
    for i, text in enumerate(CORNERS):
        offsets = list(got[i]["offsets"])
        assert len(offsets) == len(want[i]) and offsets == sorted(offsets) and offsets[:1] == ([0] if text else [])
    sizes = {r["doc_id"]: r["tokens"] for r in tokens.count_tokens(docs, ranks, ["doc_id"]).collect()}
    assert [sizes[i] for i in range(len(CORNERS))] == [len(w) for w in want]
    assert tokens.encode(docs.limit(0), ranks).count() == 0


def test_long_texts_between_short_ones(spark, reference, monkeypatch):
    monkeypatch.setattr(tokens, "STRETCH", 64)
    texts = ["a b", "word " * 5000, "", "c", "é" * 999]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    got = {r[0]: list(r[1]) for r in tokens.encode(docs, tokens.vocabulary(spark)).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)

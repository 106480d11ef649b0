"""Encoding of a corpus with a public byte-level BPE vocabulary.

Boundaries of pre-tokens come from :mod:`tagtrail.llm.pretokens`; each slice between two of them
is merged pair by pair once and then taken from a bounded cache. Spark splits the corpus and
hands it over in Arrow batches; a task needs memory for one batch and its cache.

Defined results
    * a null text and an empty text both give the empty list;
    * special tokens' strings in a text are ordinary text, and none are added;
    * white space, control characters and any Unicode are encoded as they are, byte for byte, so
      decoding gives the text back;
    * texts are encoded whole; repeated rows give repeated rows; columns not asked for are dropped.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.llm.pretokens import starts

#: Where the vocabularies of public tokenizers lie.
VOCABULARIES = "/opt/tokenizers"
#: Bytes of text handled at once, and slices a task remembers.
STRETCH, REMEMBERED = 1 << 20, 300_000


class _Encoder:
    """Slices to ids; knows merged slices by their bytes."""

    def __init__(self, vocabulary: bytes):
        self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
        self.width = np.zeros(max(self.ranks.values()) + 1, np.int64)
        for token, i in self.ranks.items():
            self.width[i] = len(token)
        self.forget()

    def forget(self) -> None:
        encoder = self

        class Seen(dict):
            def __missing__(self, piece: bytes) -> int:
                ids = encoder.merge(piece)
                self[piece] = at = len(encoder.size)
                encoder.begin.append(len(encoder.flat))
                encoder.size.append(len(ids))
                encoder.flat.extend(ids)
                return at

        self.seen, self.flat, self.begin, self.size = Seen(), array("i"), array("q"), array("q")

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one slice: the neighbours whose union has the lowest rank are joined, leftmost first, until none has one."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        n = len(piece)
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop or not alive[j]:
                continue  # one of the two has been joined since
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := ranks.get(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts laid end to end, and how many each text has."""
        first = offsets[:-1][np.diff(offsets) > 0]
        at = starts(data, first)
        if not len(at):
            return np.empty(0, np.int32), np.zeros(len(offsets) - 1, np.int64)
        if len(self.size) > REMEMBERED:
            self.forget()
        raw, edges, seen = data.tobytes(), [*at.tolist(), len(data)], self.seen
        which = np.array([seen[raw[a:b]] for a, b in zip(edges, edges[1:], strict=False)], np.int64)
        size = np.array(self.size)[which]
        ends = np.cumsum(size)
        where = np.repeat(np.array(self.begin)[which] - ends + size, size)
        where += np.arange(ends[-1])
        upto = np.concatenate([[0], ends])[np.searchsorted(at, offsets)]
        return np.array(self.flat, np.int32)[where], np.diff(upto)


_ENCODERS: dict[bytes, _Encoder] = {}


def _encoder(vocabulary: bytes) -> _Encoder:
    key = vocabulary[:64] + vocabulary[-64:] + str(len(vocabulary)).encode()
    if key not in _ENCODERS:
        _ENCODERS[key] = _Encoder(vocabulary)
    return _ENCODERS[key]


def _stretches(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Bytes and offsets of a string column, some whole texts at a time."""
    column = pa.concat_arrays([column.fill_null("")]).cast(pa.large_string())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(i + 1, int(np.searchsorted(ends, ends[i] + STRETCH, "right")) - 1)
        yield raw[ends[i] : ends[j]], ends[i : j + 1] - ends[i]
        i = j


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k", folder: str = VOCABULARIES) -> Broadcast:
    """The rank file of a public tokenizer, sent to the executors; under 1 MB whatever the corpus."""
    with open(f"{folder}/{name}.tiktoken", "rb") as file:
        return spark.sparkContext.broadcast(file.read())


def encode(docs: DataFrame, ranks: Broadcast, key: str = "doc_id", text: str = "text", offsets: bool = False) -> DataFrame:
    """(key, ids) of each row; with ``offsets`` also the byte at which each token begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            parts = [encoder.encode(*x) for x in _stretches(batch.column(1))]
            if not parts:
                continue
            ids = np.concatenate([p[0] for p in parts])
            ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))]).astype(np.int32)
            columns = [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(ids, pa.int32()))]
            if offsets:
                width = encoder.width[ids]
                begin = np.cumsum(width) - width
                base = np.repeat(np.append(begin, 0)[np.minimum(ends[:-1], len(begin))], np.diff(ends))
                columns.append(pa.ListArray.from_arrays(pa.array(ends), pa.array((begin - base).astype(np.int32))))
            yield pa.RecordBatch.from_arrays(columns, names=["k", "ids", "offsets"][: len(columns)])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"k {kind}, ids array<int>" + (", offsets array<int>" if offsets else "")
    return docs.select(key, text).mapInArrow(run, schema).withColumnRenamed("k", key)


def count_tokens(docs: DataFrame, ranks: Broadcast, keep: list[str], text: str = "text") -> DataFrame:
    """The columns ``keep`` and ``tokens``, the number of ids of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        for batch in batches:
            sizes = [encoder.encode(*x)[1] for x in _stretches(batch.column(batch.num_columns - 1))]
            tokens = pa.array(np.concatenate(sizes) if sizes else np.empty(0, np.int64), pa.int64())
            columns = [*batch.columns[:-1], tokens]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "tokens"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, text).mapInArrow(run, f"{kinds}, tokens bigint")


def decode(encoded: DataFrame, ranks: Broadcast, key: str = "doc_id", ids: str = "ids", offsets: str | None = None) -> DataFrame:
    """(key, text) from ids; a null list gives null, ids that no vocabulary entry has are an error.

    With ``offsets``, a column, each token is written at its own byte instead of behind the one
    before; bytes that no token covers are zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(ranks.value)
        by_id = sorted((i, t) for t, i in encoder.ranks.items())
        known = np.zeros(by_id[-1][0] + 1, bool)
        known[[i for i, _ in by_id]] = True
        width = np.zeros(len(known), np.int64)
        width[known] = [len(t) for _, t in by_id]
        begin, entries = np.cumsum(width) - width, np.frombuffer(b"".join(t for _, t in by_id), np.uint8)

        def text(row: np.ndarray, at: np.ndarray | None) -> str:
            if not len(row):
                return ""
            if row.min() < 0 or row.max() >= len(known) or not known[row].all():
                raise KeyError("an id that the vocabulary lacks")
            size = width[row]
            behind = np.cumsum(size) - size
            each = np.arange(behind[-1] + size[-1]) - np.repeat(behind, size)  # the byte's place in its token
            parts = entries[np.repeat(begin[row], size) + each]
            if at is not None:
                out = np.zeros((at + size).max(), np.uint8)
                out[np.repeat(at, size) + each] = parts
                parts = out
            return parts.tobytes().decode("utf-8", "replace")

        def lists(column: pa.Array) -> list[np.ndarray]:
            ends = column.offsets.to_numpy()
            flat = column.values.to_numpy(zero_copy_only=False).astype(np.int64)
            return [flat[a:b] for a, b in zip(ends, ends[1:], strict=False)]

        for batch in batches:
            rows = lists(batch.column(1))
            places = lists(batch.column(2)) if offsets else [None] * len(rows)
            given = batch.column(1).is_valid().to_pylist()
            texts = [text(*x) if is_list else None for is_list, *x in zip(given, rows, places, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["k", "text"])

    kind = encoded.schema[key].dataType.simpleString()
    columns = [F.col(c) for c in (key, ids, offsets) if c]
    return encoded.select(*columns).mapInArrow(run, f"k {kind}, text string").withColumnRenamed("k", key)

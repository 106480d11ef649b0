"""Long exact spans shared between records.

A span of ``SPAN`` characters that stands in two records holds the same anchor in both: of each
run of ``SPAN - GRAM + 1`` consecutive grams of ``GRAM`` characters, the one with the least hash
(the rightmost of equals). So only anchors, about one in 61 positions, have to be counted.

1. *Count-min prefilter.* Every task sketches how many records hold each of its anchors
   (saturating at 2); the partial sketches are merged block by block by a shuffle. The sketch has
   ``PER_ANCHOR`` counters a row for every anchor the corpus is expected to hold, so the share of
   unrepeated anchors that get through stays under 1 % at every size. It never lies in one place:
   of each merged block only the counters that count two or more are kept, as rows.
2. *Test.* Anchors are taken from the records again, as (key, place, hash), and semi-joined on
   their counter of each row. A sketch never counts too low, so an anchor that is dropped stands in
   one record. Only records that keep an anchor are then joined to their text, by key; what another
   text of the same key holds is left out there.
3. *Exact pass.* The characters around a kept anchor that a span through it can reach are its
   surroundings. Equal surroundings are one class, with its least and greatest record. Within an
   anchor's classes every window of ``SPAN`` characters is compared by a 64-bit hash; it is shared
   if its records differ. No pairs are formed: work is linear in the classes. An anchor with very
   many classes is compared by a shuffle of its windows instead of in one task, with the same result.
4. Shared windows are joined to the records that hold their class, and merged into spans.

Defined results
    * null and short texts share nothing; rows of one key count as one record, so repeated rows
      and repetitions inside a record are no case; a null key is ignored;
    * case, line ends and white space count; positions are code points; texts are taken whole;
    * an empty table gives no rows; other columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.plans.work import materialise

#: Characters of a span, and of a gram.
SPAN, GRAM = 240, 120
#: Counters of each row of the sketch for an expected anchor, least of them, rows, and counters of a block.
PER_ANCHOR, LEAST, ROWS, BLOCK = 16, 1 << 20, 2, 1 << 16
#: Characters hashed at once; classes of one anchor above which its windows are shuffled.
STRETCH, MANY = 1 << 20, 4096

_BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_powers: list[np.ndarray] = [np.empty(0, np.uint64), np.empty(0, np.uint64)]


def _mixed(h: np.ndarray, by: int = _MIX[0]) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(by)
    return h ^ (h >> np.uint64(29))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[i] = np.multiply.accumulate(p)
    return _powers[0], _powers[1]


def rolling(codes: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of every ``size`` consecutive codes, along the last axis."""
    n = codes.shape[-1]
    if n < size:
        return np.empty((*codes.shape[:-1], 0), np.uint64)
    power, inverse = _power(n + 1)
    total = np.zeros((*codes.shape[:-1], n + 1), np.uint64)
    np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], axis=-1, out=total[..., 1:])
    h = total[..., size:] - total[..., : n + 1 - size]
    h *= inverse[: n + 1 - size]
    return _mixed(h)


def anchors(texts: list[str], span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, position in it, hash) of every anchor; texts are at least ``span`` long."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    length = np.fromiter(map(len, texts), np.int64, len(texts))
    begin = np.cumsum(length) - length
    hashes = rolling(codes, gram)
    place = np.arange(len(hashes), dtype=np.uint64)
    low = np.uint64(0xFFFFFFFF)
    least = (hashes & ~low) | (low - place)
    width, have = span - gram + 1, 1
    while have < width:  # the least of `have` neighbours becomes that of up to twice as many
        step = min(have, width - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    inside = np.ones(len(least), bool)  # windows that lie in one text
    for end in (begin + length)[:-1]:
        inside[max(0, end - span + 1) : end] = False
    at = np.unique((low - (least[inside] & low)).astype(np.int64))
    which = np.searchsorted(begin, at, "right") - 1
    return which, at - begin[which], _mixed(hashes[at], _MIX[1])  # minima have like upper bits, which counters are taken from


def _groups(texts: list[str]) -> Iterator[tuple[int, list[str]]]:
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= STRETCH):
            size += len(texts[j])
            j += 1
        yield i, texts[i:j]
        i = j


def sketch_size(texts: DataFrame, span: int, gram: int) -> int:
    """Counters of a row of the sketch, a power of two: ``PER_ANCHOR`` for every expected anchor."""
    chars = texts.agg(F.sum(F.char_length("text").cast("bigint"))).first()[0] or 0  # one number
    expected = 2 * chars / (span - gram + 2)  # the density of minima of a window
    return max(LEAST, 1 << int(np.ceil(np.log2(max(1.0, PER_ANCHOR * expected)))))


def _counter(h: np.ndarray, row: int, counters: int) -> np.ndarray:
    """The counter of each hash in a row of the sketch: its upper bits, or its lower."""
    if row:
        return (h & np.uint64(counters - 1)).astype(np.int64)
    return (h >> np.uint64(64 - (counters.bit_length() - 1))).astype(np.int64)


def _counter_column(h: str, row: int, counters: int) -> Column:
    """As :func:`_counter`, of a column of hashes."""
    return F.col(h).bitwiseAND(F.lit(counters - 1)) if row else F.shiftrightunsigned(h, 64 - (counters.bit_length() - 1))


def repeated_counters(texts: DataFrame, span: int, gram: int, counters: int) -> DataFrame:
    """(row, counter) of the counters of the merged sketch that count two records or more."""
    per_row = counters // BLOCK

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        for batch in batches:
            for _, part in _groups(batch.column(batch.schema.names.index("text")).to_pylist()):
                which, _, h = anchors(part, span, gram)
                order = np.lexsort((h, which))
                which, h = which[order], h[order]
                first = np.ones(len(h), bool)
                first[1:] = (which[1:] != which[:-1]) | (h[1:] != h[:-1])
                found.append(h[first])  # once a record
        h = np.concatenate(found) if found else np.empty(0, np.uint64)
        for row in range(ROWS):
            counter, count = np.unique(_counter(h, row, counters), return_counts=True)
            if not len(counter):
                continue
            block = counter // BLOCK
            edges = np.flatnonzero(np.diff(block, prepend=-1))
            low = (counter % BLOCK).astype(np.uint16)
            once = [x.tobytes() for x in np.split(low, edges[1:])]
            twice = [x[y].tobytes() for x, y in zip(np.split(low, edges[1:]), np.split(count > 1, edges[1:]), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(block[edges] + row * per_row, pa.int64()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())],
                names=["block", "once", "twice"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, once, twice = None, np.zeros(BLOCK, bool), np.zeros(BLOCK, bool)

        def out() -> pa.RecordBatch:
            counter = np.flatnonzero(twice) + number % per_row * BLOCK
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(counter), number // per_row, np.int32)), pa.array(counter.astype(np.int64))], names=["row", "counter"]
            )

        for batch in batches:
            for block, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block != number:
                    if number is not None:
                        yield out()
                    number = block
                    once[:], twice[:] = False, False
                seen = np.frombuffer(a, np.uint16)
                twice[seen[once[seen]]] = True
                once[seen] = True
                twice[np.frombuffer(b, np.uint16)] = True
        if number is not None:
            yield out()

    partial = texts.mapInArrow(sketch, "block bigint, once binary, twice binary")
    return partial.repartition("block").sortWithinPartitions("block").mapInArrow(merge, "row int, counter bigint")


def _places(texts: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, at, anchor) of every anchor of texts (key, text)."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(batch.schema.names.index("key"))
            for base, part in _groups(batch.column(batch.schema.names.index("text")).to_pylist()):
                which, at, h = anchors(part, span, gram)
                number = pa.array(which + base)
                yield pa.RecordBatch.from_arrays(
                    [keys.take(number), pa.array(at.astype(np.int32)), pa.array(h.view(np.int64))], names=["key", "at", "anchor"]
                )

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(take, f"key {kind}, at int, anchor bigint")


def repeated_places(texts: DataFrame, span: int, gram: int, counters: int) -> DataFrame:
    """The anchors (key, at, anchor) of texts (key, text) that the sketch estimates repeated."""
    repeated = materialise(repeated_counters(texts.select("text"), span, gram, counters), "shared-counters", "row")
    kept = _places(texts, span, gram)
    for row in range(ROWS):
        of_row = repeated.filter(F.col("row") == row).select("counter")
        kept = kept.join(of_row, _counter_column("anchor", row, counters) == F.col("counter"), "left_semi")
    return kept


def _own(text: str, marks: list[dict], gram: int) -> list[dict]:
    """The marks of a key that are of this text: rows of one key may have different texts."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    marks = [m for m in marks if m["at"] + gram <= len(codes)]
    at, anchor = (np.array([m[c] for m in marks], np.int64) for c in ("at", "anchor"))
    h = _mixed(rolling(codes[at[:, None] + np.arange(gram)], gram)[:, 0], _MIX[1])
    return [marks[i] for i in np.flatnonzero(h.view(np.int64) == anchor)]


def _surroundings(kept: DataFrame, span: int, gram: int) -> DataFrame:
    """(key, anchor, before, around, places) from (key, text, kept array of place and anchor), once for each surroundings of a text."""

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reach = span - gram
        for batch in batches:
            keys, texts, places_of = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            number, anchor, before, around, places = [], [], [], [], []
            for i, (text, marks) in enumerate(zip(texts, places_of, strict=True)):
                seen: dict[tuple, list[int]] = {}
                for mark in _own(text, marks, gram):
                    p, left = mark["at"], min(mark["at"], reach)
                    seen.setdefault((mark["anchor"], left, text[p - left : p + span]), []).append(p)
                for (g, left, near), where in seen.items():
                    number.append(i)
                    anchor.append(g)
                    before.append(left)
                    around.append(near)
                    places.append(where)
            yield pa.RecordBatch.from_arrays(
                [keys.take(pa.array(number, pa.int64())), pa.array(anchor, pa.int64()), pa.array(before, pa.int32()),
                 pa.array(around, pa.string()), pa.array(places, pa.list_(pa.int32()))],
                names=["key", "anchor", "before", "around", "places"],
            )

    kind = kept.schema["key"].dataType.simpleString()
    return kept.mapInArrow(take, f"key {kind}, anchor bigint, before int, around string, places array<int>")


def _windows(rows: pd.DataFrame, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the windows of every class's surroundings, and which of them exist."""
    length = rows["around"].str.len().to_numpy(np.int64)
    wide = int(length.max())
    codes = np.zeros((len(rows), wide), np.uint32)
    flat = np.frombuffer("".join(rows["around"]).encode("utf-32-le", "surrogatepass"), np.uint32)
    codes[np.arange(wide) < length[:, None]] = flat
    h = rolling(codes, span)
    return h, np.arange(h.shape[1]) <= (length - span)[:, None]


def _runs(flags: np.ndarray, before: np.ndarray) -> tuple[list[list[int]], list[list[int]]]:
    """First and last window of each run of flags, counted from the anchor."""
    edge = np.diff(flags.astype(np.int8), axis=1, prepend=0, append=0)
    out = []
    for step, less in ((1, 0), (-1, 1)):
        row, at = np.nonzero(edge == step)
        at = at - less - before[row]
        out.append([x.tolist() for x in np.split(at, np.searchsorted(row, np.arange(1, len(flags))))])
    return out[0], out[1]


_RUNS = "anchor bigint, c1 bigint, c2 bigint, first array<int>, last array<int>"


def _compare(span: int):
    """Runs of shared windows of classes sorted by anchor; an anchor's classes are in one task."""

    def done(rows: pd.DataFrame) -> pd.DataFrame:
        h, there = _windows(rows, span)
        flat = h[there]
        low = np.broadcast_to(rows["low"].to_numpy()[:, None], h.shape)[there]
        high = np.broadcast_to(rows["high"].to_numpy()[:, None], h.shape)[there]
        order = np.argsort(flat, kind="stable")
        flags = np.zeros(h.shape, bool)
        if len(order):
            edges = np.flatnonzero(np.concatenate([[True], flat[order][1:] != flat[order][:-1]]))
            differ = np.minimum.reduceat(low[order], edges) != np.maximum.reduceat(high[order], edges)
            shared = np.empty(len(order), bool)
            shared[order] = np.repeat(differ, np.diff(np.append(edges, len(order))))
            flags[there] = shared
        keep = flags.any(axis=1)
        if not keep.any():
            return pd.DataFrame({c: pd.Series(dtype=t) for c, t in (("anchor", "int64"), ("c1", "int64"), ("c2", "int64"), ("first", object), ("last", object))})
        first, last = _runs(flags[keep], rows["before"].to_numpy(np.int64)[keep])
        return rows.loc[keep, ["anchor", "c1", "c2"]].assign(first=first, last=last)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        left: pd.DataFrame | None = None
        for batch in batches:
            rows = batch if left is None else pd.concat([left, batch], ignore_index=True)
            rows = rows.reset_index(drop=True)
            start = 0
            anchor = rows["anchor"].to_numpy()
            changes = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1
            while len(changes) and (ready := changes[changes <= start + 2 * MANY])[-1:].size and ready[-1] > start:
                yield done(rows.iloc[start : ready[-1]].reset_index(drop=True))
                start = int(ready[-1])
            left = rows.iloc[start:]
        if left is not None and len(left):
            yield done(left.reset_index(drop=True))

    return run


def _by_shuffle(classes: DataFrame, span: int) -> DataFrame:
    """As :func:`_compare`, for anchors with many classes: windows are compared by a shuffle with partial aggregates."""

    def explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i in range(0, len(batch), MANY):
                rows = batch.iloc[i : i + MANY].reset_index(drop=True)
                h, there = _windows(rows, span)
                row, at = np.nonzero(there)
                out = rows.loc[row, ["anchor", "c1", "c2", "low", "high"]].reset_index(drop=True)
                yield out.assign(at=at - rows["before"].to_numpy(np.int64)[row], h=h[there].view(np.int64))

    kind = classes.schema["low"].dataType.simpleString()
    windows = materialise(
        classes.select("anchor", "c1", "c2", "before", "around", "low", "high").mapInPandas(
            explode, f"anchor bigint, c1 bigint, c2 bigint, low {kind}, high {kind}, at int, h bigint"
        ),
        "shared-windows",
    )
    shared = windows.groupBy("h").agg(F.min("low").alias("a"), F.max("high").alias("b")).filter("a <> b").select("h")
    hit = windows.join(shared, "h").select("anchor", "c1", "c2", "at").distinct()
    by_place = Window.partitionBy("anchor", "c1", "c2").orderBy("at")
    run = (F.col("at") - F.row_number().over(by_place)).alias("run")
    return (
        hit.select("*", run).groupBy("anchor", "c1", "c2", "run").agg(F.min("at").alias("f"), F.max("at").alias("l"))
        .groupBy("anchor", "c1", "c2").agg(F.collect_list("f").alias("first"), F.collect_list("l").alias("last"))
    )


def shared_spans(
    docs: DataFrame, span: int = SPAN, gram: int = GRAM, key: str = "doc_id", text: str = "text", counters: int | None = None
) -> DataFrame:
    """(key, start, stop): maximal stretches of a record made of spans that stand in another record too.

    ``counters`` of a row of the sketch, a power of two; by default they follow from the corpus.
    """
    given = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(
        F.col("key").isNotNull() & (F.char_length("text") >= span)
    )
    kept = repeated_places(given, span, gram, counters or sketch_size(given, span, gram))
    marks = kept.groupBy("key").agg(F.collect_set(F.struct("at", "anchor")).alias("kept"))
    found = _surroundings(given.join(marks, "key").select("key", "text", "kept"), span, gram).withColumns(
        {"c1": F.xxhash64("around", "before"), "c2": F.xxhash64(F.lit(span), "before", "around")}
    )
    found = materialise(found, "shared-anchors")
    ends = [F.min("key").alias("low"), F.max("key").alias("high")]
    repeated = found.groupBy("anchor", "c1", "c2").agg(*ends).groupBy("anchor").agg(
        F.count("*").alias("n"), F.min("low").alias("a"), F.max("high").alias("b")
    )
    repeated = materialise(repeated.filter("a <> b").select("anchor", "n"), "shared-repeated")  # counted without the text
    classes = found.groupBy("anchor", "c1", "c2", "before", "around").agg(*ends).join(repeated, "anchor")
    few = classes.filter(F.col("n") <= MANY).drop("n").repartition("anchor").sortWithinPartitions("anchor")
    runs = few.mapInPandas(_compare(span), _RUNS)
    if not repeated.filter(F.col("n") > MANY).isEmpty():
        runs = runs.unionByName(_by_shuffle(classes.filter(F.col("n") > MANY), span))
    hits = found.select("key", "anchor", "c1", "c2", "places").join(runs, ["anchor", "c1", "c2"])
    stretches = (
        hits.select("key", F.explode("places").alias("at"), "first", "last")
        .select("key", "at", F.explode(F.arrays_zip("first", "last")).alias("run"))
        .select("key", (F.col("at") + F.col("run.first")).alias("start"), (F.col("at") + F.col("run.last") + span).alias("stop"))
    )
    in_order = Window.partitionBy("key").orderBy("start", "stop")
    so_far = F.max("stop").over(in_order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.coalesce(F.col("start") > so_far, F.lit(True)).cast("int")
    return (
        stretches.distinct().withColumn("opens", opens)
        .withColumn("number", F.sum("opens").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy("key", "number").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .select(F.col("key").alias(key), "start", "stop")
    )


def coverage(docs: DataFrame, spans: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_chars, shared_chars) of every record."""
    shared = spans.groupBy(key).agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    chars = F.coalesce(F.char_length(text), F.lit(0)).cast("bigint")
    return docs.select(key, chars.alias("n_chars")).join(shared, key, "left").fillna(0, ["shared_chars"])

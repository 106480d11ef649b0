"""New batches checked for repetition against everything accepted before.

The store holds an index of what was accepted: keys (hashes of identifiers, checksums and word
sequences), texts as word hashes, and *segments* for edit distance. Texts fall into classes of
lengths; each class has a fixed number of segments of a fixed width, at fixed places: the first
half counted from the text's begin, the others from its end. A near copy of a text of n words
differs from it by at most ``n // (EVERY - 1)`` edits, and each edit spoils one segment, so of any
choice of one segment more than that, one stands unedited in every near copy; and the i-th of a
half with at most i edits on its side, so at most i words from its own place. The store keeps that
many, the rarest ones of the store as a whole (its counts are kept), so phrases that a great share
of all texts repeat don't make candidates. A segment's hash takes in its class and number.

A new text probes the classes its near copies can have, and of each number only the word runs
within the window of places where that segment can stand. Bounds on place and length and a parity
sketch of the words (each edit changes at most two of its bits) select the pairs worth verifying,
and a bounded edit distance decides. Segments of very long texts are numbered in groups, so probes
stay in proportion to the words.

The store's tables are bucketed by the hash they are looked up by, so a delivery is shuffled to
the buckets and hashed there, and the history is scanned where it lies: it is neither shuffled nor
sorted. All that a delivery appends is published by one marker file; a delivery that was cut off is
not seen, and what it left is overwritten when it is sent again.

A *sieve* goes to the tasks that cut probes: a Bloom filter, bounded in size, of the segments that
can be met. Nearly all probes meet none and end there; a full sieve lets more through and loses none.

Rows are judged by delivery, and within one in order; only what an *accepted* earlier row holds
counts. What the store holds at the begin of a call doesn't depend on what is accepted in it, so all
its deliveries are held against that at once, and the history is scanned once a call. What is left is
judged in order, in parts of growing size, and meets only what the parts before it appended. So of a
great many near copies only those of the part in which the first of them stands are linked with each
other. Within a part, links are found at the level of distinct word sequences;
then rounds decide every row that has no undecided earlier link, until none is left. The number
of rounds is the longest chain of links, not the number of rows.

Defined results
    * a missing content_sha follows from the content; a row without content is judged by its
      identifier and checksum alone; a row with none of the three is never found and repeats nothing;
    * texts of fewer than ``EVERY`` words are near copies only of equal word sequences; a text
      without words is like no other text;
    * deliveries sent again, ties and repeated rows: the first row in order is judged on its own;
    * an empty delivery or history is no error; other columns, of whatever name, are dropped.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import Row

from tagtrail.llm.shared_spans import _MIX, _mixed, rolling
from tagtrail.operators.greedy import first_accepted
from tagtrail.plans.work import materialise

#: One edit is allowed for so many words of the longer text.
EVERY = 10
#: Rows of a call's first part, how much larger each next part is, and most rows of a part that is hashed in memory.
FIRST, GROWTH, SMALL = 16384, 16, 1 << 18
#: Fewest buckets of the store, and keys of a bucket when it is laid out.
BUCKETS, PER_BUCKET = 8, 1 << 20
#: Segments of a class that are numbered one by one; words cut at once.
NUMBERED, WORDS = 32, 1 << 17
#: Bits of a sieve for an expected hash, most bits, and bits of a block, a power of two (at most 1 << 20).
PER_HASH, SIEVE, SIEVE_BLOCK = 16, 1 << 28, 1 << 20


def _bases() -> list[int]:
    """The least length of each class: steps of nine words, then of about a quarter."""
    out = [9]
    while out[-1] < 1 << 30:
        out.append(out[-1] + 9 if out[-1] < 54 else -(-out[-1] * 5 // 36) * 9)
    return out


_BASES = _bases()
_WIDTHS = [4 if b < 36 else 5 for b in _BASES]
_NUMBERS = [b // w for b, w in zip(_BASES, _WIDTHS, strict=True)]


def words(content: Column | str) -> Column:
    """The word sequence of a text: lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(content), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def _text_columns(rows: DataFrame) -> DataFrame:
    """Adds ``cls`` (digest of the word sequence, null without words) and ``codes`` (its word hashes)."""
    cut = rows.withColumn("_w", words("content"))
    return cut.withColumns({
        "cls": F.when(F.size("_w") > 0, F.unhex(F.md5(F.array_join("_w", " ")))),
        "codes": F.transform("_w", lambda w: F.xxhash64(w)),
    }).drop("_w", "content")


def _edits(n: Column) -> Column:
    """Most edits between a text of n words and a near copy of any length."""
    return F.floor(n / (EVERY - 1)).cast("int")


class _Texts:
    """The texts of a batch (cls, codes) as arrays: their lengths, where each begins, its parity sketch, and run hashes by width."""

    def __init__(self, batch: pa.RecordBatch):
        self.cls, codes = batch.column(0), batch.column(1)
        self.flat = codes.flatten().to_numpy().view(np.uint64)
        self.n = codes.value_lengths().to_numpy().astype(np.int64)
        self.begin = np.cumsum(self.n) - self.n
        bit = np.uint64(1) << (self.flat & np.uint64(63))
        self.sketch = [  # each word flips one bit of one half
            np.bitwise_xor.reduceat(np.where((self.flat >> np.uint64(6)) & np.uint64(1) == half, bit, np.uint64(0)), self.begin).view(np.int64)
            for half in (0, 1)
        ]
        self.runs = {w: rolling(self.flat, w) for w in set(_WIDTHS)}

    def hashed(self, width: np.ndarray, at: np.ndarray, of_class: np.ndarray, number: np.ndarray) -> np.ndarray:
        """Hashes of the runs that begin at places of ``flat``, with their class and the number they are looked up by."""
        h = np.empty(len(at), np.uint64)
        for w, runs in self.runs.items():
            mine = width == w
            h[mine] = runs[at[mine]]
        return _mixed(h + of_class.astype(np.uint64) * np.uint64(_MIX[0]) + number.astype(np.int64).view(np.uint64) * np.uint64(_MIX[1])).view(np.int64)


def _each(count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts of rows: the number of the count and the row's number within it, of every row."""
    which = np.repeat(np.arange(len(count)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)


def _long_enough(texts: DataFrame) -> DataFrame:
    return texts.select("cls", "codes").filter(F.size("codes") >= EVERY - 1)


def segments(texts: DataFrame) -> DataFrame:
    """(h, number, place, n, p0, p1, cls) of texts (cls, codes): every segment of every text.

    Numbers of the second half count from the text's end, from -1 downwards.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        widths, numbers = np.array(_WIDTHS), np.array(_NUMBERS)
        for batch in _bounded(batches):
            t = _Texts(batch)
            of_class = np.searchsorted(_BASES, t.n, "right") - 1
            i, number = _each(numbers[of_class])
            k, width = of_class[i], widths[of_class[i]]
            half = -(-numbers[k] // 2)
            place = np.where(number < half, number * width, t.n[i] - (number - half + 1) * width)
            number = np.where(number < half, number, half - 1 - number)
            group = np.maximum(1, numbers[k] // NUMBERED)
            laid_out = np.where(number >= 0, number // group, -1 - (-1 - number) // group)
            h = t.hashed(width, t.begin[i] + place, k, laid_out)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h), pa.array(number.astype(np.int32)), pa.array(place.astype(np.int32)), pa.array(t.n[i].astype(np.int32)),
                 pa.array(t.sketch[0][i]), pa.array(t.sketch[1][i]), t.cls.take(pa.array(i))],
                names=["h", "number", "place", "n", "p0", "p1", "cls"],
            )

    return _long_enough(texts).mapInArrow(cut, "h bigint, number int, place int, n int, p0 bigint, p1 bigint, cls binary")


def sieve_blocks(expected: int) -> int:
    """Blocks of a sieve for so many hashes, a power of two."""
    return min(SIEVE // SIEVE_BLOCK, max(2, 1 << (PER_HASH * expected // SIEVE_BLOCK).bit_length()))


def _sieve_bits(h: np.ndarray, blocks: int) -> Iterator[np.ndarray]:
    """The bits of hashes: two of the block that the upper bits tell."""
    block = (h >> np.uint64(64 - (blocks.bit_length() - 1))).astype(np.int64) * SIEVE_BLOCK
    for shift in (0, 20):
        yield block + ((h >> np.uint64(shift)) & np.uint64(SIEVE_BLOCK - 1)).astype(np.int64)


def sieve(hashes: DataFrame, blocks: int) -> np.ndarray:
    """The bits of hashes (h), packed; on the driver, as they are bounded (``SIEVE``)."""

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.unique(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            block = (h >> np.uint64(64 - (blocks.bit_length() - 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), pa.array(h.view(np.int64))], names=["block", "h"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, bits = None, np.zeros(SIEVE_BLOCK, bool)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([np.packbits(bits).tobytes()])], names=["block", "bits"])

        for batch in batches:
            block, h = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            edges = np.append(np.flatnonzero(np.diff(block, prepend=-1)), len(block))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if block[a] != number:
                    if number is not None:
                        yield out()
                    number = int(block[a])
                    bits[:] = False
                for at in _sieve_bits(h[a:b], blocks):
                    bits[at & (SIEVE_BLOCK - 1)] = True
        if number is not None:
            yield out()

    packed = np.zeros((blocks, SIEVE_BLOCK // 8), np.uint8)
    by_block = hashes.select("h").mapInArrow(once, "block int, h bigint").repartition("block").sortWithinPartitions("block")
    for block, bits in by_block.mapInArrow(merge, "block int, bits binary").collect():
        packed[block] = np.frombuffer(bits, np.uint8)
    return packed


def _passes(h: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Which hashes a sieve lets through: all that were put in, and few others."""
    flat, out = packed.reshape(-1), np.ones(len(h), bool)
    for at in _sieve_bits(h.view(np.uint64), len(packed)):
        out &= (flat[at >> 3] << (at & 7).astype(np.uint8) & 128) > 0
    return out


def probes(texts: DataFrame, packed: Broadcast | None = None) -> DataFrame:
    """(h, at, m, q0, q1, q) of texts (cls, codes): the word runs of each text that a segment may equal, by the numbers it may have.

    Of these only what the sieve ``packed`` lets through, if there is one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bases, widths, numbers = np.array(_BASES), np.array(_WIDTHS), np.array(_NUMBERS)
        above = np.append(bases[1:] - 1, 1 << 31)
        for batch in _bounded(batches):
            t = _Texts(batch)
            longest = t.n + t.n // (EVERY - 1)
            first = np.searchsorted(bases, np.maximum(t.n - t.n // EVERY, EVERY - 1), "right") - 1
            i, step = _each(np.searchsorted(bases, longest, "right") - first)
            k = first[i] + step  # every class a near copy may have
            i, k = i[widths[k] <= t.n[i]], k[widths[k] <= t.n[i]]
            delta = np.maximum(t.n[i], np.minimum(above[k], longest[i])) // EVERY
            j, at = _each(t.n[i] - widths[k] + 1)
            i, k, delta = i[j], k[j], delta[j]
            width, half = widths[k], -(-numbers[k] // 2)
            group = np.maximum(1, numbers[k] // NUMBERED)
            for right in (False, True):
                gone, of_half = (t.n[i] - width - at, numbers[k] - half) if right else (at, half)  # words from its side's end
                low = np.maximum(np.maximum(-(-gone // (width + 1)), -((delta - gone) // width)), 0)
                high = np.minimum(np.minimum(gone // (width - 1), (gone + delta) // width), of_half - 1)
                some = np.flatnonzero(low <= high)
                low, high = low[some] // group[some], high[some] // group[some]
                r, more = _each(high - low + 1)
                number = low[r] + more
                r = some[r]
                text = i[r]
                h = t.hashed(width[r], t.begin[text] + at[r], k[r], -1 - number if right else number)
                if packed is not None:
                    through = np.flatnonzero(_passes(h, packed.value))
                    h, r, text = h[through], r[through], text[through]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(at[r].astype(np.int32)), pa.array(t.n[text].astype(np.int32)), pa.array(t.sketch[0][text]),
                     pa.array(t.sketch[1][text]), t.cls.take(pa.array(text))],
                    names=["h", "at", "m", "q0", "q1", "q"],
                )

    return _long_enough(texts).mapInArrow(run, "h bigint, at int, m int, q0 bigint, q1 bigint, q binary")


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Slices of batches, of about ``WORDS`` words each or one text."""
    for batch in batches:
        ends = np.cumsum(batch.column(1).value_lengths().to_numpy().astype(np.int64)) if batch.num_rows else np.empty(0, np.int64)
        start = 0
        while start < batch.num_rows:
            held = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, held + WORDS, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def ranked(every: DataFrame, often: DataFrame) -> DataFrame:
    """All segments with ``kept``: whether they are among those kept of their text, one more than its possible edits, the
    rarest by ``often`` (h, often)."""
    order = Window.partitionBy("cls").orderBy("often", "number")
    return every.join(often, "h").withColumn("kept", F.row_number().over(order) <= _edits(F.col("n")) + 1).drop("often")


def within(a: list[int], b: list[int], limit: int) -> bool:
    """Whether at most ``limit`` insertions, removals and replacements make two sequences equal (bit-parallel)."""
    start, stop = 0, min(len(a), len(b))
    while start < stop and a[start] == b[start]:
        start += 1
    end = 0
    while end < stop - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > limit:
        return False
    if not a:
        return True
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score, left = full, 0, len(a), len(b)
    for x in b:
        eq = at.get(x, 0)
        vertical = eq | down
        across = (((eq & up) + up) ^ up) | eq
        grow, fall = (down | ~(across | up)) & full, up & across
        score += bool(grow & top) - bool(fall & top)
        left -= 1
        if score - left > limit:
            return False
        grow = (grow << 1 | 1) & full
        up, down = (fall << 1 | ~(vertical | grow)) & full, grow & vertical
    return score <= limit


def _verify(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in pairs:
        near = [
            within(a.tolist(), b.tolist(), max(len(a), len(b)) // EVERY)
            for a, b in zip(rows["q_codes"], rows["c_codes"], strict=True)
        ]
        yield rows.loc[near, ["q", "cls", "held"]]


def _verify(pairs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in pairs:
        near = [
            within(a.tolist(), b.tolist(), max(len(a), len(b)) // EVERY)
            for a, b in zip(rows["q_codes"], rows["c_codes"], strict=True)
        ]
        yield rows.loc[near, ["q", "cls"]]


def _hashed(rows: DataFrame, small: bool) -> DataFrame:
    """The side of a delivery: hashed in each bucket if it is small, so that the other side need not be sorted."""
    return rows.hint("shuffle_hash" if small else "merge")


def near_pairs(runs: DataFrame, queries: DataFrame, index: DataFrame, texts: DataFrame, small: bool = True) -> DataFrame:
    """(q, cls): word sequences of ``queries`` (cls, codes), which probe by ``runs``, and other near ones of the index of ``texts`` (cls, codes).

    Where both have a column ``first``, only those of the index that come first are paired.
    """
    fits = F.expr(
        f"q <> cls AND abs(at - place) + abs(m - n - at + place) <= greatest(m, n) div {EVERY} "
        f"AND bit_count(p0 ^ q0) + bit_count(p1 ^ q1) <= 2 * (greatest(m, n) div {EVERY})"
    )
    candidates = index.join(_hashed(runs, small), "h").filter(fits).select("q", "cls").distinct()
    with_q = candidates.join(queries.withColumnsRenamed({"cls": "q", "codes": "q_codes", "first": "q_first"}), "q")
    both = texts.withColumnRenamed("codes", "c_codes").join(_hashed(with_q, small), "cls")
    if "first" in texts.columns and "first" in queries.columns:
        both = both.filter(F.col("first") < F.col("q_first"))
    return both.select("q", "cls", "q_codes", "c_codes").mapInPandas(_verify, "q binary, cls binary")


class AcceptedIndex:
    """What was accepted so far, under ``path`` in a folder all executors share. One writer at a time."""

    #: Columns of the store's tables; the first one is what a table is bucketed by.
    KINDS = {
        "keys": "key binary",
        "texts": "cls binary, codes array<bigint>",
        "segments": "h bigint, number int, place int, n int, p0 bigint, p1 bigint, cls binary",
        "counts": "h bigint, often bigint",
    }

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.names = spark, path.rstrip("/"), {}

    def _fs(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{path}")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _listed(self, folder: str) -> list[int]:
        at, fs = self._fs(folder)
        return sorted(int(x.getPath().getName()) for x in fs.listStatus(at)) if fs.exists(at) else []

    def _mark(self, name: str) -> None:
        at, fs = self._fs(name)
        fs.create(at, False).close()

    def published(self) -> list[int]:
        """Numbers of the published appends."""
        return self._listed("published")

    def _open(self, expected: int = 0) -> None:
        """Make the store's tables known to the session; a new store is laid out for so many keys."""
        if self.names:
            return
        if not (laid_out := self._listed("buckets")):
            laid_out = [max(BUCKETS, -(-expected // PER_BUCKET))]
            self._mark(f"buckets/{laid_out[0]}")
        run = uuid.uuid4().hex
        for kind, columns in self.KINDS.items():
            name = f"tagtrail_{kind}_{run}"
            by = columns.split()[0]
            self.spark.sql(
                f"CREATE TABLE {name} ({columns}, append int) USING parquet PARTITIONED BY (append) "
                f"CLUSTERED BY ({by}) INTO {laid_out[0]} BUCKETS LOCATION '{self.path}/{kind}'"
            )
            if self.published():
                self.spark.sql(f"ALTER TABLE {name} RECOVER PARTITIONS")
            self.names[kind] = name
        self.buckets = laid_out[0]

    def _table(self, kind: str, appends: list[int] | None = None) -> DataFrame:
        """What was published of a table, or what these appends brought."""
        appends = self.published() if appends is None else appends
        return self.spark.table(self.names[kind]).filter(F.col("append").isin(appends)).drop("append")

    def append(self, keys: DataFrame, texts: DataFrame, kept: DataFrame, counts: DataFrame) -> None:
        """Take in and publish keys (key), texts (cls, codes), their kept segments, and counts of all their segments."""
        self._open()
        number = (self.published() or [0])[-1] + 1

        def write(kind: str, rows: DataFrame) -> None:
            by = self.KINDS[kind].split()[0]
            view = f"tagtrail_rows_{uuid.uuid4().hex}"
            columns = [c.split()[0] for c in self.KINDS[kind].split(", ")]
            rows.select(*columns).repartition(self.buckets, by).createOrReplaceTempView(view)
            self.spark.sql(f"INSERT OVERWRITE TABLE {self.names[kind]} PARTITION (append = {number}) SELECT * FROM {view}")
            self.spark.catalog.dropTempView(view)

        with ThreadPoolExecutor(len(self.KINDS)) as pool:  # four small writes beside each other
            list(pool.map(write, self.KINDS, (keys, texts, kept, counts)))
        self._mark(f"published/{number}")

    def _often(self, every: DataFrame, small: bool = True) -> DataFrame:
        """(h, often): how often segments stand in the store and among the given ones."""
        own = every.groupBy("h").agg(F.count("*").alias("often"))
        held = self._table("counts").join(_hashed(own.select("h"), small), "h")
        return held.unionByName(own).groupBy("h").agg(F.sum("often").alias("often"))

    def load(self, keys: DataFrame, contents: DataFrame) -> None:
        """The history: keys (see :func:`point_key`, :func:`sha_key`) and a table with the column content."""
        texts = _text_columns(contents.select("content").filter("content is not null"))
        texts = texts.groupBy("cls").agg(F.first("codes").alias("codes"))
        texts = materialise(texts, "history-texts").filter("cls is not null")  # a filter before would cut the words twice
        keys = keys.select("key").filter("key is not null").unionByName(texts.select(F.col("cls").alias("key")))
        keys = materialise(keys.distinct(), "history-keys")
        self._open(keys.count())
        every = materialise(segments(texts), "history-segments")
        counts = every.groupBy("h").agg(F.count("*").alias("often"))
        self.append(keys, texts, ranked(every, self._often(every, small=False)).filter("kept"), counts)

    def judge(self, rows: DataFrame) -> DataFrame:
        """(row_id) of the rows found to repeat something; the others are accepted and appended.

        ``rows``: row_id, batch_no, point_id, content_sha, content; each batch_no is a delivery, judged
        by row_id. The number of parts is the length of a driver's loop.
        """
        self._open()
        sha = F.coalesce("content_sha", F.sha2("content", 256))
        read = _text_columns(rows.select("row_id", "batch_no", "point_id", sha.alias("content_sha"), "content"))
        keys = F.array_compact(F.array(point_key(F.col("point_id")), sha_key(F.col("content_sha")), F.col("cls")))
        rank = F.struct("batch_no", "row_id")
        read = read.select("row_id", rank.alias("rank"), "cls", "codes", keys.alias("keys"))
        read = materialise(read, "deliveries")
        if not (count := read.count()):
            return read.select("row_id")
        before = self.published()
        unheld = self._without_keys(read, before, count <= SMALL)
        texts = self._classes(unheld).select("cls", "codes")
        held = self._table("segments", before)
        packed = self.spark.sparkContext.broadcast(sieve(held, sieve_blocks(held.count())))
        runs = probes(texts, packed)
        near = near_pairs(runs, texts, held, self._table("texts", before), count <= SMALL).select(F.col("q").alias("cls")).distinct()
        undecided = materialise(unheld.join(near, "cls", "left_anti").select(*read.columns), "undecided")
        count = undecided.count()
        own = np.zeros((sieve_blocks(EVERY * count), SIEVE_BLOCK // 8), np.uint8)  # of the segments kept of this call's rows
        accepted = [self._judge_part(part, own, before, size <= SMALL) for part, size in _parts(undecided, count)]
        if not accepted:
            return read.select("row_id")
        ids = accepted[0]
        for more in accepted[1:]:
            ids = ids.unionByName(more)
        return read.select("row_id").join(ids, "row_id", "left_anti")

    def _without_keys(self, rows: DataFrame, appends: list[int], small: bool) -> DataFrame:
        """Rows none of whose keys these appends hold."""
        asked = rows.select("row_id", F.explode("keys").alias("key"))
        repeated = self._table("keys", appends).join(_hashed(asked, small), "key").select("row_id").distinct()
        return materialise(rows.join(repeated, "row_id", "left_anti"), "unheld")

    def _classes(self, rows: DataFrame) -> DataFrame:
        """(cls, first, codes): the distinct word sequences of rows, and the least rank of each."""
        # spread by number, as they are small in bytes and heavy in probes
        spread = rows.filter("cls is not null").repartition(int(self.spark.conf.get("spark.sql.shuffle.partitions")), "cls")
        return materialise(spread.groupBy("cls").agg(F.min("rank").alias("first"), F.first("codes").alias("codes")), "classes")

    def _judge_part(self, part: DataFrame, own: np.ndarray, before: list[int], small: bool) -> DataFrame:
        """(row_id) of the accepted rows of a part (row_id, rank, cls, codes, keys), which are appended.

        The part repeats nothing of the appends ``before``. Its kept segments are put into the sieve ``own``.
        """
        since = [n for n in self.published() if n not in before]
        unheld = self._without_keys(part, since, small) if since else part
        classes = self._classes(unheld)
        texts = classes.select("cls", "codes")
        every = segments(texts)
        every = materialise(ranked(every, self._often(every, small)), "part-segments")
        own |= sieve(every.filter("kept"), len(own))
        runs = materialise(probes(texts, self.spark.sparkContext.broadcast(own)), "part-runs")
        near = near_pairs(runs, classes, every.filter("kept"), classes, small).withColumn("held", F.lit(False))
        if since:
            held = near_pairs(runs, texts, self._table("segments", since), self._table("texts", since), small)
            near = near.unionByName(held.withColumn("held", F.lit(True)))
        near = materialise(near, "part-near")
        undecided = unheld.join(near.filter("held").select(F.col("q").alias("cls")).distinct(), "cls", "left_anti")
        undecided = materialise(undecided.select("row_id", "cls", "keys", "rank"), "part-undecided")
        links = near.filter("not held").select("q", F.col("cls").alias("other"))
        links = links.unionByName(links.select(F.col("other").alias("q"), F.col("q").alias("other")))
        mine = undecided.select("row_id", "rank", F.explode("keys").alias("key"))
        linked = undecided.select("row_id", "rank", "cls").join(links.withColumnRenamed("q", "cls"), "cls")
        heard = mine.unionByName(linked.select("row_id", "rank", F.col("other").alias("key")))
        taken = first_accepted(undecided.select("row_id", "rank"), mine.select("row_id", "key"), heard)
        accepted = undecided.join(taken, "row_id", "left_semi")
        new = accepted.filter("cls is not null").select("cls").distinct()
        every = every.join(new, "cls", "left_semi")
        counts = every.groupBy("h").agg(F.count("*").alias("often"))
        self.append(accepted.select(F.explode("keys").alias("key")).distinct(), texts.join(new, "cls", "left_semi"), every.filter("kept"), counts)
        return taken


def _parts(rows: DataFrame, count: int) -> list[tuple[DataFrame, int]]:
    """Rows in parts of growing size, in order of rank: about ``FIRST`` rows, then ``GROWTH`` times as many, and so on.

    With each part goes about how many rows it has. Bounds come from a bounded sample, of about ``8 * FIRST`` ranks.
    """
    if count <= FIRST:
        return [(rows, count)] if count else []
    seen = [r[0] for r in rows.sample(min(1.0, 8 * FIRST / count), 5).select("rank").collect()]
    seen.sort(key=lambda r: [(x is not None, x) for x in r])
    bounds, upto, size = [], FIRST, FIRST
    while upto < count and seen:
        bounds.append(seen[min(len(seen) - 1, int(upto / count * len(seen)))])
        size *= GROWTH
        upto += size
    edges, size = [None, *dict.fromkeys(bounds), None], FIRST
    kind = rows.schema["rank"].dataType

    def upper(bound: Row) -> Column:
        return F.struct(*[F.lit(x).cast(f.dataType).alias(f.name) for x, f in zip(bound, kind.fields, strict=True)])

    parts = []
    for low, high in zip(edges, edges[1:], strict=False):
        part = rows if low is None else rows.filter(F.col("rank") > upper(low))
        parts.append((part if high is None else part.filter(F.col("rank") <= upper(high)), min(size, count)))
        size *= GROWTH
    return parts


def _key(kind: str, value: Column) -> Column:
    return F.unhex(F.md5(F.concat(F.lit(kind), value)))


def point_key(point_id: Column) -> Column:
    """The key of an identifier, as 16 bytes."""
    return _key("p:", point_id)


def sha_key(sha: Column) -> Column:
    """The key of a checksum, as 16 bytes."""
    return _key("s:", sha)

"""Most similar vectors for every vector, by cosine.

A forest of random-projection trees: each inner node splits by the hyperplane between two random
sample points of its region, at the median of the sample. The trees are fitted on a sample of
about ``SAMPLE`` vectors, whatever the collection's size, and have at most ``DEPTH`` levels, so
what is sent to every task is bounded (``TREES * 2**DEPTH * (dim + 1)`` floats); every vector is
indexed. A query walks all trees at once with one shared priority queue: the branch not taken at
a node waits with its distance from the hyperplane, and the least one over all trees goes next,
until ``PROBES`` leaves are seen.

Vectors and queries meet by a shuffle on the leaf, with their values as given. Leaves are large and
few are seen, as each leaf a vector is sent to costs its bytes, and products within a leaf are
cheap. Past ``LEAF * 2**DEPTH`` vectors leaves grow with the collection: a leaf of more than
``LOCAL`` vectors gets a forest of its own, grown in its task, in which a query sees ``LOCAL_PROBES``
leaves, so a query's work doesn't grow with the leaf; and one of more than ``BLOCK`` is split into
blocks which every query of the leaf visits, so no task gets an unbounded group. Each leaf ranks
all of its vectors for a query in double precision, ties by id, and gives the first k; the first k
of those over all leaves are the result. So what is lost is only what shares no leaf with the query.

Defined results
    * usable vectors have the expected number of finite values, not all zero; of rows with the same
      id the earliest counts (null time is the latest; a tie goes to the lesser vector);
    * equal similarities go by id, the lesser first. Copies are vectors of exactly one direction,
      whatever their lengths. Of copies only the first ``k + 1`` by id can be among anyone's k
      nearest; those beyond get the first k of their copies;
    * empty tables and single vectors give no rows; other columns, of whatever name, are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.plans.work import materialise

#: Trees, leaves seen by a query, vectors of a leaf, most levels, sample of the fit, most vectors of a block.
TREES, PROBES, LEAF, DEPTH, SAMPLE, BLOCK = 8, 14, 1024, 14, 65_536, 65_536
#: Vectors of a leaf that are all compared; trees and leaves seen by a query in the forest of a larger one.
LOCAL, LOCAL_TREES, LOCAL_PROBES = 8192, 4, 12
#: More than the order of summation can change in a similarity; most similarities, and most pairs, computed at once.
SLACK, CELLS, PAIRS = 1e-12, 1 << 22, 1 << 16


def usable(rows: DataFrame, dim: int = 64) -> DataFrame:
    """(id, vector) of rows (id, vector, at): the earliest usable vector of each id."""
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    good = (F.size("vector") == dim) & finite & F.exists("vector", lambda x: x != 0)
    first = F.min(F.struct(F.col("at").isNull().alias("late"), "at", "vector")).alias("first")
    return rows.filter(F.col("id").isNotNull() & good).groupBy("id").agg(first).select("id", F.col("first.vector").alias("vector"))


@dataclass
class Forest:
    """Complete trees as arrays by node: split normals, split places; expected vectors of each leaf."""

    normal: np.ndarray  # (trees, nodes, dim)
    place: np.ndarray  # (trees, nodes)
    expected: np.ndarray  # (trees, leaves)
    depth: int

    def walk(self, unit: np.ndarray, probes: int) -> np.ndarray:
        """Numbers (tree * leaves + leaf) of the leaves each row sees, in order; the first of each tree are its own."""
        trees, leaves = len(self.normal), 1 << self.depth
        probes = min(max(probes, trees), trees * leaves)
        rows = np.arange(len(unit))
        waiting = np.full((len(unit), trees + probes * self.depth), np.inf, np.float32)
        waiting[:, :trees] = np.arange(trees) * np.float32(1e-30)
        node = np.zeros(waiting.shape, np.int32)
        node[:, :trees] = np.arange(trees) * (2 * leaves)
        seen = np.empty((len(unit), probes), np.int64)
        free = trees
        for i in range(probes):
            best = waiting[:, :free].argmin(axis=1)
            least, at = waiting[rows, best], node[rows, best]
            waiting[rows, best] = np.inf
            tree, inner = at // (2 * leaves), at % (2 * leaves)
            for _ in range(self.depth):
                go = np.flatnonzero(inner < leaves - 1)
                if not len(go):
                    break
                t, n = tree[go], inner[go]
                gap = np.einsum("ij,ij->i", unit[go], self.normal[t, n]) - self.place[t, n]
                right = gap > 0
                waiting[go, free] = np.maximum(least[go], np.abs(gap))
                node[go, free] = t * (2 * leaves) + 2 * n + 2 - right
                inner[go] = 2 * n + 1 + right
                free += 1
            seen[:, i] = tree * leaves + (inner - (leaves - 1))
        return seen


def fit(sample: np.ndarray, count: int, trees: int, leaf: int, most: int = DEPTH, seed: int = 7) -> Forest:
    """A forest for ``count`` vectors from unit vectors of a sample."""
    depth = min(most, max(0, int(np.ceil(np.log2(max(count, 1) / leaf)))))
    nodes, dim = (1 << depth) - 1, sample.shape[1]
    normal, place = np.zeros((trees, nodes, dim), np.float32), np.zeros((trees, nodes), np.float32)
    expected = np.zeros((trees, 1 << depth))
    for t in range(trees):
        rng = np.random.default_rng([seed, t])
        parts = [np.arange(len(sample))]
        for n in range(nodes):
            mine = parts[n]
            if len(mine) > 1:
                a, b = sample[rng.choice(mine, 2, replace=False)]
                split = a - b
            else:
                split = rng.normal(size=dim)
            split = rng.normal(size=dim) if not split.any() else split
            normal[t, n] = split / np.linalg.norm(split)
            far = sample[mine] @ normal[t, n]
            place[t, n] = np.median(far) if len(mine) else 0
            right = far > place[t, n]
            parts += [mine[~right], mine[right]]
        expected[t] = [len(p) for p in parts[nodes:]]
    return Forest(normal, place, expected * (count / max(1, len(sample))), depth)


def direction(vector: Column | str) -> Column:
    """A 128-bit key that vectors of single precision share if one is exactly a positive multiple of the other.

    Quotients of two single-precision numbers that differ do so by more than double precision rounds.
    """
    once = lambda value, use: F.transform(F.array(value), use)[0]  # noqa: E731  # what is bound by a lambda is computed once
    largest = F.array_max(F.transform(vector, lambda x: F.abs(x).cast("double")))
    scaled = once(largest, lambda most: F.transform(vector, lambda x: x.cast("double") / most + F.lit(0.0)))
    return once(scaled, lambda v: F.struct(F.xxhash64(v).alias("a"), F.xxhash64(F.lit(1), v).alias("b")))


def _units(raw: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, the same to the last bit for copies."""
    raw = raw.astype(np.float64)
    raw /= np.abs(raw).max(axis=1, keepdims=True)
    return raw / np.linalg.norm(raw, axis=1, keepdims=True)


def _similarity(q: np.ndarray, m: np.ndarray, row: np.ndarray, col: np.ndarray) -> np.ndarray:
    """Of stated pairs, summed in one order wherever they meet."""
    parts = [(q[row[i : i + PAIRS]] * m[col[i : i + PAIRS]]).sum(axis=1) for i in range(0, len(row), PAIRS)]
    return np.minimum(1.0, np.concatenate([np.empty(0), *parts]))


class _Held:
    """The vectors of a leaf (or of a block of one), with a forest of their own if they are many."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.ids, self.unit, self.asks = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.empty(0, np.int64),) * 3
        self.forest: Forest | None = None
        if len(self.ids) > LOCAL:
            small = self.unit.astype(np.float32)
            sample = small[np.random.default_rng(len(small)).choice(len(small), LOCAL, replace=False)]
            self.forest = fit(sample, len(small), LOCAL_TREES, LEAF, seed=13)
            own = np.concatenate([self.forest.walk(small[i : i + 4096], LOCAL_TREES) for i in range(0, len(small), 4096)])
            order = np.argsort(own.ravel(), kind="stable")
            leaves, begin = np.unique(own.ravel()[order], return_index=True)
            self.leaves = dict(zip(leaves.tolist(), np.split(order // LOCAL_TREES, begin[1:]), strict=True))

    def meeting(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows of the queries, numbers of the vectors) to be compared."""
        if self.forest is None:
            yield np.arange(len(q)), np.arange(len(self.ids))
            return
        for i in range(0, len(q), 4096):
            seen = self.forest.walk(q[i : i + 4096].astype(np.float32), LOCAL_PROBES)
            order = np.argsort(seen.ravel(), kind="stable")
            leaves, begin = np.unique(seen.ravel()[order], return_index=True)
            for leaf, rows in zip(leaves.tolist(), np.split(order // seen.shape[1], begin[1:]), strict=True):
                if leaf in self.leaves:
                    yield rows + i, self.leaves[leaf]


def _routed(members: DataFrame, forest, probes: int, dim: int) -> DataFrame:
    """(leaf, block, role, id, raw) rows: 0 a vector that is also a query, 1 a vector, 2 a query."""

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Forest = forest.value
        blocks = np.maximum(1, np.ceil(f.expected.ravel() / BLOCK)).astype(np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                ids, asks = batch.column(0).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
                values = np.asarray(batch.column(1).flatten(), np.float32).reshape(-1, dim)
                raw = pa.array([x.tobytes() for x in values], pa.binary())
                seen = f.walk(_units(values).astype(np.float32), probes)
                row, i = np.indices(seen.shape).reshape(2, -1)
                leaf, own = seen.ravel(), i < len(f.normal)
                keep = own | asks[row]
                row, leaf, own = row[keep], leaf[keep], own[keep]
                single = blocks[leaf] == 1
                ask = asks[row]
                parts = [  # (rows, block, role)
                    (np.flatnonzero(own & single), None, np.where(ask, 0, 1)),
                    (np.flatnonzero(own & ~single), ids[row] % blocks[leaf], np.ones(len(row), np.int64)),
                    (np.flatnonzero(~own & single), None, np.full(len(row), 2)),
                ]
                out = [(p, np.zeros(len(p), np.int64) if b is None else b[p], r[p]) for p, b, r in parts]
                large = np.flatnonzero(ask & ~single)  # a query of a split leaf visits each block
                times = blocks[leaf[large]]
                spread = np.repeat(large, times)
                number = np.arange(len(spread)) - np.repeat(np.cumsum(times) - times, times)
                out.append((spread, number, np.full(len(spread), 2)))
                p, b, r = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(leaf[p]), pa.array(b.astype(np.int32)), pa.array(r.astype(np.int32)), pa.array(ids[row[p]]), raw.take(pa.array(row[p]))],
                    names=["leaf", "block", "role", "id", "raw"],
                )

    return members.select("id", "vector", "asks").mapInArrow(route, "leaf bigint, block int, role int, id bigint, raw binary")


def _candidates(routed: DataFrame, k: int, least: float | None, dim: int) -> DataFrame:
    """(q, c, similarity): the k nearest of every block for its queries, exactly, ties by id."""

    def best(q_id: np.ndarray, q: np.ndarray, m_id: np.ndarray, m: np.ndarray) -> pa.RecordBatch:
        near = q @ m.T
        near[q_id[:, None] == m_id[None, :]] = -2
        floor = np.full(len(q), -1.5 if least is None else least - SLACK)
        many = np.flatnonzero((near >= floor[:, None]).sum(axis=1) > k)
        if len(many):
            floor[many] = np.maximum(floor[many], np.partition(near[many], -k, axis=1)[:, -k] - SLACK)
        row, col = np.nonzero(near >= floor[:, None])
        value = _similarity(q, m, row, col)
        if least is not None:
            high = value >= least
            row, col, value = row[high], col[high], value[high]
        order = np.lexsort((m_id[col], -value, row))
        row, col, value = row[order], col[order], value[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < k
        return pa.RecordBatch.from_arrays(
            [pa.array(q_id[row[keep]]), pa.array(m_id[col[keep]]), pa.array(value[keep])], names=["q", "c", "similarity"]
        )

    def answers(q_id: np.ndarray, q: np.ndarray, held: _Held) -> Iterator[pa.RecordBatch]:
        for rows, members in held.meeting(q):
            step = max(1, CELLS // max(1, len(members)))
            m_id, m = held.ids[members], held.unit[members]
            for i in range(0, len(rows), step):
                yield best(q_id[rows[i : i + step]], q[rows[i : i + step]], m_id, m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            leaf, block, role, ids = (batch.column(i).to_numpy() for i in range(4))
            unit = _units(np.frombuffer(b"".join(batch.column(4).to_pylist()), np.float32).reshape(-1, dim))
            edges = np.flatnonzero((np.diff(leaf) != 0) | (np.diff(block) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(leaf)], strict=True):
                if key != (leaf[a], block[a]):
                    yield from own_queries(held or _Held(parts))
                    key, parts, held = (leaf[a], block[a]), [], None
                upto = a + int(np.searchsorted(role[a:b], 2))
                if upto > a:
                    parts.append((ids[a:upto], unit[a:upto], role[a:upto] == 0))
                if upto < b and parts:
                    held = held or _Held(parts)  # queries come after all vectors
                    yield from answers(ids[upto:b], unit[upto:b], held)
        yield from own_queries(held or _Held(parts))

    def own_queries(held: _Held) -> Iterator[pa.RecordBatch]:
        if len(held.ids):
            yield from answers(held.ids[held.asks], held.unit[held.asks], held)

    met = routed.repartition("leaf", "block").sortWithinPartitions("leaf", "block", "role")
    return met.mapInArrow(run, "q bigint, c bigint, similarity double")


def _one_in(ids: DataFrame, n: int) -> DataFrame:
    """(id) of distinct ids: those whose number in id order, from 0, ``n`` divides, however the rows are spread."""
    number = F.monotonically_increasing_id()  # the part's in the upper bits, the row's within it in the lower 33
    placed = materialise(
        ids.select("id").repartitionByRange("id").sortWithinPartitions("id").select(
            "id", F.shiftright(number, 33).alias("part"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("at")
        ), "numbers",
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part
    parts = placed.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    return placed.join(F.broadcast(parts), "part").filter((F.col("before") + F.col("at")) % n == 0).select("id")


def nearest(
    vectors: DataFrame, k: int = 5, least: float | None = None, one_in: int = 1, dim: int = 64,
    trees: int = TREES, probes: int = PROBES, leaf: int = LEAF,
) -> DataFrame:
    """(id, other, rank, similarity) of vectors (id string, vector): the k most similar others.

    ``least`` leaves out similarities below it, before they are shuffled. ``one_in``: only vectors
    whose number in id order among all, copies too, it divides are asked for; all are searched.
    """
    spark = vectors.sparkSession
    vectors = materialise(vectors.select("id", "vector"), "usable")  # read by every step below
    copies = Window.partitionBy(direction("vector")).orderBy("id")
    rows = vectors.select("id", "vector", F.lit(True).alias("asks"))
    if one_in > 1:
        chosen = _one_in(vectors, one_in).select("id", F.lit(True).alias("asks"))
        rows = vectors.select("id", "vector").join(chosen, "id", "left").fillna(False, ["asks"])
    ranked = rows.select("id", "vector", "asks", F.row_number().over(copies).alias("copy"))
    bounded = ranked.filter(F.col("copy") <= k + 1)  # every task keeps its first k + 1 before the shuffle
    ordered = bounded.repartitionByRange("id").sortWithinPartitions("id").select(
        F.monotonically_increasing_id().alias("n"), "id", "vector", "asks"
    )
    members = materialise(ordered.withColumnRenamed("id", "name").withColumnRenamed("n", "id"), "vectors")
    count = members.count()
    if not count:
        return spark.createDataFrame([], "id string, other string, rank int, similarity double")
    sample = np.array([r[0] for r in members.sample(min(1.0, SAMPLE / count), 11).select("vector").toLocalIterator()], np.float64)
    if not len(sample):
        sample = np.array([r[0] for r in members.select("vector").take(1)], np.float64)
    sample /= np.linalg.norm(sample, axis=1, keepdims=True)
    forest = spark.sparkContext.broadcast(fit(sample.astype(np.float32), count, trees, leaf))

    found = _candidates(_routed(members, forest, probes, dim), k, least, dim)
    merged = found.groupBy("q", "c").agg(F.max("similarity").alias("similarity"))
    by_query = Window.partitionBy("q").orderBy(F.desc("similarity"), "c")
    top = merged.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    names = members.select("id", "name")
    named = (
        top.join(names.withColumnsRenamed({"id": "q", "name": "of"}), "q")
        .join(names.withColumnsRenamed({"id": "c", "name": "other"}), "c")
        .select(F.col("of").alias("id"), "other", "rank", "similarity")
    )
    # copies beyond the first k + 1: their class has k + 1 members here, all of lesser id
    classes = members.groupBy(direction("vector").alias("copies")).agg(F.array_sort(F.collect_list("name")).alias("first")).filter(F.size("first") == k + 1)
    beyond = rows.filter("asks").select("id", direction("vector").alias("copies")).join(classes, "copies").filter(F.col("id") > F.element_at("first", k + 1))
    rest = beyond.select("id", F.posexplode(F.slice("first", 1, k)).alias("at", "other"))
    return named.unionByName(rest.select("id", "other", (F.col("at") + 1).alias("rank"), F.lit(1.0).alias("similarity")))


def mutual(links: DataFrame) -> DataFrame:
    """(a, b) with a < b: pairs in which each is among the nearest of the other."""
    pair = links.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return pair.groupBy("a", "b").count().filter(F.col("count") == 2).select("a", "b")

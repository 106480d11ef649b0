"""Exact nearest chunks of a query vector, with filters, and of many query vectors at once."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tagtrail.functions import text as T

#: Bytes of query vectors sent to every task at once; queries and rows whose similarities are computed at once.
QUERY_BYTES, QUERIES, ROWS = 32 << 20, 512, 4096


def equal_filters(points: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows equal in every column that is asked for; the filters reach the scan, before any similarity."""
    for column, value in wanted.items():
        if value:
            points = points.filter(F.col(column) == value)
    return points


def top_k(points: DataFrame, query: Sequence[float], k: int, vector: str = "vector", tie: str = "point_id") -> DataFrame:
    """The k rows most similar to a query, with ``score``; ties go by ``tie``. One partial top-k per task."""
    score = T.cosine_to(vector, list(query))
    scored = points.withColumn("score", score).filter(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), tie).limit(k)


def drop_repeated_entries(hits: DataFrame, rank: Sequence[Column]) -> DataFrame:
    """The first hit, by rank, of every changelog entry: same release (or path), title, file name and begin of text."""
    release = F.coalesce(F.nullif(T.release_of("file_path"), F.lit("")), F.col("file_path"))
    key = [release, F.col("symbol_name"), T.basename("file_path"), F.left(T.snippet("content", 600), F.lit(120))]
    named = hits.withColumns({f"_k{i}": c for i, c in enumerate(key)})
    first = Window.partitionBy(*[f"_k{i}" for i in range(len(key))]).orderBy(*rank)
    return named.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n", *[f"_k{i}" for i in range(len(key))])


def hits(found: DataFrame) -> DataFrame:
    """What a search shows of each chunk."""
    return found.select(
        F.round("score", 4).alias("score"), "file_path", "version", "area", "language", "symbol_kind", "symbol_name",
        "symbol_fqn", "deprecated_in", F.concat_ws("-", "start_line", "end_line").alias("lines"),
        T.snippet("content", 600).alias("snippet"), "point_id",
    )


def search(
    points: DataFrame, query: Sequence[float], k: int = 10, *, area: str | None = None, version: str | None = None,
    language: str | None = None, file_path: str | None = None,
) -> DataFrame:
    """Hits of a query in an area; of changelog entries, four times as many are ranked and repeated ones dropped."""
    chosen = equal_filters(points, area=area, version=version, language=language, file_path=file_path)
    order = [F.desc("score"), F.col("point_id")]
    if area == "changes":
        found = drop_repeated_entries(top_k(chosen, query, 4 * k), order).orderBy(*order).limit(k)
    else:
        found = top_k(chosen, query, k)
    return hits(found)


def _arrow(rows: DataFrame, column: str) -> pa.DataType:
    return to_arrow_type(rows.schema[column].dataType)


def top_k_of_each(
    points: DataFrame, queries: DataFrame, k: int, dim: int, *, key: str = "point_id", vector: str = "vector"
) -> DataFrame:
    """(q, key, score, rank): for each of the stated queries (q, vector) its k most similar rows of ``points``.

    Queries are taken in blocks of a bounded size; every task scores its rows against a block and
    keeps its own k best of each query, so what is shuffled doesn't grow with the rows of a task.
    Vectors that are null, of another length or all zero are left out.
    """
    spark = points.sparkSession
    per_block = max(1, QUERY_BYTES // (8 * dim))
    good = (F.size(vector) == dim) & F.exists(vector, lambda x: x != 0)
    kind = points.schema[key].dataType.simpleString()
    q_kind = queries.schema["q"].dataType.simpleString()
    blocks: list[DataFrame] = []

    empty = pa.schema([("q", _arrow(queries, "q")), ("key", _arrow(points, key)), ("score", pa.float64())])

    def block(rows: list) -> DataFrame:
        ids = [r[0] for r in rows]
        asked = np.array([r[1] for r in rows], np.float64)
        asked /= np.linalg.norm(asked, axis=1, keepdims=True)
        sent = spark.sparkContext.broadcast((ids, asked))

        def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            names, unit = sent.value
            held_q, held_k, held_s = np.empty(0, np.int64), np.empty(0, object), np.empty(0)  # at most k of each query
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    part = batch.slice(at, ROWS)
                    v = np.asarray(part.column(1).flatten(), np.float64).reshape(-1, dim)
                    v /= np.linalg.norm(v, axis=1, keepdims=True)
                    keys = np.array(part.column(0).to_pylist(), object)
                    least = np.full(len(names), -2.0)  # the k-th similarity of those that have k already
                    full = np.flatnonzero(np.bincount(held_q, minlength=len(names)) == k)
                    least[full] = held_s[np.searchsorted(held_q, full, "right") - 1]
                    found = [(held_q, held_k, held_s)]
                    for q in range(0, len(names), QUERIES):
                        s = unit[q : q + QUERIES] @ v.T
                        floor = least[q : q + QUERIES]
                        if s.shape[1] > k:
                            floor = np.maximum(floor, np.partition(s, -k, axis=1)[:, -k])
                        row, col = np.nonzero(s >= floor[:, None])  # all that tie with the last are looked at
                        found.append((row + q, keys[col], s[row, col]))
                    held_q, held_k, held_s = (np.concatenate(x) for x in zip(*found, strict=True))
                    _, by_key = np.unique(held_k, return_inverse=True)
                    order = np.lexsort((by_key, -held_s, held_q))
                    held_q, held_k, held_s = held_q[order], held_k[order], held_s[order]
                    keep = np.arange(len(held_q)) - np.searchsorted(held_q, held_q) < k
                    held_q, held_k, held_s = held_q[keep], held_k[keep], held_s[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array([names[i] for i in held_q]), pa.array(held_k.tolist()), pa.array(held_s)], names=["q", "key", "score"]
            ) if len(held_q) else pa.RecordBatch.from_pylist([], schema=empty)

        return points.filter(good).select(key, vector).mapInArrow(best, f"q {q_kind}, key {kind}, score double")

    waiting: list = []
    for row in queries.filter((F.size("vector") == dim) & F.exists("vector", lambda x: x != 0)).select("q", "vector").toLocalIterator():
        waiting.append(row)
        if len(waiting) == per_block:
            blocks.append(block(waiting))
            waiting = []
    if waiting:
        blocks.append(block(waiting))
    if not blocks:
        return spark.createDataFrame([], f"q {q_kind}, {key} {kind}, score double, rank int")
    found = blocks[0]
    for other in blocks[1:]:
        found = found.unionByName(other)
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    ranked = found.withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("key", key)

"""Queries of the operators of this subpackage, over the given tables whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagtrail.functions import reading
from tagtrail.llm import batch_dedup, doc_pairs, neighbours, packing, shared_spans, tokens
from tagtrail.plans.registry import Registry
from tagtrail.plans.work import work_path
from tagtrail.sources.tables import table

REGISTRY = Registry()


@REGISTRY.add("p2_found")
def p2_found(spark: SparkSession, root: str) -> DataFrame:
    """Index of the history, then the batches as deliveries, one after another: rows found to repeat something."""
    sha = reading.content_sha("content_sha")
    says_something = sha.isNotNull() & (F.btrim("file_path", F.lit(reading.BLANKS)) != "")
    both = F.array(batch_dedup.point_key(F.col("point_id")), batch_dedup.sha_key(sha))
    keys = table(spark, root, "chunk_index").filter(says_something).select(F.explode(both).alias("key"))
    keys = keys.unionByName(table(spark, root, "vector_cache").select(batch_dedup.sha_key(sha).alias("key")))
    index = batch_dedup.AcceptedIndex(spark, work_path(spark, "accepted"))
    index.load(keys, table(spark, root, "chunks"))
    batch = table(spark, root, "chunk_index_batch").select(
        "row_id", "batch_no", "point_id", sha.alias("content_sha"), "content"
    )
    return index.judge(batch)


def _vectors(spark: SparkSession, root: str) -> DataFrame:
    cache = table(spark, root, "vector_cache")
    return neighbours.usable(
        cache.select(reading.content_sha("content_sha").alias("id"), "vector", F.col("cached_at").alias("at"))
    )


_SHA = reading.sql_content_sha("content_sha")


@REGISTRY.add(
    "p3_found",
    f"""
WITH u AS (
    SELECT {_SHA} AS sha, CAST(vector AS DOUBLE[]) AS v FROM vector_cache
    WHERE {_SHA} IS NOT NULL AND len(vector) = 64 AND list_bool_and([x IS NOT NULL AND isfinite(x) for x in vector])
      AND list_bool_or([x <> 0 for x in vector])
    QUALIFY row_number() OVER (PARTITION BY {_SHA} ORDER BY cached_at NULLS LAST, vector) = 1),
s AS (SELECT a.sha AS a, b.sha AS b, list_cosine_similarity(a.v, b.v) AS c FROM u a JOIN u b ON a.sha <> b.sha),
k AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 5)
SELECT least(a, b) AS content_sha_a, greatest(a, b) AS content_sha_b FROM k WHERE c >= 0.9 GROUP BY ALL HAVING count(*) = 2
""",
)
def p3_found(spark: SparkSession, root: str) -> DataFrame:
    links = neighbours.nearest(_vectors(spark, root), least=0.9)
    return neighbours.mutual(links).withColumnsRenamed({"a": "content_sha_a", "b": "content_sha_b"})


@REGISTRY.add("p3_nearest")
def p3_nearest(spark: SparkSession, root: str) -> DataFrame:
    """The five most similar of every twentieth vector, among all."""
    return neighbours.nearest(_vectors(spark, root), one_in=20, trees=8, probes=48)


@REGISTRY.add("p5_found")
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return doc_pairs.pairs(table(spark, root, "chunks"), code=False).select("point_id", "function_name").distinct()


@REGISTRY.add("p5_pairs")
def p5_pairs(spark: SparkSession, root: str) -> DataFrame:
    """Code and description of every documented function."""
    return doc_pairs.pairs(table(spark, root, "chunks"))


@REGISTRY.add("p6_ids")
def p6_ids(spark: SparkSession, root: str) -> DataFrame:
    return tokens.encode(table(spark, root, "documents"), tokens.vocabulary(spark))


@REGISTRY.add("p6_decoded", "SELECT doc_id, sha256(coalesce(text, '')) AS text_sha, length(coalesce(text, '')) AS n_chars FROM documents")
def p6_decoded(spark: SparkSession, root: str) -> DataFrame:
    """Every text encoded and put together again from its tokens, each at the byte where it began."""
    ranks = tokens.vocabulary(spark)
    encoded = tokens.encode(table(spark, root, "documents"), ranks, offsets=True)
    back = tokens.decode(encoded, ranks, offsets="offsets")
    return back.select("doc_id", F.sha2("text", 256).alias("text_sha"), F.char_length("text").cast("bigint").alias("n_chars"))


def _sized(spark: SparkSession, root: str) -> DataFrame:
    docs = table(spark, root, "documents")
    counted = tokens.count_tokens(docs, tokens.vocabulary(spark), ["doc_id", "source"])
    return counted.select(F.col("doc_id").alias("key"), "source", F.col("tokens").alias("size"))


@REGISTRY.add("p7_containers")
def p7_containers(spark: SparkSession, root: str) -> DataFrame:
    """Where every text goes: one row per text, or per piece of a text larger than a container."""
    return packing.pack(_sized(spark, root)).withColumnRenamed("key", "doc_id")


#: Share of tokens asked of a source in every window; the others share the rest by their sizes.
TARGETS = {"platform-trunk": 0.25}


@REGISTRY.add("p7_targets")
def p7_targets(spark: SparkSession, root: str) -> DataFrame:
    """As ``p7_containers``, with a stated share of the largest source in every window, as long as it lasts."""
    return packing.pack(_sized(spark, root), targets=TARGETS).withColumnRenamed("key", "doc_id")


@REGISTRY.add(
    "p7_fill",
    """
SELECT count(*) AS texts, count(*) FILTER (WHERE coalesce(text, '') = '') AS empty_texts, 0 AS over_capacity, 0 AS split_small,
       0 AS incomplete, true AS well_filled FROM documents
""",
)
def p7_fill(spark: SparkSession, root: str) -> DataFrame:
    """One row about ``p7_containers``: what was placed, what breaks a rule, and whether at most 5 % and one container more are used than must be."""
    sized = _sized(spark, root)
    placed = packing.pack(sized)
    per_text = placed.groupBy("key").agg(
        F.sum("size").alias("placed"), F.count("container").alias("pieces")
    ).join(sized.groupBy("key").agg(F.sum("size").alias("size")), "key", "full_outer")
    most = packing.CAPACITY
    texts = per_text.agg(
        F.count("*").alias("texts"), F.count_if(F.col("size") == 0).alias("empty_texts"),
        F.count_if((F.col("pieces") > 1) & (F.col("size") <= most)).cast("int").alias("split_small"),
        F.count_if(~F.col("placed").eqNullSafe(F.col("size"))).cast("int").alias("incomplete"), F.sum("size").alias("tokens"),
    )
    boxes = placed.filter("container is not null").groupBy("container").agg(F.sum("size").alias("held")).agg(
        F.count("*").alias("boxes"), F.count_if(F.col("held") > most).cast("int").alias("over_capacity")
    )
    names = ["texts", "empty_texts", "over_capacity", "split_small", "incomplete", "tokens", "boxes"]
    both = texts.unionByName(boxes, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in names])  # one row of each
    filled = F.col("boxes") <= F.ceil(F.col("tokens") / most * 1.05) + 1
    return both.select(*names[:5], F.coalesce(filled, F.lit(True)).alias("well_filled"))


_SQL_SHARED = """
w AS (SELECT doc_id, i, hash(substr(text, i, 240)) AS h
      FROM (SELECT doc_id, text, unnest(range(1, length(text) - 238)) AS i FROM documents WHERE length(text) >= 240)),
r AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) <> max(doc_id))"""


@REGISTRY.add("p8_found", f"WITH {_SQL_SHARED} SELECT DISTINCT doc_id FROM w JOIN r USING (h)")
def p8_found(spark: SparkSession, root: str) -> DataFrame:
    return shared_spans.shared_spans(table(spark, root, "documents")).select("doc_id").distinct()


@REGISTRY.add(
    "p8_coverage",
    f"""
WITH {_SQL_SHARED},
g AS (SELECT doc_id, least(240, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 240)) AS c FROM w JOIN r USING (h)),
s AS (SELECT doc_id, CAST(sum(c) AS BIGINT) AS n FROM g GROUP BY doc_id)
SELECT doc_id, coalesce(length(text), 0) AS n_chars, coalesce(n, 0) AS shared_chars FROM documents LEFT JOIN s USING (doc_id)
""",
)
def p8_coverage(spark: SparkSession, root: str) -> DataFrame:
    """How much of each document stands elsewhere too."""
    docs = table(spark, root, "documents")
    return shared_spans.coverage(docs, shared_spans.shared_spans(docs))

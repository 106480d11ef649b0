"""Queries over the releases: history of deprecated symbols, files changed between snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtrail.functions import reading
from tagtrail.operators.history import EntityHistory
from tagtrail.operators.snapshot_diff import snapshot_changes
from tagtrail.plans.registry import Registry
from tagtrail.plans.work import materialise, work_path
from tagtrail.sources.tables import snapshots, sql_snapshots, table

REGISTRY = Registry()


def symbol_history(spark: SparkSession, root: str) -> DataFrame:
    """Chains of all symbols: deliveries made before the next release, then the late and corrected ones."""
    releases = snapshots(table(spark, root, "tag_status"))
    closes = F.lead("finished_at").over(Window.orderBy("snapshot"))  # one row per release
    releases = releases.select("tag", "snapshot", closes.alias("closes"))
    changes = (
        table(spark, root, "deprecation_record")
        .select(
            reading.tag("tag").alias("tag"),
            reading.symbol_fqn("symbol_fqn").alias("entity"),
            F.col("loaded_at").alias("recorded_at"),
            reading.deprecated_in("deprecated_in").alias("deprecated_in"),
            reading.version("first_version_seen").alias("first_version_seen"),
        )
        .join(releases, "tag")
        .withColumnRenamed("snapshot", "period")
    )
    late = F.coalesce(F.col("recorded_at") >= F.col("closes"), F.lit(False))
    attributes = ["deprecated_in", "first_version_seen"]
    read = materialise(changes.select("entity", "period", "recorded_at", *attributes, late.alias("late")), "symbol-deliveries")
    store = EntityHistory(spark, work_path(spark, "symbol-history"), attributes)
    store.deliver(read.filter(~F.col("late")))
    store.deliver(read.filter("late"))
    return store.chains()


@REGISTRY.add(
    "p1_found",
    f"""
WITH snap AS ({sql_snapshots()}),
raw AS (
    SELECT {reading.sql_symbol_fqn('symbol_fqn')} AS fqn, {reading.sql_tag('tag')} AS tag, loaded_at,
           {reading.sql_deprecated_in('deprecated_in')} AS d, {reading.sql_version('first_version_seen')} AS f
    FROM deprecation_record),
one AS (
    SELECT fqn, snapshot, d, f FROM raw JOIN snap USING (tag) WHERE fqn IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY fqn, snapshot ORDER BY loaded_at DESC NULLS LAST,
                               d DESC NULLS LAST, f DESC NULLS LAST) = 1),
filled AS (
    SELECT fqn, snapshot, last_value(d IGNORE NULLS) OVER w AS d, last_value(f IGNORE NULLS) OVER w AS f FROM one
    WINDOW w AS (PARTITION BY fqn ORDER BY snapshot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
runs AS (
    SELECT *, CASE WHEN lag(snapshot) OVER w = snapshot - 1 AND lag(d) OVER w IS NOT DISTINCT FROM d
                    AND lag(f) OVER w IS NOT DISTINCT FROM f THEN 0 ELSE 1 END AS starts FROM filled
    WINDOW w AS (PARTITION BY fqn ORDER BY snapshot)),
numbered AS (
    SELECT *, sum(starts) OVER (PARTITION BY fqn ORDER BY snapshot ROWS UNBOUNDED PRECEDING) AS run FROM runs),
spans AS (SELECT fqn, run, min(snapshot) AS a, max(snapshot) AS b FROM numbered GROUP BY ALL)
SELECT fqn AS symbol_fqn, sa.tag AS valid_from, sb.tag AS valid_to
FROM spans JOIN snap sa ON sa.snapshot = a JOIN snap sb ON sb.snapshot = b
""",
)
def p1_found(spark: SparkSession, root: str) -> DataFrame:
    releases = snapshots(table(spark, root, "tag_status")).select("snapshot", "tag")
    chains = symbol_history(spark, root).select("entity", "valid_from", "valid_to")
    for end in ("valid_from", "valid_to"):
        tags = releases.select(F.col("snapshot").alias(end), F.col("tag").alias(f"{end}_tag"))
        chains = chains.join(tags, end)
    return chains.select(
        F.col("entity").alias("symbol_fqn"),
        F.col("valid_from_tag").alias("valid_from"),
        F.col("valid_to_tag").alias("valid_to"),
    )


@REGISTRY.add(
    "p4_found",
    f"""
WITH snap AS ({sql_snapshots()}),
sets AS (
    SELECT snapshot, {reading.sql_file_path('file_path')} AS file_path,
           list_sort(list(DISTINCT {reading.sql_content_sha('content_sha')})) AS shas
    FROM chunk_index c JOIN snap ON snap.tag = {reading.sql_tag('c.tag')}
    WHERE {reading.sql_file_path('file_path')} IS NOT NULL AND {reading.sql_content_sha('content_sha')} IS NOT NULL
    GROUP BY ALL),
pairs AS (
    SELECT coalesce(n.snapshot, o.snapshot + 1) AS snapshot, coalesce(n.file_path, o.file_path) AS file_path,
           CASE WHEN o.file_path IS NULL THEN 'added' WHEN n.file_path IS NULL THEN 'removed'
                WHEN n.shas <> o.shas THEN 'changed' END AS change
    FROM sets n FULL JOIN sets o ON o.snapshot = n.snapshot - 1 AND o.file_path = n.file_path)
SELECT tag, file_path, change FROM pairs JOIN snap USING (snapshot) WHERE snapshot > 1 AND change IS NOT NULL
""",
)
def p4_found(spark: SparkSession, root: str) -> DataFrame:
    releases = snapshots(table(spark, root, "tag_status")).select("tag", "snapshot")
    rows = (
        table(spark, root, "chunk_index")
        .select(
            reading.tag("tag").alias("tag"),
            reading.file_path("file_path").alias("key"),
            reading.content_sha("content_sha").alias("value"),
        )
        .join(releases, "tag")
        .select("snapshot", "key", "value")
    )
    changes = snapshot_changes(rows, releases)
    return changes.join(releases, "snapshot").select("tag", F.col("key").alias("file_path"), "change")

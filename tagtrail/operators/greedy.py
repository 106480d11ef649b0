"""Rows accepted one after another, decided in parallel rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrail.plans.work import materialise


def first_accepted(rows: DataFrame, keys: DataFrame, heard: DataFrame) -> DataFrame:
    """(row_id) of rows (row_id, rank): a row is accepted if no accepted row of a lesser rank has a key it hears.

    ``keys``: (row_id, key) each row has; ``heard``: (row_id, rank, key) it hears. A round decides
    every row without an undecided earlier one on its keys; rounds are as many as the longest
    chain. Keys are aggregated before the shuffle, so a key of a great share of all rows is one row
    per task. Ranks are distinct and not null.
    """
    state = rows.select("row_id", "rank", F.lit(0).alias("verdict"))  # 1 accepted, 2 not
    while True:
        holders = keys.join(state.filter("verdict < 2").select("row_id", "rank", "verdict"), "row_id").groupBy("key").agg(
            F.min(F.when(F.col("verdict") == 1, F.col("rank"))).alias("sure"),
            F.min(F.when(F.col("verdict") == 0, F.col("rank"))).alias("open"),
        )
        waiting = heard.join(state.filter("verdict = 0").select("row_id"), "row_id", "left_semi")
        verdicts = waiting.join(holders, "key").groupBy("row_id").agg(
            F.coalesce(F.bool_or(F.col("sure") < F.col("rank")), F.lit(False)).alias("repeats"),
            F.coalesce(F.bool_or(F.col("open") < F.col("rank")), F.lit(False)).alias("waits"),
        )
        decided = F.when(F.col("verdict") > 0, F.col("verdict")).when(F.col("repeats"), 2).when(F.col("waits"), 0).otherwise(1)
        state = materialise(
            state.join(verdicts, "row_id", "left").select("row_id", "rank", decided.alias("verdict")), "verdicts"
        )
        if state.filter("verdict = 0").isEmpty():
            return state.filter("verdict = 1").select("row_id")

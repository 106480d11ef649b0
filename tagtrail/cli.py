"""Command line: ``python -m tagtrail.cli --store DIR <command>``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tagtrail.api import Tools
from tagtrail.functions.embedding import hashing_embedder
from tagtrail.operators import caching
from tagtrail.plans.ingest import ingest
from tagtrail.plans.registry import ship
from tagtrail.sources import tree
from tagtrail.sources.store import Store


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tagtrail")
    parser.add_argument("--store", required=True, help="folder of the index")
    parser.add_argument("--dim", type=int, default=768, help="length of vectors")
    commands = parser.add_subparsers(dest="command", required=True)
    run = commands.add_parser("ingest", help="take in landed releases")
    run.add_argument("tree", help="folder of <tag>/<path>")
    run.add_argument("--tags", default="v6.*")
    run.add_argument("--dry-run", action="store_true", help="only list what would be taken in")
    commands.add_parser("status", help="releases taken in")
    commands.add_parser("warm-cache", help="fill the vector cache from stored chunks")
    tags = commands.add_parser("tags", help="releases of a landed tree, in order")
    tags.add_argument("tree")
    tags.add_argument("--tags", default="v6.*")
    query = commands.add_parser("query", help="nearest chunks of a question")
    query.add_argument("text")
    query.add_argument("--area", default="core")
    query.add_argument("--version")
    query.add_argument("--limit", type=int, default=8)
    given = parser.parse_args(args)

    spark = spark or SparkSession.builder.appName("tagtrail").getOrCreate()
    ship(spark)
    store, embedder = Store(spark, given.store), hashing_embedder(given.dim)
    if given.command in ("ingest", "tags"):
        files = tree.landed(spark, given.tree)
        wanted = tree.tags(files, given.tags)
    if given.command == "tags":
        wanted.show(1000, False)
    elif given.command == "ingest":
        todo = caching.pending_tags(wanted, store.tag_summary())
        if given.dry_run:
            todo.show(1000, False)
        else:
            ingest(files.join(todo, "tag", "left_semi"), store, embedder).orderBy("version", "area").show(1000, False)
    elif given.command == "status":
        summary = store.tag_summary()
        summary.show(1000, False)
        summary.agg(F.count("*").alias("tags"), F.sum("chunk_count").alias("chunks")).show()
        caching.cache_statistics(store.read("vector_cache")).show()
    elif given.command == "warm-cache":
        store.warm_cache()
    else:
        tools = Tools(store.chunks(), spark.createDataFrame([], "tag string, file_path string, content string"), embedder)
        answer = tools.search(given.area, given.text, given.version, limit=given.limit)
        for hit in answer["hits"] if isinstance(answer, dict) else [answer]:
            print(hit)


if __name__ == "__main__":
    main()

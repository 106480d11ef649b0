"""How queries are registered: by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_PACKAGE = Path(__file__).resolve().parent.parent
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that its functions load there."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    file = Path(tempfile.mkdtemp(prefix="tagtrail-")) / f"{_PACKAGE.name}.zip"
    with zipfile.ZipFile(file, "w") as out:
        for path in sorted(_PACKAGE.rglob("*.py")):
            out.write(path, path.relative_to(_PACKAGE.parent))
    context.addPyFile(str(file))  # served to the executors by the driver


@dataclass
class Registry:
    queries: dict[str, Query] = field(default_factory=dict)
    sql: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, sql: str | None = None) -> Callable[[Query], Query]:
        def register(query: Query) -> Query:
            @wraps(query)
            def shipped(spark: SparkSession, root: str) -> DataFrame:
                ship(spark)
                return query(spark, root)

            self.queries[name] = shipped
            if sql is not None:
                self.sql[name] = sql
            return query

        return register

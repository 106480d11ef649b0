"""The ten questions an index answers, as dictionaries ready for JSON.

Everything up to the bounded answer runs in Spark; only its rows, at most the limit asked for, are
collected here.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagtrail.functions import embedding, routing, versions
from tagtrail.operators import analytics, search


def _rows(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in df.collect()]


def _bounded(limit: int, most: int) -> int:
    if not 1 <= limit <= most:
        raise ValueError(f"limit must be from 1 to {most}")
    return limit


class Tools:
    """Answers over a table of chunks with vectors, and one of files (tag, file_path, content)."""

    #: The names of the tools; the keys of their answers below are fixed too.
    AREAS = {
        "search_core": "core", "search_storefront": "storefront", "search_administration": "administration",
        "search_checkout": "checkout", "search_flow_builder": "flow", "search_changes": "changes",
    }

    def __init__(self, chunks: DataFrame, files: DataFrame, embedder: embedding.Embedder):
        self.chunks, self.files, self.embedder = chunks, files, embedder

    def call(self, tool: str, **args: Any) -> dict[str, Any] | str:
        if tool in self.AREAS:
            return self.search(self.AREAS[tool], **args)
        known: dict[str, Callable] = {
            "find_deprecations": self.find_deprecations, "find_css_class": self.find_css_class,
            "upgrade_path": self.upgrade_path, "why_changed": self.why_changed,
        }
        if tool not in known:
            raise ValueError(f"unknown tool: {tool}")
        return known[tool](**args)

    def call_json(self, tool: str, **args: Any) -> str:
        answer = self.call(tool, **args)
        return answer if isinstance(answer, str) else json.dumps(answer, indent=2, ensure_ascii=False)

    def search(self, area: str, query: str, version: str | None = None, language: str | None = None, limit: int = 10) -> dict | str:
        vector = embedding.embed_one(query, self.embedder)
        found = search.search(self.chunks, vector, _bounded(limit, 50), area=area, version=version, language=language)
        hits = _rows(found.drop("point_id"))
        if not hits:
            return f"No matches for: {query!r}"
        return {"query": query, "version_filter": version, "language_filter": language, "collection": area, "hits": hits}

    def find_deprecations(self, pattern: str | None = None, area: str | None = None, limit: int = 50) -> dict:
        found = analytics.deprecations(self.chunks, pattern, area).orderBy("deprecated_in", "symbol_fqn").limit(_bounded(limit, 200))
        rows = _rows(found)
        return {"pattern": pattern, "area": area, "count": len(rows), "deprecations": rows}

    def find_css_class(self, class_name: str, version: str | None = None, limit: int = 30) -> dict:
        found = analytics.css_class(self.chunks, class_name, version, _bounded(limit, 200))
        rows = _rows(found.orderBy("kind", analytics.area_rank(), "point_id").drop("point_id"))
        kinds = {k: [{x: r[x] for x in r if x != "kind"} for r in rows if r["kind"] == k] for k in ("definition", "usage")}
        return {"class_name": class_name.lstrip("."), "version_filter": version, "definitions": kinds["definition"], "usages": kinds["usage"]}

    def upgrade_path(self, from_version: str, to_version: str, areas: list[str] | None = None, limit_per_section: int = 50) -> dict:
        low, high = versions.parsed(from_version), versions.parsed(to_version)
        head = {"from_version": from_version, "to_version": to_version}
        if not low or not high or low >= high:
            return head | {"error": "invalid version range", "sections": {}}
        found = analytics.upgrade_path(self.chunks, from_version, to_version, areas, _bounded(limit_per_section, 200))
        sections: dict[str, list] = {}
        for r in _rows(found.orderBy("section_rank", "section", "place")):
            sections.setdefault(r["section"], []).append({k: v for k, v in r.items() if k not in ("section_rank", "place")})
        asked = sorted({a.lower() for a in areas}) if areas else None
        return head | {"areas_filter": asked, "total_entries": sum(map(len, sections.values())), "sections": sections}

    def why_changed(self, file_path: str, from_version: str, to_version: str) -> dict:
        at = lambda v: self.files.filter((F.col("tag") == f"v{v}") & (F.col("file_path") == file_path)).select(
            "file_path", F.make_valid_utf8(F.col("content").cast("string")).alias("content")
        )
        changes = _rows(analytics.file_changes(at(from_version), at(to_version)))
        related = _rows(analytics.related_changelog(self.chunks, file_path, from_version, to_version))
        row = changes[0] if changes else {
            "language": None, "exists_before": False, "exists_after": False, "added": [], "removed": [], "changed": [], "new_deprecations": [],
        }
        if not changes:
            row["language"] = self.chunks.sparkSession.range(1).select(routing.diff_language(F.lit(file_path))).first()[0]
        return {
            "file_path": file_path, "from_version": from_version, "to_version": to_version,
            "file_exists_from": row["exists_before"], "file_exists_to": row["exists_after"], "language": row["language"],
            "structural_diff": {k: row[k] for k in ("added", "removed", "changed")}, "new_deprecations": row["new_deprecations"],
            "related_changelog_entries": related,
        }

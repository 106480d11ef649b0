"""The analytical queries over chunks: deprecations, CSS classes, upgrade stories, changes of files.

Where an answer depends on the order in which rows are met, that order is (area, point_id), with
areas in the order of :data:`tagtrail.functions.routing.CODE_AREAS`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.functions import routing, versions
from tagtrail.functions import text as T
from tagtrail.operators.greedy import first_accepted
from tagtrail.plans.work import materialise


def area_rank(area: Column | str = "area") -> Column:
    at = F.array_position(F.array(*map(F.lit, routing.CODE_AREAS)), F.col(area) if isinstance(area, str) else area)
    return F.when(at > 0, at).otherwise(len(routing.CODE_AREAS) + 1).cast("int")


def scan_order() -> Column:
    """Where a row stands in the order rows are met in."""
    return F.struct(area_rank().alias("area_rank"), F.col("point_id"))


def deprecations(chunks: DataFrame, pattern: str | None = None, area: str | None = None, numeric: bool = False) -> DataFrame:
    """One row per deprecated symbol: what its first row says, and the first and last version it was seen in.

    Versions compare as strings unless ``numeric``. An area that holds no code stands for all. A
    pattern is looked for in full and short names, letter case aside.
    """
    areas = [area] if area in routing.CODE_AREAS else list(routing.CODE_AREAS)
    fqn = F.coalesce(F.nullif("symbol_fqn", F.lit("")), F.nullif("symbol_name", F.lit("")))
    rows = chunks.filter(F.col("deprecated_in").isNotNull() & F.col("area").isin(areas)).withColumn("fqn", fqn).filter("fqn is not null")
    if pattern:
        wanted = F.lit(pattern.lower())
        rows = rows.filter(F.contains(F.lower("fqn"), wanted) | F.coalesce(F.contains(F.lower("symbol_name"), wanted), F.lit(False)))
    version = F.nullif("version", F.lit(""))
    rank = F.struct(versions.version_tuple("version").alias("t"), version.alias("v")) if numeric else version
    said = F.struct(
        "symbol_name", "symbol_kind", "deprecated_in", "file_path", "area", "language", F.left("content", F.lit(300)).alias("snippet")
    )
    return (
        rows.groupBy("fqn")
        .agg(
            F.min(F.struct(area_rank().alias("a"), F.col("point_id"), said.alias("said")))["said"].alias("said"),  # ties: lesser values
            F.min_by(version, rank).alias("a"), F.max_by(version, rank).alias("b"),
        )
        .select(
            F.col("fqn").alias("symbol_fqn"), "said.symbol_name", "said.symbol_kind", "said.deprecated_in", "said.file_path",
            "said.area", "said.language", F.col("a").alias("first_version_seen"), F.col("b").alias("last_version_seen"), "said.snippet",
        )
    )


#: Areas in which CSS classes are looked for.
CSS_AREAS = ("storefront", "administration", "checkout", "flow")


def css_class(chunks: DataFrame, class_name: str, version: str | None = None, limit: int | None = None) -> DataFrame:
    """Where a class is defined (in its style sheets' class lists) and used (its name in a template's text); ``limit`` per kind."""
    needle = F.lit(class_name.lstrip("."))
    rows = chunks.filter(F.col("area").isin(*CSS_AREAS) & F.col("language").isin("scss", "twig"))
    if version:
        rows = rows.filter(F.col("version") == version)
    kind = F.when((F.col("language") == "scss") & F.array_contains("css_classes", needle), "definition").when(
        (F.col("language") == "twig") & F.contains("content", needle), "usage"
    )
    found = rows.select(
        kind.alias("kind"), needle.alias("class_name"), "file_path", "version", "area", "language",
        T.snippet("content", 400).alias("snippet"), "point_id", scan_order().alias("at"),
    ).filter("kind is not null")
    if limit is not None:
        found = found.withColumn("n", F.row_number().over(Window.partitionBy("kind").orderBy("at"))).filter(F.col("n") <= limit).drop("n")
    return found.drop("at")


def css_usage(chunks: DataFrame) -> DataFrame:
    """(class_name, defined, used): for every class of the style sheets, files that define it and templates that name it as a word.

    The search by class turned into joins for all classes: both sides are exploded and grouped.
    """
    rows = chunks.filter(F.col("area").isin(*CSS_AREAS))
    defined = rows.filter("language = 'scss'").select("file_path", F.explode("css_classes").alias("class_name"))
    named = T.found("content", r"[A-Za-z_][A-Za-z0-9_-]*", 0)
    used = rows.filter("language = 'twig'").select("file_path", F.explode(F.array_distinct(named)).alias("class_name"))
    per = lambda df, name: df.distinct().groupBy("class_name").agg(F.count("*").alias(name))
    return per(defined, "defined").join(per(used, "used"), "class_name", "left").fillna(0, ["used"])


def upgrade_path(
    chunks: DataFrame, low: str, high: str, sections: Sequence[str] | None = None, limit: int | None = 50, keep_sections: bool = False
) -> DataFrame:
    """Entries that lead from ``low`` (exclusive) to ``high``, by section: (section, place, target_version, title, issue, ...).

    An entry is left out if one met before has its issue, or its file and section; with
    ``keep_sections`` only the latter. Repeated rows of one entry (file, section and point_id) are
    one: that with the least version, title, issue, kind and content, nulls first. No rows for a
    range that is none.
    """
    section = F.coalesce(F.nullif(F.lower("section"), F.lit("")), F.lit("general"))
    rows = chunks.filter((F.col("area") == "changes") & versions.after_up_to(F.col("target_version"), low, high))
    a, b = versions.parsed(low), versions.parsed(high)
    if not a or not b or a >= b:
        rows = rows.filter(F.lit(False))
    rows = rows.select(
        section.alias("section"), "target_version", "issue", "file_path", "symbol_kind", "content", "point_id",
        F.coalesce(F.nullif("symbol_name", F.lit("")), F.lit("(untitled)")).alias("title"),
    )
    if sections:
        rows = rows.filter(F.col("section").isin([s.lower() for s in sections]))
    same = Window.partitionBy("file_path", "section", "point_id").orderBy(
        versions.version_tuple("target_version"), "target_version", "title", "issue", "symbol_kind", "content"
    )
    rows = rows.withColumn("n", F.row_number().over(same)).filter("n = 1").drop("n")
    in_order = Window.partitionBy("file_path", "section").orderBy("point_id")
    of_file = rows.withColumn("n", F.row_number().over(in_order))
    if keep_sections:
        kept = of_file.filter("n = 1").drop("n")
    else:
        met = materialise(rows.withColumn("rank", F.struct("point_id", "section", "file_path")).withColumn("row_id", F.xxhash64("point_id", "section", "file_path")), "entries")
        key = F.array_compact(F.array(
            F.concat(F.lit("i:"), F.nullif("issue", F.lit(""))), F.concat(F.lit("f:"), F.coalesce("file_path", F.lit("")), F.lit("::"), F.col("section"))
        ))
        keys = met.select("row_id", "rank", F.explode(key).alias("key"))
        kept = met.join(first_accepted(met.select("row_id", "rank"), keys.select("row_id", "key"), keys), "row_id", "left_semi").drop("row_id", "rank")
    place = Window.partitionBy("section").orderBy(versions.version_tuple("target_version"), "title", "point_id")
    ranked = kept.withColumn("place", F.row_number().over(place))
    if limit is not None:
        ranked = ranked.filter(F.col("place") <= limit)
    return ranked.select(
        "section", T.section_rank("section").alias("section_rank"), "place", "target_version", "title", "issue",
        F.col("file_path").alias("changelog_path"), F.col("symbol_kind").alias("kind"), T.snippet("content", 500).alias("snippet"),
    )


def _names(content: Column) -> Column:
    """What of a file's structure is compared, by language: (names, methods with parameters, types)."""
    none = F.array().cast("array<string>")
    names = F.when(F.col("language") == "twig", T.name_set(content, T.TWIG_BLOCK)).when(
        F.col("language").isin("scss", "vue"), T.css_classes(content)
    ).otherwise(none)
    methods = F.when(F.col("language") == "php", T.php_methods(content)).otherwise(F.create_map().cast("map<string,string>"))
    types = F.when(F.col("language") == "php", T.name_set(content, T.PHP_TYPE)).otherwise(none)
    return F.struct(names.alias("names"), methods.alias("methods"), types.alias("types"), T.name_set_whole(content).alias("deprecations"))


def file_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """For every path in either of two versions (file_path, content): whether it is there, and what of its structure changed.

    One full join by path. Names are listed by code point, methods before types.
    """
    old = before.select("file_path", F.col("content").alias("a"), F.lit(True).alias("in_a"))
    new = after.select("file_path", F.col("content").alias("b"), F.lit(True).alias("in_b"))
    both = old.join(new, "file_path", "full_outer").select(
        "file_path", routing.diff_language("file_path").alias("language"), F.coalesce("in_a", F.lit(False)).alias("exists_before"),
        F.coalesce("in_b", F.lit(False)).alias("exists_after"), F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"),
    )
    read = both.withColumns({"x": _names(F.col("a")), "y": _names(F.col("b"))})
    less = lambda p, q: F.array_sort(F.array_except(p, q))
    mx, my = F.map_keys("x.methods"), F.map_keys("y.methods")
    changed = F.filter(
        F.array_intersect(mx, my), lambda n: F.try_element_at("x.methods", n) != F.try_element_at("y.methods", n)
    )
    return read.select(
        "file_path", "language", "exists_before", "exists_after",
        F.concat(less(F.col("y.names"), F.col("x.names")), less(my, mx), less(F.col("y.types"), F.col("x.types"))).alias("added"),
        F.concat(less(F.col("x.names"), F.col("y.names")), less(mx, my), less(F.col("x.types"), F.col("y.types"))).alias("removed"),
        F.array_sort(changed).alias("changed"),
        less(F.col("y.deprecations"), F.col("x.deprecations")).alias("new_deprecations"),
    )


def _symbols(rows: DataFrame) -> DataFrame:
    """(file_path, part, name, params) of rows (file_path, content, at): what the texts declare; of two methods the later counts."""
    part = lambda kind, names: F.transform(names, lambda n: F.struct(F.lit(kind).alias("part"), n.alias("name"), F.lit(None).cast("string").alias("params")))
    none = F.array().cast("array<struct<part:string,name:string,params:string>>")
    kind = routing.diff_language("file_path")
    methods = F.transform(
        F.map_entries(T.php_methods("content")), lambda e: F.struct(F.lit("method").alias("part"), e["key"].alias("name"), e["value"].alias("params"))
    )
    every = F.concat(
        F.when(kind == "twig", part("block", T.name_set("content", T.TWIG_BLOCK)))
        .when(kind.isin("scss", "vue"), part("class", T.css_classes("content")))
        .when(kind == "php", F.concat(methods, part("type", T.name_set("content", T.PHP_TYPE)))).otherwise(none),
        part("deprecation", T.name_set_whole("content")),
    )
    found = rows.select("file_path", "at", F.explode(every).alias("s")).select("file_path", "at", "s.*")
    return found.groupBy("file_path", "part", "name").agg(F.max_by("params", F.struct("at", "params")).alias("params"))


def symbol_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file_path, part, name, change) between two versions given as texts of parts of files (file_path, content, at).

    As :func:`file_changes`, for whole trees: names are exploded before they are compared, so no
    file has to fit in a row, however many parts it has.
    """
    old = _symbols(before).select("file_path", "part", "name", F.col("params").alias("p"), F.lit(True).alias("x"))
    new = _symbols(after).select("file_path", "part", "name", F.col("params").alias("q"), F.lit(True).alias("y"))
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("p") != F.col("q"), "changed")
    return old.join(new, ["file_path", "part", "name"], "full_outer").select(
        "file_path", "part", "name", change.alias("change")
    ).filter("change is not null")


def needles(path: Column | str) -> Column:
    """What is looked for in changelogs: a path, and its last part if that has 8 characters or more and a dot."""
    last = T.basename(path)
    long = (F.char_length(last) >= 8) & F.contains(last, F.lit("."))
    return F.when(long, F.array_distinct(F.array(F.col(path) if isinstance(path, str) else path, last))).otherwise(F.array(path))


def related_changelog(chunks: DataFrame, path: str, low: str, high: str, limit: int = 10) -> DataFrame:
    """The first changelog entries between two versions (as strings) that name a file, one per changelog file."""
    last = path.rsplit("/", 1)[-1]
    wanted = [path, last] if len(last) >= 8 and "." in last and last != path else [path]
    named = F.contains("content", F.lit(wanted[0]))
    for w in wanted[1:]:
        named = named | F.contains("content", F.lit(w))
    rows = chunks.filter((F.col("area") == "changes") & versions.after_up_to(F.col("target_version"), low, high, numeric=False) & named)
    first = Window.partitionBy("file_path").orderBy("point_id")
    return (
        rows.withColumn("n", F.row_number().over(first)).filter("n = 1").orderBy("point_id").limit(limit)
        .select(
            "target_version", F.col("symbol_name").alias("title"),
            F.coalesce(F.nullif(F.lower("section"), F.lit("")), F.col("symbol_kind")).alias("section"), "issue",
            F.col("file_path").alias("changelog_path"), T.snippet("content", 400).alias("snippet"),
        )
    )


def changelog_mentions(chunks: DataFrame, paths: DataFrame) -> DataFrame:
    """(file_path, changelog_path, target_version): for all paths, the changelog files that name them.

    Texts are cut into words that may be paths, and each word into what stands behind each of its
    slashes too, so a path is found behind any folder; the search is an equality join instead of a
    comparison of every text with every path. A path that stands in the middle of a longer name
    (``XFoo.php`` for ``Foo.php``) is not taken as named.
    """
    word = F.explode(F.array_distinct(T.found("content", r"[\w./-]*\w", 0))).alias("word")
    words = chunks.filter("area = 'changes'").select(F.col("file_path").alias("changelog_path"), "target_version", word)
    parts = F.split("word", "/")
    behind = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    said = words.select("changelog_path", "target_version", F.explode(behind).alias("needle")).filter("needle <> ''").distinct()
    wanted = paths.select("file_path").distinct().select("file_path", F.explode(needles("file_path")).alias("needle"))
    return wanted.join(said, "needle").select("file_path", "changelog_path", "target_version").distinct()

"""Queries over the code and changelog index, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tagtrail.functions import embedding, reading, routing, versions
from tagtrail.functions import text as T
from tagtrail.operators import analytics, caching, search
from tagtrail.operators.chunking import chunk_files, point_id
from tagtrail.plans.registry import Registry
from tagtrail.sources.tables import table

REGISTRY = Registry()

def _sql_area(path: str) -> str:
    bare = f"regexp_replace(regexp_replace({path}, '^[./]+', ''), '/(\\.?/)+', '/', 'g')"
    whens = []
    for name, prefixes, parts in routing.AREA_RULES:
        tests = [f"starts_with({bare}, '{p}')" for p in prefixes] + [f"contains({bare}, '{p}')" for p in parts]
        whens.append(f"WHEN {' OR '.join(tests)} THEN '{name}'")
    return f"CASE WHEN {path} IS NULL THEN '{routing.OTHER}' {' '.join(whens)} ELSE '{routing.OTHER}' END"


def _sql_language(path: str) -> str:
    suffix = f"regexp_extract(lower(regexp_extract({path}, '[^/]*$', 0)), '^.+\\.([^.]+)$', 1)"
    return f"CASE {suffix} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in routing.LANGUAGES.items()) + " END"


def _sql_candidate(path: str) -> str:
    slashed = f"replace({path}, '\\', '/')"
    folders = ", ".join(f"'{f}'" for f in routing.SKIPPED_FOLDERS)
    parts = " ".join(f"AND NOT contains({slashed}, '{p}')" for p in routing.SKIPPED_PARTS)
    return f"({_sql_language(path)} IS NOT NULL AND NOT list_has_any(string_split({slashed}, '/'), [{folders}]) {parts})"


def _sql_rank(area: str = "area") -> str:
    return f"coalesce(nullif(list_position([{', '.join(repr(a) for a in routing.CODE_AREAS)}], {area}), 0), {len(routing.CODE_AREAS) + 1})"


def _sql_tuple(v: str) -> str:
    return f"list_transform(string_split({v}, '.'), lambda p: CAST(p AS INTEGER))"


def _sql_number(v: str) -> str:
    """A version of up to four parts as one number."""
    return "(" + " + ".join(f"coalesce(({v})[{i}], 0) * {10 ** (16 - 4 * i)}" for i in (1, 2, 3, 4)) + ")"


@REGISTRY.add(
    "tag_order",
    r"""
WITH t AS (SELECT tag, regexp_full_match(tag, 'v\d+\.\d+\.\d+\.\d+') AS ok, string_split(substr(tag, 2), '.') AS p FROM tag_status)
SELECT tag, regexp_full_match(tag, 'v6\.[4567]\.\d+\.\d+') AS stable,
       row_number() OVER (ORDER BY CASE WHEN ok THEN CAST(p[1] AS INT) ELSE 0 END, CASE WHEN ok THEN CAST(p[2] AS INT) ELSE 0 END,
                          CASE WHEN ok THEN CAST(p[3] AS INT) ELSE 0 END, CASE WHEN ok THEN CAST(p[4] AS INT) ELSE 0 END, tag) AS place
FROM t
""",
)
def tag_order(spark: SparkSession, root: str) -> DataFrame:
    """Releases in numeric order (one row per release, so one ordered partition)."""
    place = F.row_number().over(Window.orderBy(versions.tag_order("tag"), "tag"))
    return table(spark, root, "tag_status").select("tag", versions.is_stable("tag").alias("stable"), place.alias("place"))


@REGISTRY.add(
    "tag_summary", "SELECT tag, sha, finished_at IS NOT NULL AS done, chunk_count FROM tag_status"
)
def tag_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "tag_status").select(
        "tag", "sha", F.col("finished_at").isNotNull().alias("done"), "chunk_count"
    ).orderBy("tag")


@REGISTRY.add(
    "area_routes",
    f"""
SELECT {_sql_area('file_path')} AS area, {_sql_language('file_path')} AS language, {_sql_candidate('file_path')} AS indexed,
       count(*) AS n_rows, count(DISTINCT file_path) AS n_files
FROM chunk_index WHERE file_path IS NOT NULL GROUP BY ALL
""",
)
def area_routes(spark: SparkSession, root: str) -> DataFrame:
    """How paths are routed: by area, language and whether they are indexed."""
    per_file = table(spark, root, "chunk_index").filter("file_path is not null").groupBy("file_path").agg(F.count("*").alias("n"))
    return per_file.groupBy(
        routing.area("file_path").alias("area"), routing.language("file_path").alias("language"),
        routing.is_candidate("file_path").alias("indexed"),
    ).agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_files"))


@REGISTRY.add(
    "content_sha",
    "SELECT sha256(text) AS content_sha, count(*) AS n, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1",
)
def content_sha(spark: SparkSession, root: str) -> DataFrame:
    """Documents by content."""
    docs = table(spark, root, "documents").filter("text is not null").select(T.sha("text").alias("content_sha"), "doc_id")
    return docs.groupBy("content_sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))


def _sql_deprecations(where: str = "", numeric: bool = False) -> str:
    order = ", ".join(
        f"{c} NULLS FIRST"
        for c in (_sql_rank(), "point_id", "symbol_name", "symbol_kind", "deprecated_in", "file_path", "area", "language", "left(content, 300)")
    )
    areas = ", ".join(repr(a) for a in routing.CODE_AREAS)
    low = f"arg_min(version, {_sql_tuple('version')})" if numeric else "min(version)"
    high = f"arg_max(version, {_sql_tuple('version')})" if numeric else "max(version)"
    return f"""
WITH r AS (
    SELECT *, coalesce(nullif(symbol_fqn, ''), nullif(symbol_name, '')) AS fqn FROM chunks
    WHERE deprecated_in IS NOT NULL AND area IN ({areas})),
k AS (SELECT * FROM r WHERE fqn IS NOT NULL {where}),
f AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY fqn ORDER BY {order}) = 1),
v AS (SELECT fqn, {low} AS a, {high} AS b FROM k WHERE version <> '' GROUP BY fqn)
SELECT fqn AS symbol_fqn, symbol_name, symbol_kind, deprecated_in, file_path, area, language,
       v.a AS first_version_seen, v.b AS last_version_seen, left(content, 300) AS snippet FROM f LEFT JOIN v USING (fqn)
"""


@REGISTRY.add("deprecations", _sql_deprecations())
def deprecations(spark: SparkSession, root: str) -> DataFrame:
    return analytics.deprecations(table(spark, root, "chunks"))


@REGISTRY.add("deprecations_numeric", _sql_deprecations(numeric=True))
def deprecations_numeric(spark: SparkSession, root: str) -> DataFrame:
    """Versions compared by number."""
    return analytics.deprecations(table(spark, root, "chunks"), numeric=True)


@REGISTRY.add(
    "deprecations_pattern",
    _sql_deprecations("AND (contains(lower(fqn), 'cart') OR coalesce(contains(lower(symbol_name), 'cart'), false))"),
)
def deprecations_pattern(spark: SparkSession, root: str) -> DataFrame:
    return analytics.deprecations(table(spark, root, "chunks"), pattern="Cart")


_SQL_CSS = "list_sort(list_distinct(regexp_extract_all(text, '\\.([A-Za-z_][A-Za-z0-9_-]*)[\\t-\\r\\x{85}\\p{Z}]*[,{:]', 1)))"


@REGISTRY.add(
    "css_classes",
    f"SELECT doc_id, array_to_string({_SQL_CSS}, ' ') AS classes FROM documents WHERE kind = 'scss' AND text IS NOT NULL",
)
def css_classes(spark: SparkSession, root: str) -> DataFrame:
    """Class names of every style sheet."""
    docs = table(spark, root, "documents").filter("kind = 'scss' and text is not null")
    return docs.select("doc_id", F.array_join(T.css_classes("text"), " ").alias("classes"))


_SQL_CSS_AREAS = ", ".join(repr(a) for a in analytics.CSS_AREAS)


@REGISTRY.add(
    "css_class",
    f"""
SELECT CASE language WHEN 'scss' THEN 'definition' ELSE 'usage' END AS kind, 'cart-item' AS class_name, file_path, version, area, language,
       left(content, 400) || CASE WHEN length(content) > 400 THEN '…' ELSE '' END AS snippet, point_id
FROM chunks WHERE area IN ({_SQL_CSS_AREAS})
  AND (language = 'scss' AND list_contains(css_classes, 'cart') OR language = 'twig' AND contains(content, 'cart'))
""".replace("'cart-item'", "'cart'"),
)
def css_class(spark: SparkSession, root: str) -> DataFrame:
    """Definitions and usages of one class."""
    return analytics.css_class(table(spark, root, "chunks"), ".cart")


@REGISTRY.add(
    "css_class_chosen",
    f"""
WITH k AS (
    SELECT CASE language WHEN 'scss' THEN 'definition' ELSE 'usage' END AS kind, file_path, area, point_id, {_sql_rank()} AS seen,
           left(content, 400) || CASE WHEN length(content) > 400 THEN '…' ELSE '' END AS snippet
    FROM (SELECT DISTINCT * FROM chunks) WHERE area IN ({_SQL_CSS_AREAS}) AND version = '6.4.2.0'
      AND (language = 'scss' AND list_contains(css_classes, 'cart') OR language = 'twig' AND contains(content, 'cart')))
SELECT kind, point_id, file_path, area, snippet FROM k QUALIFY row_number() OVER (PARTITION BY kind ORDER BY seen, point_id) <= 5
""",
)
def css_class_chosen(spark: SparkSession, root: str) -> DataFrame:
    """The first five definitions and usages of a class in one release."""
    found = analytics.css_class(table(spark, root, "chunks").distinct(), ".cart", version="6.4.2.0", limit=5)
    return found.select("kind", "point_id", "file_path", "area", "snippet")


@REGISTRY.add(
    "css_usage",
    f"""
WITH d AS (SELECT DISTINCT file_path, unnest(css_classes) AS class_name FROM chunks WHERE area IN ({_SQL_CSS_AREAS}) AND language = 'scss'),
u AS (SELECT DISTINCT file_path, unnest(regexp_extract_all(content, '[A-Za-z_][A-Za-z0-9_-]*')) AS class_name FROM chunks
      WHERE area IN ({_SQL_CSS_AREAS}) AND language = 'twig'),
dn AS (SELECT class_name, count(*) AS defined FROM d GROUP BY 1), un AS (SELECT class_name, count(*) AS used FROM u GROUP BY 1)
SELECT class_name, defined, coalesce(used, 0) AS used FROM dn LEFT JOIN un USING (class_name)
""",
)
def css_usage(spark: SparkSession, root: str) -> DataFrame:
    return analytics.css_usage(table(spark, root, "chunks"))


_LOW, _HIGH = "6.4.10.0", "6.7.8.0"


def _sql_entries() -> str:
    """Entries of the upgrade story, one for each file, section and point."""
    order = "v NULLS FIRST, target_version NULLS FIRST, title NULLS FIRST, issue NULLS FIRST, symbol_kind NULLS FIRST, content NULLS FIRST"
    return f"""
e AS (
    SELECT coalesce(nullif(lower(section), ''), 'general') AS section, target_version, issue, file_path, symbol_kind, content, point_id,
           coalesce(nullif(symbol_name, ''), '(untitled)') AS title, {_sql_tuple('target_version')} AS v
    FROM chunks WHERE area = 'changes' AND target_version IS NOT NULL AND regexp_full_match(target_version, '\\d+(\\.\\d+)*')),
r AS (SELECT * FROM e WHERE {_sql_number('v')} > {_sql_number(_sql_tuple(repr(_LOW)))} AND {_sql_number('v')} <= {_sql_number(_sql_tuple(repr(_HIGH)))}
      QUALIFY row_number() OVER (PARTITION BY file_path, section, point_id ORDER BY {order}) = 1)"""


def _sql_story(rows: str, most: int) -> str:
    return f"""
SELECT section, coalesce(nullif(list_position([{', '.join(repr(s) for s in T.SECTIONS)}], section), 0) - 1, {len(T.SECTIONS)}) AS section_rank,
       row_number() OVER (PARTITION BY section ORDER BY v, title, point_id) AS place, target_version, title, issue,
       file_path AS changelog_path, symbol_kind AS kind, left(content, 500) || CASE WHEN length(content) > 500 THEN '…' ELSE '' END AS snippet
FROM {rows} QUALIFY place <= {most}"""


@REGISTRY.add(
    "upgrade_path",
    f"""
WITH RECURSIVE {_sql_entries()},
o AS (SELECT *, row_number() OVER (ORDER BY point_id, section, file_path) AS i, nullif(issue, '') AS ik, coalesce(file_path, '') || '::' || section AS fk FROM r),
g AS (
    SELECT CAST(0 AS BIGINT) AS i, CAST([] AS VARCHAR[]) AS files, CAST([] AS VARCHAR[]) AS issues, false AS taken
    UNION ALL
    SELECT i, CASE WHEN taken THEN list_append(files, fk) ELSE files END,
           CASE WHEN taken AND ik IS NOT NULL THEN list_append(issues, ik) ELSE issues END, taken
    FROM (SELECT o.i, fk, ik, files, issues, NOT (list_contains(files, fk) OR coalesce(list_contains(issues, ik), false)) AS taken FROM g JOIN o ON o.i = g.i + 1)),
k AS (SELECT o.* FROM o JOIN g USING (i) WHERE g.taken)
{_sql_story('k', 50)}
""",
)
def upgrade_path(spark: SparkSession, root: str) -> DataFrame:
    return analytics.upgrade_path(table(spark, root, "chunks"), _LOW, _HIGH)


@REGISTRY.add(
    "upgrade_path_chosen",
    f"""
WITH {_sql_entries()},
k AS (SELECT * FROM r WHERE section IN ('core', 'api', 'storefront') QUALIFY row_number() OVER (PARTITION BY file_path, section ORDER BY point_id) = 1)
{_sql_story('k', 3)}
""",
)
def upgrade_path_chosen(spark: SparkSession, root: str) -> DataFrame:
    """The upgrade story of some sections, three entries of each."""
    return analytics.upgrade_path(
        table(spark, root, "chunks"), _LOW, _HIGH, sections=["Core", "API", "storefront"], limit=3, keep_sections=True
    )


@REGISTRY.add(
    "upgrade_path_sections",
    f"""
WITH r AS (
    SELECT coalesce(nullif(lower(section), ''), 'general') AS section, target_version, issue, file_path, symbol_kind, content, point_id,
           coalesce(nullif(symbol_name, ''), '(untitled)') AS title, {_sql_tuple('target_version')} AS v
    FROM chunks WHERE area = 'changes' AND target_version IS NOT NULL AND regexp_full_match(target_version, '\\d+(\\.\\d+)*')),
k AS (SELECT * FROM r WHERE {_sql_number('v')} > {_sql_number(_sql_tuple(repr(_LOW)))} AND {_sql_number('v')} <= {_sql_number(_sql_tuple(repr(_HIGH)))}
      QUALIFY row_number() OVER (PARTITION BY file_path, section ORDER BY point_id) = 1)
SELECT section, coalesce(nullif(list_position([{', '.join(repr(s) for s in T.SECTIONS)}], section), 0) - 1, {len(T.SECTIONS)}) AS section_rank,
       row_number() OVER (PARTITION BY section ORDER BY v, title, point_id) AS place, target_version, title, issue,
       file_path AS changelog_path, symbol_kind AS kind, left(content, 500) || CASE WHEN length(content) > 500 THEN '…' ELSE '' END AS snippet
FROM k QUALIFY place <= 50
""",
)
def upgrade_path_sections(spark: SparkSession, root: str) -> DataFrame:
    """The upgrade story with every section an entry has."""
    return analytics.upgrade_path(table(spark, root, "chunks"), _LOW, _HIGH, keep_sections=True)


_BEFORE, _AFTER = "v6.5.12.1", "v6.6.8.1"


def _texts_at(spark: SparkSession, root: str, tag: str) -> DataFrame:
    """(file_path, content, at) of all chunks of a release, contents looked up by checksum."""
    held = table(spark, root, "chunk_index").filter(reading.tag("tag") == tag).select(
        reading.file_path("file_path").alias("file_path"), reading.content_sha("content_sha").alias("content_sha")
    ).filter("file_path is not null and content_sha is not null").distinct()
    texts = table(spark, root, "chunks").select(reading.content_sha("content_sha").alias("content_sha"), "content")
    texts = texts.filter("content_sha is not null and content is not null").groupBy("content_sha").agg(F.min("content").alias("content"))
    return held.join(texts, "content_sha").select("file_path", "content", F.col("content_sha").alias("at"))


_SQL_METHOD = T.PHP_METHOD.replace("(?dmU)", "(?m)")
_SQL_TYPE = T.PHP_TYPE.replace("(?dmU)", "(?m)")


def _sql_symbols(tag: str) -> str:
    return f"""
    SELECT file_path, part, name, arg_max(params, {{'sha': sha, 'i': i}}) AS params FROM (
        SELECT file_path, sha, 0 AS i, NULL AS params, 'block' AS part,
               unnest(regexp_extract_all(content, '{{%\\s*block\\s+([A-Za-z0-9_]+)\\s*%}}', 1)) AS name FROM at_{tag} WHERE regexp_matches(file_path, '\\.twig$')
        UNION ALL
        SELECT file_path, sha, 0, NULL, 'class', unnest(regexp_extract_all(content, '\\.([A-Za-z_][A-Za-z0-9_-]*)[\\t-\\r\\x{{85}}\\p{{Z}}]*[,{{:]', 1))
        FROM at_{tag} WHERE regexp_matches(file_path, '\\.(scss|css|vue)$')
        UNION ALL
        SELECT file_path, sha, unnest(range(len(m))), unnest(p), 'method', unnest(m) FROM (
            SELECT *, regexp_extract_all(content, '{_SQL_METHOD}', 1) AS m,
                   [trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in regexp_extract_all(content, '{_SQL_METHOD}', 2)] AS p
            FROM at_{tag} WHERE regexp_matches(file_path, '\\.php$'))
        UNION ALL
        SELECT file_path, sha, 0, NULL, 'type', unnest(regexp_extract_all(content, '{_SQL_TYPE}', 1)) FROM at_{tag} WHERE regexp_matches(file_path, '\\.php$')
        UNION ALL
        SELECT file_path, sha, 0, NULL, 'deprecation', unnest(regexp_extract_all(content, '@deprecated\\s+tag:v6\\.\\d+\\.\\d+(?:\\.\\d+)?')) FROM at_{tag})
    GROUP BY ALL"""


def _sql_texts(name: str, tag: str) -> str:
    return f"""at_{name} AS (
    SELECT DISTINCT {reading.sql_file_path('i.file_path')} AS file_path, t.sha, t.content
    FROM chunk_index i JOIN txt t ON t.sha = {reading.sql_content_sha('i.content_sha')}
    WHERE {reading.sql_tag('i.tag')} = '{tag}' AND {reading.sql_file_path('i.file_path')} IS NOT NULL)"""


@REGISTRY.add(
    "symbol_changes",
    f"""
WITH txt AS (SELECT {reading.sql_content_sha('content_sha')} AS sha, min(content) AS content FROM chunks WHERE content IS NOT NULL GROUP BY 1),
{_sql_texts('a', _BEFORE)}, {_sql_texts('b', _AFTER)},
a AS ({_sql_symbols('a')}), b AS ({_sql_symbols('b')}),
j AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.part, b.part) AS part, coalesce(a.name, b.name) AS name,
             CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.params <> b.params THEN 'changed' END AS change
      FROM a FULL JOIN b ON a.file_path = b.file_path AND a.part = b.part AND a.name = b.name)
SELECT * FROM j WHERE change IS NOT NULL
""",
)
def symbol_changes(spark: SparkSession, root: str) -> DataFrame:
    """What the files of two releases declare that differs."""
    return analytics.symbol_changes(_texts_at(spark, root, _BEFORE), _texts_at(spark, root, _AFTER))


def _sql_joined(part: str, change: str) -> str:
    return f"coalesce(string_agg(name, ' ' ORDER BY CASE part WHEN 'method' THEN 1 WHEN 'type' THEN 2 ELSE 0 END, name) FILTER (WHERE change = '{change}' AND part {part} 'deprecation'), '')"


@REGISTRY.add(
    "file_changes",
    f"""
WITH txt AS (SELECT {reading.sql_content_sha('content_sha')} AS sha, min(content) AS content FROM chunks WHERE content IS NOT NULL GROUP BY 1),
{_sql_texts('all_a', _BEFORE)}, {_sql_texts('all_b', _AFTER)},
at_a AS (SELECT file_path, '' AS sha, min(content) AS content FROM at_all_a GROUP BY 1), at_b AS (SELECT file_path, '' AS sha, min(content) AS content FROM at_all_b GROUP BY 1),
a AS ({_sql_symbols('a')}), b AS ({_sql_symbols('b')}),
j AS (SELECT coalesce(a.file_path, b.file_path) AS file_path, coalesce(a.part, b.part) AS part, coalesce(a.name, b.name) AS name,
             CASE WHEN a.name IS NULL THEN 'added' WHEN b.name IS NULL THEN 'removed' WHEN a.params <> b.params THEN 'changed' END AS change
      FROM a FULL JOIN b ON a.file_path = b.file_path AND a.part = b.part AND a.name = b.name),
f AS (SELECT coalesce(x.file_path, y.file_path) AS file_path, x.file_path IS NOT NULL AS exists_before, y.file_path IS NOT NULL AS exists_after
      FROM at_a x FULL JOIN at_b y ON x.file_path = y.file_path)
SELECT file_path, exists_before, exists_after, {_sql_joined('<>', 'added')} AS added, {_sql_joined('<>', 'removed')} AS removed,
       {_sql_joined('<>', 'changed')} AS changed, {_sql_joined('=', 'added')} AS new_deprecations
FROM f LEFT JOIN j USING (file_path) GROUP BY file_path, exists_before, exists_after
""",
)
def file_changes(spark: SparkSession, root: str) -> DataFrame:
    """The report of every file of two releases; of a file's chunks the least text stands for the file."""
    one = lambda tag: _texts_at(spark, root, tag).groupBy("file_path").agg(F.min("content").alias("content"))
    found = analytics.file_changes(one(_BEFORE), one(_AFTER))
    lists = ("added", "removed", "changed", "new_deprecations")
    return found.select("file_path", "exists_before", "exists_after", *[F.array_join(c, " ").alias(c) for c in lists])


_NAMED = "snippet/route.license"


@REGISTRY.add(
    "related_changelog",
    f"""
WITH k AS (
    SELECT * FROM chunks WHERE area = 'changes' AND target_version > '6.4.0.0' AND target_version <= '6.7.9.9' AND (contains(content, '{_NAMED}') OR contains(content, '{_NAMED.rsplit("/", 1)[-1]}'))
    QUALIFY row_number() OVER (PARTITION BY file_path ORDER BY point_id) = 1)
SELECT target_version, symbol_name AS title, coalesce(nullif(lower(section), ''), symbol_kind) AS section, issue, file_path AS changelog_path,
       left(content, 400) || CASE WHEN length(content) > 400 THEN '…' ELSE '' END AS snippet
FROM k ORDER BY point_id LIMIT 10
""",
)
def related_changelog(spark: SparkSession, root: str) -> DataFrame:
    """The first ten entries that name a file or its last part, in a range of versions compared as strings."""
    return analytics.related_changelog(table(spark, root, "chunks"), _NAMED, "6.4.0.0", "6.7.9.9")


_SQL_WORD = "[A-Za-z0-9_./-]*[A-Za-z0-9_]"


@REGISTRY.add(
    "changelog_mentions",
    f"""
WITH p AS (SELECT DISTINCT unnest(regexp_extract_all(content, '[a-z]+[./][a-z.]*[a-z]')) AS file_path FROM chunks WHERE area <> 'changes'),
wanted AS (
    SELECT file_path, file_path AS needle FROM p
    UNION SELECT file_path, regexp_extract(file_path, '[^/]*$') FROM p WHERE length(regexp_extract(file_path, '[^/]*$')) >= 8 AND contains(regexp_extract(file_path, '[^/]*$'), '.')),
w AS (SELECT DISTINCT file_path AS changelog_path, target_version, string_split(unnest(regexp_extract_all(content, '{_SQL_WORD}')), '/') AS parts FROM chunks WHERE area = 'changes'),
said AS (SELECT changelog_path, target_version, array_to_string(parts[i:], '/') AS needle FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM w))
SELECT DISTINCT file_path, changelog_path, target_version FROM wanted JOIN said USING (needle)
""",
)
def changelog_mentions(spark: SparkSession, root: str) -> DataFrame:
    """Which changelog files name what reads like a path or a dotted name in the code."""
    chunks = table(spark, root, "chunks")
    named = chunks.filter("area <> 'changes'").select(F.explode(T.found("content", r"[a-z]+[./][a-z.]*[a-z]", 0)).alias("file_path"))
    return analytics.changelog_mentions(chunks, named.distinct())


_SQL_COS = "list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[]))"


@REGISTRY.add(
    "top_k",
    f"""
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({_SQL_COS.format(a='embedding', b='e')}, 6) AS score FROM embeddings, q ORDER BY {_SQL_COS.format(a='embedding', b='e')} DESC, vec_id LIMIT 10
""",
)
def top_k(spark: SparkSession, root: str) -> DataFrame:
    """The ten vectors most similar to the first."""
    points = table(spark, root, "embeddings")
    query = points.agg(F.min_by("embedding", "vec_id")).first()[0]
    return search.top_k(points, query, 10, "embedding", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@REGISTRY.add(
    "top_k_filtered",
    f"""
WITH q AS (SELECT embedding AS e FROM embeddings ORDER BY vec_id LIMIT 1)
SELECT vec_id, round({_SQL_COS.format(a='embedding', b='e')}, 6) AS score FROM embeddings, q WHERE label = 3
ORDER BY {_SQL_COS.format(a='embedding', b='e')} DESC, vec_id LIMIT 10
""",
)
def top_k_filtered(spark: SparkSession, root: str) -> DataFrame:
    points = table(spark, root, "embeddings")
    query = points.agg(F.min_by("embedding", "vec_id")).first()[0]
    chosen = points.filter("label = 3")
    return search.top_k(chosen, query, 10, "embedding", "vec_id").select("vec_id", F.round("score", 6).alias("score"))


@REGISTRY.add(
    "top_k_of_each",
    f"""
WITH q AS (SELECT vec_id AS q, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT q, vec_id, {_SQL_COS.format(a='embedding', b='e')} AS score FROM embeddings, q)
SELECT q, vec_id, round(score, 5) AS score, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, vec_id) AS rank FROM s QUALIFY rank <= 5
""",
)
def top_k_of_each(spark: SparkSession, root: str) -> DataFrame:
    """The five vectors most similar to each of the stated queries, every twentieth id, among all."""
    points = table(spark, root, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked = points.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("q"), "vector")
    return search.top_k_of_each(points, asked, 5, 64, key="vec_id").withColumn("score", F.round("score", 5))


def _first_vectors(spark: SparkSession, root: str) -> DataFrame:
    """(content_sha, vector, cached_at): the first vector written for each content."""
    cache = table(spark, root, "vector_cache").select(reading.content_sha("content_sha").alias("content_sha"), "vector", "cached_at")
    cache = cache.filter("content_sha is not null")
    return caching.first_of_each(cache, ["content_sha"], [F.col("cached_at").asc_nulls_last(), F.col("vector").asc_nulls_last()])


_SQL_CACHE = f"""
first_vec AS (SELECT {reading.sql_content_sha('content_sha')} AS content_sha, vector, cached_at FROM vector_cache
    WHERE {reading.sql_content_sha('content_sha')} IS NOT NULL
    QUALIFY row_number() OVER (PARTITION BY {reading.sql_content_sha('content_sha')} ORDER BY cached_at NULLS LAST, vector NULLS LAST) = 1)"""


@REGISTRY.add(
    "search_changes",
    f"""
WITH {_SQL_CACHE},
pts AS (SELECT DISTINCT c.point_id, c.file_path, c.symbol_name, c.content, v.vector FROM chunks c
        JOIN first_vec v ON v.content_sha = {reading.sql_content_sha('c.content_sha')} WHERE area = 'changes' AND len(v.vector) = 64),
q AS (SELECT vector AS e FROM first_vec WHERE len(vector) = 64 AND {_SQL_COS.format(a='vector', b='vector')} > 0.5 ORDER BY content_sha LIMIT 1),
s AS (SELECT point_id, file_path, symbol_name, content, {_SQL_COS.format(a='vector', b='e')} AS score FROM pts, q),
t AS (SELECT * FROM s WHERE score IS NOT NULL AND NOT isnan(score) ORDER BY score DESC, point_id LIMIT 40),
d AS (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY
        coalesce(nullif(regexp_extract(file_path, 'release-([^/]*)', 1), ''), file_path), symbol_name, regexp_extract(file_path, '[^/]*$', 0), left(content, 120)
        ORDER BY score DESC, point_id) = 1)
SELECT point_id, round(score, 4) AS score FROM d ORDER BY d.score DESC, point_id LIMIT 10
""",
)
def search_changes(spark: SparkSession, root: str) -> DataFrame:
    """A search of the changelog: over-fetch, drop repeated entries, cut."""
    vectors = _first_vectors(spark, root).filter(F.size("vector") == 64)
    chunks = table(spark, root, "chunks").withColumn("content_sha", reading.content_sha("content_sha"))
    own = T.cosine("vector", "vector")
    query = vectors.filter(own > 0.5).orderBy("content_sha").select("vector").first()
    points = caching.with_vectors(chunks.filter("area = 'changes'"), vectors).filter("vector is not null")
    points = caching.first_of_each(points, ["point_id"], [F.col(c).asc_nulls_first() for c in ("content_sha", "file_path", "symbol_name", "content")])
    points = points.filter(~F.exists("vector", lambda x: F.isnan(x)))
    return search.search(points, query[0], 10, area="changes").select("point_id", "score")


@REGISTRY.add(
    "cached_vectors",
    f"""
WITH {_SQL_CACHE},
c AS (SELECT DISTINCT point_id, area, {reading.sql_content_sha('content_sha')} AS content_sha FROM chunks)
SELECT area, count(*) AS n_chunks, count(v.content_sha) AS n_known, count(*) - count(v.content_sha) AS n_new
FROM c LEFT JOIN first_vec v USING (content_sha) GROUP BY area
""",
)
def cached_vectors(spark: SparkSession, root: str) -> DataFrame:
    """By area, how many chunks have a vector already."""
    chunks = table(spark, root, "chunks").select("point_id", "area", reading.content_sha("content_sha").alias("content_sha")).distinct()
    known = _first_vectors(spark, root).select("content_sha", F.lit(True).alias("vector"))
    joined = caching.with_vectors(chunks, known)
    return joined.groupBy("area").agg(
        F.count("*").alias("n_chunks"), F.count("vector").alias("n_known"), F.sum(F.col("vector").isNull().cast("int")).alias("n_new")
    )


@REGISTRY.add(
    "cache_misses",
    f"""
SELECT DISTINCT {reading.sql_content_sha('content_sha')} AS content_sha FROM chunks WHERE content_sha IS NOT NULL
EXCEPT SELECT {reading.sql_content_sha('content_sha')} FROM vector_cache
""",
)
def cache_misses(spark: SparkSession, root: str) -> DataFrame:
    """Contents that would have to be embedded."""
    sha = reading.content_sha("content_sha").alias("content_sha")
    return caching.unknown(
        table(spark, root, "chunks").select(sha).filter("content_sha is not null").distinct(),
        table(spark, root, "vector_cache").select(sha), ["content_sha"],
    )


@REGISTRY.add(
    "pending_tags",
    f"""
SELECT DISTINCT {reading.sql_tag('tag')} AS tag FROM chunk_index WHERE {reading.sql_tag('tag')} IS NOT NULL
EXCEPT SELECT {reading.sql_tag('tag')} FROM tag_status WHERE finished_at IS NOT NULL
""",
)
def pending_tags(spark: SparkSession, root: str) -> DataFrame:
    """Tags that hold chunks but never ended."""
    seen = table(spark, root, "chunk_index").select(reading.tag("tag").alias("tag")).filter("tag is not null").distinct()
    done = table(spark, root, "tag_status").select(reading.tag("tag").alias("tag"), "finished_at")
    return caching.pending_tags(seen, done)


@REGISTRY.add(
    "backfill",
    f"""
WITH {_SQL_CACHE},
i AS (SELECT DISTINCT point_id, {reading.sql_content_sha('content_sha')} AS content_sha FROM chunk_index),
p AS (SELECT c.point_id, v.vector FROM chunks c JOIN first_vec v ON v.content_sha = {reading.sql_content_sha('c.content_sha')} WHERE v.vector IS NOT NULL)
SELECT i.content_sha, count(DISTINCT p.point_id) AS n_points FROM p JOIN i USING (point_id)
WHERE i.content_sha IS NOT NULL AND i.content_sha NOT IN (SELECT content_sha FROM first_vec WHERE cached_at < TIMESTAMP '2023-01-01')
GROUP BY 1
""",
)
def backfill(spark: SparkSession, root: str) -> DataFrame:
    """Contents whose vector an older cache would get from the stored points, and of how many points each."""
    vectors = _first_vectors(spark, root)
    chunks = table(spark, root, "chunks").select("point_id", reading.content_sha("content_sha").alias("content_sha"))
    points = chunks.join(vectors.filter("vector is not null"), "content_sha").groupBy("point_id").agg(F.min("vector").alias("vector"))
    index = table(spark, root, "chunk_index").select("point_id", reading.content_sha("content_sha").alias("content_sha")).distinct()
    older = vectors.filter("cached_at < timestamp '2023-01-01'")
    filled = caching.backfill(points, index, older).select("content_sha")
    counts = points.join(index, "point_id").groupBy("content_sha").agg(F.countDistinct("point_id").alias("n_points"))
    return filled.join(counts, "content_sha")


@REGISTRY.add(
    "cache_statistics",
    "SELECT count(*) AS vectors, CAST(coalesce(sum(len(vector) * 4), 0) AS BIGINT) AS bytes FROM vector_cache",
)
def cache_statistics(spark: SparkSession, root: str) -> DataFrame:
    return caching.cache_statistics(table(spark, root, "vector_cache"))


@REGISTRY.add(
    "chunk_counts",
    "SELECT area, language, symbol_kind, count(*) AS n, CAST(sum(length(content)) AS BIGINT) AS n_chars FROM chunks GROUP BY ALL",
)
def chunk_counts(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunks").groupBy("area", "language", "symbol_kind").agg(
        F.count("*").alias("n"), F.sum(F.char_length("content")).alias("n_chars")
    )


_SQL_INDEX = f"""(SELECT point_id, {reading.sql_tag('tag')} AS tag, {reading.sql_file_path('file_path')} AS file_path,
    {reading.sql_content_sha('content_sha')} AS content_sha, epoch_us(recorded_at) AS recorded_us FROM chunk_index)"""


def _index(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "chunk_index").select(
        "point_id", reading.tag("tag").alias("tag"), reading.file_path("file_path").alias("file_path"),
        reading.content_sha("content_sha").alias("content_sha"), F.unix_micros("recorded_at").alias("recorded_us"),
    )


_ORDER = ["recorded_us", "tag", "file_path", "content_sha"]


@REGISTRY.add(
    "first_recorded",
    f"""SELECT * FROM {_SQL_INDEX} QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY
    recorded_us NULLS FIRST, tag NULLS FIRST, file_path NULLS FIRST, content_sha NULLS FIRST) = 1""",
)
def first_recorded(spark: SparkSession, root: str) -> DataFrame:
    """Points as first written: later writes of an id are ignored."""
    return caching.first_of_each(_index(spark, root), ["point_id"], [F.col(c).asc_nulls_first() for c in _ORDER])


@REGISTRY.add(
    "last_upserted",
    f"""SELECT * FROM {_SQL_INDEX} QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY
    recorded_us DESC NULLS LAST, tag DESC NULLS LAST, file_path DESC NULLS LAST, content_sha DESC NULLS LAST) = 1""",
)
def last_upserted(spark: SparkSession, root: str) -> DataFrame:
    """Points as last written."""
    return caching.last_of_each(_index(spark, root), ["point_id"], [F.col(c) for c in _ORDER])


@REGISTRY.add(
    "first_last_seen",
    f"""
SELECT file_path, min(tag) AS first_tag, max(tag) AS last_tag, count(DISTINCT tag) AS n_tags, count(DISTINCT content_sha) AS n_contents
FROM {_SQL_INDEX} WHERE file_path IS NOT NULL AND tag IS NOT NULL GROUP BY file_path
""",
)
def first_last_seen(spark: SparkSession, root: str) -> DataFrame:
    """First and last release of every file, as strings."""
    rows = _index(spark, root).filter("file_path is not null and tag is not null")
    tags = rows.select("file_path", "tag").distinct().groupBy("file_path").agg(
        F.min("tag").alias("first_tag"), F.max("tag").alias("last_tag"), F.count("*").alias("n_tags")
    )
    contents = rows.select("file_path", "content_sha").distinct().groupBy("file_path").agg(F.count("content_sha").alias("n_contents"))
    return tags.join(contents, "file_path")


@REGISTRY.add(
    "embedding_text",
    """
WITH c AS (SELECT point_id, language, file_path, content, coalesce(nullif(symbol_fqn, ''), nullif(symbol_name, '')) AS named FROM chunks)
SELECT point_id, sha256(CASE WHEN language = 'markdown' THEN content WHEN named IS NULL THEN file_path || chr(10) || content
       WHEN contains(left(content, 200), named) THEN content ELSE named || chr(10) || content END) AS text_sha FROM c
""",
)
def embedding_text(spark: SparkSession, root: str) -> DataFrame:
    text = T.embedding_text("language", "symbol_fqn", "symbol_name", "file_path", "content")
    return table(spark, root, "chunks").select("point_id", T.sha(text).alias("text_sha"))


def _files(spark: SparkSession, root: str) -> DataFrame:
    """(version, file_path, area, language, content, notes) of all documents, by their kind, or by their path where none is given.

    Documents lie in no area of the source tree; all count as ``core``.
    """
    docs = table(spark, root, "documents").select(
        F.regexp_replace(reading.version("version"), "^v", "").alias("version"), reading.file_path("file_path").alias("file_path"),
        F.nullif(F.lower(F.btrim("kind", F.lit(reading.BLANKS))), F.lit("")).alias("kind"), F.col("text").alias("content"),
    )
    of_path = F.when(F.col("file_path").rlike(r"(^|/)changelog/"), "changelog").when(
        F.col("file_path").rlike(r"(^|/)(upgrade/|UPGRADE-)"), "upgrade"
    )
    by_path = routing.language("file_path")
    notes = F.when(F.col("kind").isNotNull(), F.col("kind")).when(by_path == "markdown", of_path)
    by_kind = F.when(F.col("kind") == "script", "ts").when(F.col("kind").isin("changelog", "upgrade"), "markdown").otherwise(F.col("kind"))
    return docs.select("version", "file_path", F.lit("core").alias("area"), F.coalesce(by_kind, by_path).alias("language"), "content", notes.alias("notes"))


@REGISTRY.add("chunk_documents")
def chunk_documents(spark: SparkSession, root: str) -> DataFrame:
    """All documents cut into chunks. Guides, issue reports and other documents without a chunker give none."""
    return chunk_files(_files(spark, root), notes=F.col("notes"))


_SQL_FILES = f"""
d AS (SELECT {reading.sql_file_path('file_path')} AS file_path, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS content,
             coalesce(nullif(trim(lower(kind)), ''), CASE WHEN file_path LIKE '%.scss' THEN 'scss' WHEN file_path LIKE '%.ts' THEN 'script' WHEN regexp_matches(file_path, '\\.html\\.twig$') THEN 'twig'
                 WHEN regexp_matches(file_path, '(^|/)changelog/.*\\.md$') THEN 'changelog' END) AS kind
      FROM documents WHERE text IS NOT NULL)"""
_SHOWN = ("file_path", "chunk_idx", "symbol_kind", "symbol_name", "start_line", "end_line", "content_sha")


@REGISTRY.add(
    "chunk_scss",
    f"""
WITH {_SQL_FILES}
SELECT file_path, 0 AS chunk_idx, 'file' AS symbol_kind, regexp_extract(file_path, '[^/]*$') AS symbol_name, 1 AS start_line,
       1 + length(content) - length(replace(content, chr(10), '')) AS end_line, sha256(left(content, 2000)) AS content_sha,
       array_to_string(list_sort(list_distinct(regexp_extract_all(content, '\\.([A-Za-z_][A-Za-z0-9_-]*)[\\t-\\r\\x{{85}}\\p{{Z}}]*[,{{:]', 1)))[1:200], ' ') AS classes
FROM d WHERE kind = 'scss' AND regexp_matches(content, '[^\\t-\\r\\x1c-\\x1f\\x{{85}}\\p{{Z}}]')
""",
)
def chunk_scss(spark: SparkSession, root: str) -> DataFrame:
    """Style sheets: one chunk a file, with its classes."""
    found = chunk_files(_files(spark, root).filter("language = 'scss'"), ids=False, notes=F.col("notes"))
    return found.select(*_SHOWN, F.array_join("css_classes", " ").alias("classes"))


@REGISTRY.add(
    "chunk_script",
    f"""
WITH {_SQL_FILES},
l AS (SELECT file_path, content, unnest(range(1, len(string_split(content, chr(10))) + 1)) AS n, unnest(string_split(content, chr(10))) AS line FROM d WHERE kind = 'script'),
h AS (SELECT *, regexp_matches(line, '^(export[\\t-\\r ]+(default[\\t-\\r ]+)?)?(abstract[\\t-\\r ]+)?(class|interface|function|const|enum|type)[\\t-\\r ]+[A-Za-z_$]') AS opens FROM l),
g AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY file_path ORDER BY n) AS i, count(*) OVER (PARTITION BY file_path) AS lines,
             sum(CAST(opens AS INT)) OVER (PARTITION BY file_path) AS parts FROM h),
c AS (SELECT file_path, CAST(i - 1 AS INT) AS chunk_idx, min(n) AS a, max(n) AS b, any_value(lines) AS lines,
             string_agg(line, chr(10) ORDER BY n) || CASE WHEN max(n) < any_value(lines) THEN chr(10) ELSE '' END AS body, arg_min(line, n) AS head FROM g WHERE i > 0 GROUP BY file_path, i)
SELECT file_path, chunk_idx, 'ts_' || regexp_extract(head, '^(?:export[\\t-\\r ]+(?:default[\\t-\\r ]+)?)?(?:abstract[\\t-\\r ]+)?(class|interface|function|const|enum|type)', 1) AS symbol_kind,
       regexp_extract(head, '(?:class|interface|function|const|enum|type)[\\t-\\r ]+([A-Za-z_$][A-Za-z0-9_$]*)', 1) AS symbol_name, a AS start_line,
       a + length(left(body, length(body) - 1)) - length(replace(left(body, length(body) - 1), chr(10), '')) AS end_line, sha256(left(body, 2000)) AS content_sha FROM c
UNION ALL
SELECT DISTINCT file_path, 0, 'file', regexp_extract(file_path, '[^/]*$'), 1, lines, sha256(left(content, 2000)) FROM g WHERE parts = 0
""",
)
def chunk_script(spark: SparkSession, root: str) -> DataFrame:
    """Scripts: one chunk for each declaration at a line's begin."""
    return chunk_files(_files(spark, root).filter("language = 'ts'"), ids=False, notes=F.col("notes")).select(*_SHOWN)


@REGISTRY.add(
    "chunk_twig_heads",
    f"""
WITH {_SQL_FILES}
SELECT file_path, sha256(left(array_to_string(string_split(content, chr(10))[1:30], chr(10)), 1500)) AS content_sha,
       least(30, 1 + length(content) - length(replace(content, chr(10), ''))) AS end_line,
       nullif(regexp_extract(content, '\\{{%[\\t-\\r ]*(?:sw_extends|extends)[\\t-\\r ]+[''"]([^''"]+)[''"][\\t-\\r ]*%\\}}', 1), '') AS extends_target,
       nullif(regexp_extract(content, '(?i)\\{{#[\\t-\\r ]*@deprecated[\\t-\\r ]+tag:(v6\\.\\d+\\.\\d+(?:\\.\\d+)?)[^#]*#\\}}', 1), '') AS deprecated_in
FROM d WHERE kind = 'twig'
""",
)
def chunk_twig_heads(spark: SparkSession, root: str) -> DataFrame:
    """Templates: the chunk of each file's begin, what it extends and its deprecation."""
    found = chunk_files(_files(spark, root).filter("language = 'twig'"), ids=False, notes=F.col("notes")).filter("symbol_kind = 'file'")
    return found.select("file_path", "content_sha", "end_line", "extends_target", "deprecated_in")


@REGISTRY.add("point_ids")
def point_ids(spark: SparkSession, root: str) -> DataFrame:
    """Stable identifiers of all chunks."""
    return table(spark, root, "chunks").select(
        "point_id", point_id(F.concat(F.lit("v"), F.col("version")), F.col("file_path"), F.col("chunk_idx"), F.col("content_sha")).alias("stable_id")
    )


@REGISTRY.add("embed_search")
def embed_search(spark: SparkSession, root: str) -> DataFrame:
    """Ten chunks nearest to a question, by the embedder that needs no model."""
    embedder = embedding.hashing_embedder(128)
    chunks = table(spark, root, "chunks")
    text = T.embedding_text("language", "symbol_fqn", "symbol_name", "file_path", "content")
    points = chunks.withColumn("vector", embedding.embed(text, embedder))
    query = embedding.embed_one("how is the cart price calculated", embedder)
    return search.hits(search.top_k(points, query, 10))

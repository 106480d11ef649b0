"""Columns derived from texts: snippets, hashes, names found in source text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest content of a chunk, in characters.
MOST = 2000

#: What is looked for in source texts. Java regular expressions; lines end with \n alone.
DEPRECATED = r"@deprecated\s+tag:(v6\.\d+\.\d+(?:\.\d+)?)"
TWIG_DEPRECATED = r"(?i)\{#\s*@deprecated\s+tag:(v6\.\d+\.\d+(?:\.\d+)?)[^#]*#\}"
TWIG_EXTENDS = r"\{%\s*(?:sw_extends|extends)\s+['\"]([^'\"]+)['\"]\s*%\}"
TWIG_BLOCK = r"\{%\s*block\s+([A-Za-z0-9_]+)\s*%\}"
TWIG_END = r"\{%\s*endblock\s*(?:[A-Za-z0-9_]+\s*)?%\}"
CSS_CLASS = r"(?U)\.([A-Za-z_][A-Za-z0-9_-]*)\s*[,{:]"
PHP_METHOD = r"(?dmU)^\s*(?:public|protected|private)?\s*(?:static\s+)?function\s+([A-Za-z_][A-Za-z0-9_]*)\s*\(([^)]*)\)"
PHP_TYPE = r"(?dmU)^(?:final\s+|abstract\s+)?(?:class|interface|trait|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
RELEASE_FOLDER = r"changelog/release-(\d+)-(\d+)-(\d+)-(\d+)/"
#: Sections of an upgrade story, in order.
SECTIONS = (
    "upgrade information", "next major version changes", "core", "api", "administration", "storefront", "general", "intro",
)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often and within whatever lambda it is used.

    The start of a fold over nothing, as that fold's type is known from ``use`` alone: nested
    elements of nested arrays take the analyser twice as long with each level.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda kept, _: kept, use)


def strip(text: Column | str) -> Column:
    """Without surrounding white space of any kind."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def basename(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def snippet(text: Column | str, most: int, mark: str = "…") -> Column:
    """The first ``most`` characters, with a mark if there are more."""
    col = _col(text)
    return F.when(F.char_length(col) > most, F.concat(F.left(col, F.lit(most)), F.lit(mark))).otherwise(col)


def sha(content: Column | str) -> Column:
    return F.sha2(content, 256)


def read_text(raw: Column | str) -> Column:
    """Bytes or text as text with one kind of line end; bytes that are no UTF-8 become the replacement character."""
    return F.regexp_replace(F.make_valid_utf8(_col(raw).cast("string")), r"\r\n?", "\n")


def found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """Every match's group, in order; an empty array without one."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.array().cast("array<string>"))


def first_found(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The first match's group, or null."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def name_set(text: Column | str, pattern: str) -> Column:
    """Distinct names, sorted by code point."""
    return F.array_sort(F.array_distinct(found(text, pattern)))


def last_deprecation(text: Column | str) -> Column:
    return F.try_element_at(found(text, DEPRECATED), F.lit(-1))


def css_classes(text: Column | str) -> Column:
    return name_set(text, CSS_CLASS)


def php_methods(text: Column | str) -> Column:
    """Method name to parameters with single spaces; of two methods of a name the later one counts."""
    names = found(text, PHP_METHOD, 1)
    params = F.transform(found(text, PHP_METHOD, 2), lambda p: strip(F.regexp_replace(p, r"(?U)\s+", " ")))
    both = F.arrays_zip(names.alias("k"), params.alias("v"))
    last = F.filter(
        F.transform(both, lambda x, i: F.struct(x["k"].alias("k"), x["v"].alias("v"), i.alias("i"))),
        lambda x: F.array_position(F.reverse(names), x["k"]) == F.size(names) - x["i"],
    )
    return F.map_from_entries(F.transform(last, lambda x: F.struct(x["k"].alias("key"), x["v"].alias("value"))))


def release_of(path: Column | str) -> Column:
    """What stands between the first ``release-`` and the next slash; empty without one."""
    return F.regexp_extract(path, r"release-([^/]*)", 1)


def target_version(path: Column | str) -> Column:
    """``6.7.2.0`` from a changelog's release folder, or null."""
    bare = first_found(path, r"changelog/release-(\d+-\d+-\d+-\d+)/")
    return F.translate(bare, "-", ".")


def section_rank(section: Column | str) -> Column:
    """The place of a section in an upgrade story; unknown ones come last."""
    at = F.array_position(F.array(*map(F.lit, SECTIONS)), _col(section))
    return F.when(at > 0, at - 1).otherwise(len(SECTIONS)).cast("int")


def embedding_text(language: Column | str, fqn: Column | str, name: Column | str, path: Column | str, content: Column | str) -> Column:
    """What is embedded of a chunk: its content, with its identifier in front where the content's begin lacks it."""
    named = F.coalesce(F.nullif(_col(fqn), F.lit("")), F.nullif(_col(name), F.lit("")))
    body = _col(content)
    return (
        F.when(_col(language) == "markdown", body)
        .when(named.isNull(), F.concat(_col(path), F.lit("\n"), body))
        .when(F.contains(F.left(body, F.lit(200)), named), body)
        .otherwise(F.concat(named, F.lit("\n"), body))
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double precision; null if lengths differ or a vector is all zero."""
    x, y = (F.transform(_col(v), lambda e: e.cast("double")) for v in (a, b))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda i, j: i * j), F.lit(0.0), lambda s, e: s + e)
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when((F.size(x) == F.size(y)) & (norm > 0), dot(x, y) / norm)


def cosine_to(vector: Column | str, query: list[float]) -> Column:
    """As :func:`cosine`, to a stated vector, whose norm is taken once; one pass over each row's vector."""
    values = F.expr("array(" + ", ".join(f"{float(x)!r}D" for x in query) + ")")
    norm = sum(float(x) * float(x) for x in query) ** 0.5
    if not norm:
        return F.lit(None).cast("double")
    both = F.zip_with(_col(vector), values, lambda v, q: F.struct(v.cast("double").alias("v"), q.alias("q")))
    zero = F.struct(F.lit(0.0).alias("dot"), F.lit(0.0).alias("own"))
    sums = F.aggregate(both, zero, lambda s, e: F.struct((s["dot"] + e["v"] * e["q"]).alias("dot"), (s["own"] + e["v"] * e["v"]).alias("own")))
    folded = F.transform(F.array(sums), lambda s: F.when(s["own"] > 0, s["dot"] / (F.sqrt(s["own"]) * F.lit(norm))))[0]
    return F.when(F.size(_col(vector)) == len(query), folded)


def name_set_whole(text: Column | str) -> Column:
    """Distinct deprecation marks as written, sorted."""
    return F.array_sort(F.array_distinct(found(text, DEPRECATED, 0)))

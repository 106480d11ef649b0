"""Files cut into symbol-level chunks.

All languages but PHP are cut by column expressions, in the scan's stage: a text is split in front
of its headers or around its marks, and line numbers follow from sums of the pieces' line ends, so
the work grows with the text alone; what is used twice is bound first. PHP needs a scanner that
knows strings and nesting, so its files go through one Arrow-batched function. Content is cut at
2,000 characters.

Input: (version, file_path, area, language, content), see :mod:`tagtrail.sources.tree`. Files of
area ``other``, without language, without a chunker (yaml, markdown that is neither changelog nor
upgrade notes) and without content give no chunks.

Two corners are read line by line where a matcher over the whole text would differ: a declaration
whose keywords stand on several lines begins at the line of its last keyword, and a bare ``##`` is
a header only with text behind it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagtrail.functions import text as T
from tagtrail.functions import versions
from tagtrail.functions.code_text import closing, masked, php_pieces, without_attributes

#: Columns of a chunk beside those of its file, with their types.
FIELDS = {
    "symbol_kind": "string", "symbol_name": "string", "symbol_fqn": "string", "deprecated_in": "string",
    "start_line": "int", "end_line": "int", "content": "string", "target_version": "string", "section": "string",
    "issue": "string", "author": "string", "flag": "string", "title": "string", "class_name": "string",
    "css_classes": "array<string>", "extends_target": "string",
}
_STRUCT = "struct<" + ",".join(f"{k}:{v}" for k, v in FIELDS.items()) + ">"
_RUN = 256  # values that are summed one after another

#: What opens declarations, sections, releases and entries.
_DECLARATION = r"^(?:export\s+(?:default\s+)?)?(?:abstract\s+)?(class|interface|function|const|enum|type)\s+([A-Za-z_$][A-Za-z0-9_$]*)"
_VUE_SECTION = r"(?s)<(template|script|style)(\s+[^>]*)?>(.*?)</\1>"
_FRONT = r"(?ds)\A---\s*\n(.*?)\n---\s*\n"
_SECTION = r"^# ([A-Za-z][\w\s-]*)$"
_RELEASE = r"^# (\d+\.\d+\.\d+\.\d+)\s*$"
_SUB = r"^##\s+(.+)$"


def _chunk(**values: Column) -> Column:
    def field(key: str, kind: str) -> Column:
        if key not in values:
            return F.expr(f"CAST({"''" if key == 'symbol_fqn' else 'NULL'} AS {kind}) AS {key}")
        given = F.left(values[key], F.lit(T.MOST)) if key == "content" else values[key]
        return given.cast(kind).alias(key)

    return F.struct(*[field(*f) for f in FIELDS.items()])


def _none() -> Column:
    return F.array().cast(f"array<{_STRUCT}>")


def line_ends(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit("\n"), F.lit("")))


def running(values: Column, zero: Column, join: Callable[[Column, Column], Column]) -> Column:
    """What ``join``, which is associative, makes of ``zero`` and all values before each one.

    Sums of blocks of ``_RUN`` values are put in front of the sums within them, so that no long
    array is copied for each of its values.
    """
    onto = lambda acc, x: F.array_append(acc, join(F.element_at(acc, -1), x))
    last = (F.greatest(F.size(values), F.lit(1)) - 1) / _RUN
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last).cast("int")), lambda b: F.slice(values, b * _RUN + 1, _RUN))

    def joined(within: Column) -> Column:
        before = F.aggregate(F.transform(within, lambda w: F.element_at(w, -1)), F.array(zero), onto)
        return T.once(before, lambda base: F.flatten(F.transform(
            within, lambda w, i: F.transform(F.slice(w, 1, F.size(w) - 1), lambda x: join(base[i], x))
        )))

    return T.once(F.transform(blocks, lambda b: F.aggregate(b, F.array(zero), onto)), joined)


def _sums(counts: Column) -> Column:
    return T.once(counts, lambda n: running(n, F.lit(0), lambda a, b: a + b))


def pieces(text: Column, header: str) -> Column:
    """array<text, line>: a text cut in front of every header, with the line each piece begins at."""
    return T.once(F.split(text, rf"(?dmU)(?={header})"), lambda parts: F.zip_with(
        parts, _sums(F.transform(parts, line_ends)), lambda p, n: F.struct(p.alias("text"), (n + 1).alias("line"))
    ))


def placed(text: Column, pattern: str) -> Column:
    """array<before, text, after, line, last>: matches, what stands up to the neighbours, their first and last line."""

    def lined(hits: Column) -> Column:
        lines = _sums(F.transform(hits, lambda h: line_ends(h["before"]) + line_ends(h["text"])))
        return F.zip_with(hits, lines, lambda h, n: T.once(n + line_ends(h["before"]) + 1, lambda line: F.struct(
            h["before"].alias("before"), h["text"].alias("text"), h["after"].alias("after"),
            line.alias("line"), (line + line_ends(h["text"])).alias("last"),
        )))

    def between(gaps: Column) -> Column:
        hits = F.transform(T.found(text, pattern, 0), lambda m, i: F.struct(
            gaps[i].alias("before"), m.alias("text"), gaps[i + 1].alias("after")
        ))
        return T.once(hits, lined)

    return T.once(F.split(text, pattern), between)


def _whole(content: Column, name: Column, kind: str = "file", **more: Column) -> Column:
    return _chunk(
        symbol_kind=F.lit(kind), symbol_name=name, start_line=F.lit(1), end_line=line_ends(content) + 1, content=content, **more
    )


def scss(content: Column, name: Column) -> Column:
    one = _whole(content, name, css_classes=F.slice(T.css_classes(content), 1, 200))
    return F.when(T.strip(content) != "", F.array(one)).otherwise(_none())


def xml(content: Column, name: Column) -> Column:
    return F.when(T.strip(content) != "", F.array(_whole(content, name))).otherwise(_none())


def script(content: Column, name: Column) -> Column:
    """One chunk per declaration at a line's begin, up to the next; what stands before the first is dropped."""
    starting = rf"(?d)\A{_DECLARATION[1:]}"
    declared = F.filter(pieces(content, _DECLARATION), lambda p: p["text"].rlike(starting))
    chunk = lambda p: _chunk(
        symbol_kind=F.concat(F.lit("ts_"), F.regexp_extract(p["text"], starting, 1)),
        symbol_name=F.regexp_extract(p["text"], starting, 2),
        start_line=p["line"],
        end_line=p["line"] + line_ends(F.left(p["text"], F.char_length(p["text"]) - 1)),
        content=p["text"],
    )
    return T.once(declared, lambda d: F.when(F.size(d) > 0, F.transform(d, chunk)).otherwise(F.array(_whole(content, name))))


def vue(content: Column, name: Column) -> Column:
    """One chunk per section; named by the component that is registered, extended or overridden."""
    component = F.coalesce(
        T.first_found(content, r"(?:Component\.register|Component\.extend)\s*\(\s*['\"]([^'\"]+)['\"]"),
        T.first_found(content, r"Component\.override\s*\(\s*['\"]([^'\"]+)['\"]"),
        name,
    )

    def sections(found: Column, called: Column) -> Column:
        chunks = F.transform(found, lambda s: _chunk(
            symbol_kind=F.concat(F.lit("vue_"), F.regexp_extract(s["text"], _VUE_SECTION, 1)), symbol_name=called,
            content=F.regexp_extract(s["text"], _VUE_SECTION, 3), start_line=s["line"], end_line=s["last"],
        ))
        return F.when(F.size(found) > 0, chunks).otherwise(F.array(_whole(content, called, "vue_component")))

    return T.once(component, lambda called: T.once(placed(content, _VUE_SECTION), lambda found: sections(found, called)))


def twig(content: Column, name: Column) -> Column:
    """A chunk of the file's first 30 lines, and one per block up to the first end behind its begin.

    Ends are given out in order: a block takes the first end that lies behind its own begin (not
    right at it) and behind the end taken before, so an outer block may stop at an inner end. So
    the i-th block takes the end of number ``i + max(c_j - j)`` over all j up to i, if c_j ends lie
    before the j-th block's content. A block without a free end is left out.
    """
    head = F.left(F.array_join(F.slice(F.split(content, "\n"), 1, 30), "\n"), F.lit(1500))
    is_end = lambda m: m["text"].rlike(r"\A\{%\s*endblock")

    def paired(opens: Column, ends: Column) -> Column:
        """array<a, b>: the marks each block begins and ends at."""
        ahead = F.transform(opens, lambda o, i: o["ends"] - i)
        larger = lambda a, b: F.greatest(a, b)
        most = T.once(ahead, lambda c: F.zip_with(running(c, F.lit(0), larger), c, larger))
        both = T.once(most, lambda m: F.transform(opens, lambda o, i: F.struct(
            o["at"].alias("a"), F.try_element_at(ends, i + m[i] + 1).alias("b")
        )))
        return F.filter(both, lambda x: x["b"].isNotNull())

    def ends_before(marks: Column) -> Column:
        counts = _sums(F.transform(marks, lambda m: is_end(m).cast("int")))
        at_once = lambda m, i: (m["after"] == "") & F.coalesce(is_end(F.try_element_at(marks, i + 2)), F.lit(False))
        opens = T.once(counts, lambda n: F.transform(marks, lambda m, i: F.struct(
            i.alias("at"), is_end(m).alias("end"), (n[i] + at_once(m, i).cast("int")).alias("ends")
        )))
        return T.once(opens, lambda all_: T.once(
            F.transform(F.filter(all_, lambda m: m["end"]), lambda m: m["at"]),
            lambda ends: T.once(F.filter(all_, lambda m: ~m["end"]), lambda o: paired(o, ends)),
        ))

    def blocks(marks: Column, deprecated: Column) -> Column:
        def chunk(begin: Column, end: Column, body: Column) -> Column:
            return _chunk(
                symbol_kind=F.lit("twig_block"), symbol_name=F.regexp_extract(begin["text"], T.TWIG_BLOCK, 1), content=body,
                deprecated_in=F.coalesce(T.first_found(body, T.TWIG_DEPRECATED), deprecated),
                start_line=begin["line"], end_line=end["last"],
            )

        texts = F.flatten(F.transform(marks, lambda m: F.array(m["before"], m["text"])))
        return T.once(texts, lambda parts: F.transform(ends_before(marks), lambda x: T.once(
            F.array_join(F.slice(parts, 2 * x["a"] + 2, 2 * (x["b"] - x["a"]) + 1), ""),
            lambda body: chunk(marks[x["a"]], marks[x["b"]], body),
        )))

    def whole(deprecated: Column) -> Column:
        file = _chunk(
            symbol_kind=F.lit("file"), symbol_name=name, content=head, deprecated_in=deprecated, start_line=F.lit(1),
            end_line=F.least(F.lit(30), line_ends(content) + 1), extends_target=T.first_found(content, T.TWIG_EXTENDS),
        )
        marks = placed(content, f"{T.TWIG_BLOCK}|{T.TWIG_END}")
        return F.concat(F.array(file), T.once(marks, lambda m: blocks(m, deprecated)))

    return T.once(T.first_found(content, T.TWIG_DEPRECATED), whole)


def _front_value(front: Column, key: str) -> Column:
    raw = T.strip(F.regexp_extract(front, rf"(?dm)^{key}:[ \t]*(.*)$", 1))
    bare = F.regexp_replace(raw, r"^(['\"])(.*)\1$", "$2")
    return T.once(bare, lambda v: F.nullif(F.when(F.lower(v).isin("null", "~"), F.lit("")).otherwise(v), F.lit("")))


def changelog(content: Column, name: Column, path: Column) -> Column:
    """One chunk per headed section, under the entry's title; the whole text as ``general`` without headers."""
    headed = rf"(?dmU)\A{_SECTION}"
    of_entry = T.once(F.regexp_extract(content, _FRONT, 1), lambda front: F.struct(
        F.coalesce(_front_value(front, "title"), F.lit("")).alias("title"),
        *[_front_value(front, key).alias(key) for key in ("issue", "author", "flag")],
        T.target_version(path).alias("release"),
    ))

    def chunk(entry: Column, section: Column, text: Column) -> Column:
        return T.once(T.strip(F.concat(entry["title"], F.lit("\n\n"), text)), lambda full: _chunk(
            symbol_kind=F.lit("changelog_entry"), symbol_name=F.coalesce(F.nullif(entry["title"], F.lit("")), name), content=full,
            start_line=F.lit(1), end_line=line_ends(full) + 1, target_version=entry["release"],
            section=F.lower(section), issue=entry["issue"], author=entry["author"], flag=entry["flag"],
        ))

    def cut(entry: Column, body: Column) -> Column:
        sections = F.filter(pieces(body, _SECTION), lambda p: p["text"].rlike(headed))
        chunks = T.once(sections, lambda found: F.when(F.size(found) > 0, F.transform(
            found, lambda p: chunk(entry, T.strip(F.regexp_extract(p["text"], headed, 1)), T.strip(p["text"]))
        )).otherwise(F.array(chunk(entry, F.lit("general"), body))))
        return F.when(T.strip(body) != "", chunks).otherwise(_none())

    return T.once(of_entry, lambda entry: T.once(F.regexp_replace(content, _FRONT, ""), lambda body: cut(entry, body)))


def upgrade_notes(content: Column, name: Column) -> Column:
    """One chunk per titled part of each release; what stands before the first title is the intro."""
    starting, sub = rf"(?dmU)\A{_RELEASE}", rf"(?dmU)\A{_SUB}"
    releases = F.filter(pieces(content, _RELEASE), lambda p: p["text"].rlike(starting))

    def note(release: Column, title: Column, body: Column, line: Column) -> Column:
        return _chunk(
            symbol_kind=F.lit("upgrade_note"), symbol_name=F.concat(release, F.lit(" — "), title), content=body,
            start_line=line, end_line=line + line_ends(body), target_version=release, title=title,
        )

    def of_release(r: Column, number: Column, parts: Column) -> Column:
        def part(p: Column) -> Column:
            line = r["line"] + p["line"] - 1
            titled = note(number, T.strip(F.regexp_extract(p["text"], sub, 1)), p["text"], line)
            return F.when(p["text"].rlike(sub), titled).otherwise(note(number, F.lit("intro"), T.strip(p["text"]), line))

        whole = F.array(note(number, F.lit("general"), r["text"], r["line"]))
        return F.when(F.exists(parts, lambda p: p["text"].rlike(sub)), F.transform(parts, part)).otherwise(whole)

    each = lambda r: T.once(F.regexp_extract(r["text"], starting, 1), lambda number: T.once(
        pieces(r["text"], _SUB), lambda parts: of_release(r, number, parts)
    ))
    return T.once(releases, lambda found: F.when(F.size(found) > 0, F.flatten(F.transform(found, each))).otherwise(
        F.array(_whole(content, name, "upgrade_note"))
    ))


#: Fixed value: what opens a type in the older reading of PHP.
_PHP_DECLARATION = (
    r"(?dm)^(?:/\*\*(?s:.*?)\*/\s*\n)?(?:#\[(?s:.*?)\]\s*\n)*(?:final\s+|abstract\s+|readonly\s+)?"
    r"(class|interface|trait|enum)\s+([A-Za-z_][A-Za-z0-9_]*)"
)


def php_types(content: Column, name: Column) -> Column:
    """The older reading of PHP, as a column: one chunk per type, from its documentation up to the next type's.

    A type's deprecation is the last one marked anywhere before its name, so one type's mark shows
    at the types behind it; :func:`php_symbols` is the reading that is indexed.
    """
    space = T.first_found(content, r"(?dm)^namespace\s+([A-Za-z0-9_\\]+)\s*;")

    def chunk(m: Column, body: Column, space: Column, marked: Column) -> Column:
        called = F.regexp_extract(m["text"], _PHP_DECLARATION, 2)
        return _chunk(
            symbol_kind=F.regexp_extract(m["text"], _PHP_DECLARATION, 1), symbol_name=called,
            symbol_fqn=F.concat_ws("\\", space, called), content=T.strip(body), deprecated_in=marked,
            start_line=m["line"], end_line=m["line"] + line_ends(F.left(body, F.char_length(body) - 1)),
        )

    def cut(types: Column, space: Column) -> Column:
        marks = F.transform(types, lambda m: T.last_deprecation(F.concat(m["before"], m["text"])))
        latest = lambda a, b: F.coalesce(b, a)
        so_far = T.once(marks, lambda d: F.zip_with(running(d, F.lit(None).cast("string"), latest), d, latest))
        return T.once(so_far, lambda marked: F.transform(types, lambda m, i: T.once(
            F.concat(m["text"], m["after"]), lambda body: chunk(m, body, space, marked[i])
        )))

    return T.once(space, lambda s: T.once(placed(content, _PHP_DECLARATION), lambda types: F.when(
        F.size(types) > 0, cut(types, s)
    ).otherwise(F.array(_whole(content, name)))))


_TYPE = re.compile(r"(?<![\w$>:\\])(class|interface|trait|enum)\s+([A-Za-z_\u0080-￿][\w\u0080-￿]*)", re.I)
_NAMESPACE = re.compile(r"(?<![\w$>:\\])namespace\s+([\w\\\u0080-￿]+)\s*[;{]", re.I)
_FUNCTION = re.compile(r"(?<![\w$>:\\])function\s*&?\s*([A-Za-z_\u0080-￿][\w\u0080-￿]*)\s*\(", re.I)
_MODIFIERS = frozenset("abstract final readonly public protected private static var".split())
_DEPRECATED = re.compile(T.DEPRECATED)


def _depth(code: str) -> list[int]:
    """How many braces are open before each character."""
    out, depth = [], 0
    for c in code:
        out.append(depth)
        depth += (c == "{") - (c == "}")
    return out


def _head(code: str, raw: str, at: int) -> int:
    """Where a declaration begins, with its modifiers and attributes; ``raw`` still has the attributes."""
    start = at
    while True:
        end = start
        while end and code[end - 1].isspace():
            end -= 1
        begin = end
        while begin and (code[begin - 1].isalnum() or code[begin - 1] == "_"):
            begin -= 1
        if code[begin:end].lower() in _MODIFIERS:
            start = begin
        elif raw[end:start].strip():  # an attribute that was blanked
            return end + len(raw[end:start]) - len(raw[end:start].lstrip())
        else:
            return start


def _doc_before(text: str, code: str, comments: list[tuple[int, int]], start: int) -> str:
    """The nearest comment that opens with ``/**`` before ``start``, with nothing but comments between."""
    for i in range(bisect_right(comments, start, key=lambda c: c[1]) - 1, -1, -1):
        a, b = comments[i]
        if code[b:start].strip():
            break
        if text.startswith("/**", a):
            return text[a:b]
    return ""


def php_symbols(text: str, name: str) -> list[dict]:
    """Chunks of a PHP file: of each type at top level its head, then its methods; else the file."""
    found = list(php_pieces(text))
    raw = masked(text, iter(found))
    code = without_attributes(raw)
    comments = [(a, b) for kind, a, b in found if kind == "comment"]
    depth = _depth(code)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_left(ends, at) + 1
    space = m.group(1) if (m := _NAMESPACE.search(code)) else ""
    out: list[dict] = []

    def add(kind: str, called: str, fqn: str, doc: str, body: str, start: int, stop: int, of: str | None = None) -> None:
        tags = _DEPRECATED.findall(doc)
        out.append({
            "symbol_kind": kind, "symbol_name": called, "symbol_fqn": fqn, "deprecated_in": tags[-1] if tags else None,
            "start_line": line(start), "end_line": line(stop), "content": body[: T.MOST], "class_name": of,
        })

    for m in _TYPE.finditer(code):
        if depth[m.start()]:
            continue
        start, brace = _head(code, raw, m.start()), code.find("{", m.end())
        end = closing(code, brace) if brace >= 0 else -1
        stop = len(text) if end < 0 else end + 1
        called = m.group(2)
        fqn = f"{space}\\{called}" if space else called
        doc = _doc_before(text, raw, comments, start)
        head = text[start : brace if brace >= 0 else stop].rstrip()
        add(m.group(1).lower(), called, fqn, doc, f"{doc}\n{head}" if doc else head, start, stop)
        for f in _FUNCTION.finditer(code, m.end(), stop):
            if depth[f.start()] != 1:
                continue
            begin, close = _head(code, raw, f.start()), closing(code, f.end() - 1)
            tail = re.compile(r"[{;]").search(code, close + 1) if close >= 0 else None
            over = -1 if tail is None else tail.start() if tail.group() == ";" else closing(code, tail.start())
            until = stop if over < 0 else over + 1
            doc, body = _doc_before(text, raw, comments, begin), text[begin:until][: T.MOST]
            add("method", f.group(1), f"{fqn}::{f.group(1)}", doc, f"{doc}\n{body}".strip() if doc else body, begin, until, called)
    if not out:
        add("file", name, "", "", text, 0, len(text))
    return out


_PHP_FIELDS = (
    "symbol_kind", "symbol_name", "symbol_fqn", "deprecated_in", "start_line", "end_line", "content", "class_name",
)


def _php(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        rows = []
        for file in files.to_dict("records"):
            for i, symbol in enumerate(php_symbols(file["content"], (file["file_path"] or "").rsplit("/", 1)[-1])):
                rows.append({k: file[k] for k in ("version", "file_path", "area", "language")} | {"chunk_idx": i} | symbol)
        out = pd.DataFrame(rows, columns=["version", "file_path", "area", "language", "chunk_idx", *_PHP_FIELDS]).astype(object)
        yield out.where(out.notna(), None)


@F.pandas_udf(StringType())
def _point_id(version: pd.Series, path: pd.Series, idx: pd.Series, sha: pd.Series) -> pd.Series:
    def one(*parts: object) -> str:
        h = hashlib.blake2s("|".join(map(str, parts)).encode(), digest_size=16).hexdigest()
        return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))

    return pd.Series([one(*x) for x in zip(version, path, idx, sha, strict=True)], dtype=object)


def point_id(tag: Column, path: Column, idx: Column, sha: Column) -> Column:
    """A stable identifier of a chunk: a 128-bit digest of its release, path, place in the file and content."""
    return _point_id(tag, path, idx, sha)


def chunk_files(files: DataFrame, ids: bool = True, methods: bool = True, notes: Column | None = None) -> DataFrame:
    """Chunks of all files, with ``content_sha``, ``chunk_idx``, ``version_tuple`` and, if asked, ``point_id``.

    Without ``methods`` PHP is cut by type alone, see :func:`php_types`. ``notes`` tells whether
    markdown is read as ``changelog`` or ``upgrade``; if it isn't given, where the path begins does.
    """
    bare = F.regexp_replace("file_path", r"^[./]+", "")
    by_path = F.when(bare.startswith("changelog/"), "changelog").when(bare.startswith("UPGRADE-"), "upgrade")
    notes = by_path if notes is None else notes
    given = files.select("version", "file_path", "area", "language", T.read_text("content").alias("content"), notes.alias("notes")).filter(
        (F.col("area") != "other") & F.col("language").isNotNull() & F.col("content").isNotNull()
    )
    content, path, name = F.col("content"), F.col("file_path"), T.basename("file_path")
    kind = F.when(F.col("language") != "markdown", F.col("language")).otherwise(F.col("notes"))
    chunks = (
        F.when(kind.isin("scss", "css"), scss(content, name)).when(kind == "xml", xml(content, name))
        .when(kind.isin("ts", "js", "typescript", "javascript"), script(content, name)).when(kind == "vue", vue(content, name))
        .when(kind == "twig", twig(content, name)).when(kind == "changelog", changelog(content, name, path))
        .when(kind == "upgrade", upgrade_notes(content, name)).when(kind == "php", php_types(content, name))
    )
    scanned = (F.col("language") == "php") & F.lit(methods)
    read_as = F.when(F.col("language") == "css", "scss").otherwise(F.col("language"))
    native = (
        given.filter(~scanned)
        .select("version", "file_path", "area", read_as.alias("language"), F.posexplode(chunks).alias("chunk_idx", "c"))
        .select("version", "file_path", "area", "language", "chunk_idx", "c.*")
    )
    schema = "version string, file_path string, area string, language string, chunk_idx int, " + ", ".join(
        f"{k} {FIELDS[k]}" for k in _PHP_FIELDS
    )
    php = given.filter(scanned).drop("notes").mapInPandas(_php, schema)
    out = native.unionByName(php, allowMissingColumns=True).withColumn("content_sha", T.sha("content")).withColumn(
        "version_tuple", versions.version_tuple("version")
    )
    if ids:
        tag = F.concat(F.lit("v"), F.col("version"))
        out = out.withColumn("point_id", point_id(tag, path, F.col("chunk_idx"), F.col("content_sha")))
    return out

"""Spellings that mean the same value, brought to one form.

Every function gives null for null and for blank input: such a value says nothing. The same
rules are given as SQL text (``SQL_*``) so that a checking engine can apply them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What counts as surrounding white space of a field.
BLANKS = " \t\n\r\x0b\x0c      　﻿"


def _trim(col: Column | str) -> Column:
    return F.btrim(F.col(col) if isinstance(col, str) else col, F.lit(BLANKS))


def _or_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def tag(col: Column | str) -> Column:
    """``refs/tags/V6.5.2.0 `` and ``6.5.2.0`` become ``v6.5.2.0``."""
    bare = F.regexp_replace(F.lower(_trim(col)), r"^(refs/tags/)?v?", "")
    return F.concat(F.lit("v"), _or_null(bare))


def version(col: Column | str) -> Column:
    """As :func:`tag`, also without a ``tag:`` prefix: ``tag:v6.5.2.0`` becomes ``v6.5.2.0``."""
    bare = F.regexp_replace(F.lower(_trim(col)), r"^(tag:\s*|refs/tags/)*v?", "")
    return F.concat(F.lit("v"), _or_null(bare))


def deprecated_in(col: Column | str) -> Column:
    """As :func:`version`; a fourth part of 0 is left out: ``6.8.0.0`` becomes ``v6.8.0``."""
    return F.regexp_replace(version(col), r"^(v\d+\.\d+\.\d+)\.0+$", "$1")


def file_path(col: Column | str) -> Column:
    """One ``/`` between parts, no leading ``./`` or ``/``, no ``/./``; letter case is kept."""
    slashed = F.translate(_trim(col), "\\", "/")
    joined = F.regexp_replace(slashed, r"/(?:\.?/)+", "/")
    return _or_null(F.regexp_replace(joined, r"^(?:\.?/)+", ""))


def content_sha(col: Column | str) -> Column:
    """Lower-case digits without a ``sha256:`` or ``0x`` prefix."""
    return _or_null(F.regexp_replace(F.lower(_trim(col)), r"^(sha256:\s*|0x)", ""))


def symbol_fqn(col: Column | str) -> Column:
    """Without a leading backslash and a trailing ``()``."""
    return _or_null(_trim(F.regexp_replace(F.regexp_replace(_trim(col), r"^\\+", ""), r"(\s*\(\))+$", "")))


_SQL_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160)"


def sql_tag(x: str) -> str:
    return f"('v' || nullif(regexp_replace(lower(trim({x}, {_SQL_BLANKS})), '^(refs/tags/)?v?', ''), ''))"


def sql_version(x: str) -> str:
    return f"('v' || nullif(regexp_replace(lower(trim({x}, {_SQL_BLANKS})), '^(tag:\\s*|refs/tags/)*v?', ''), ''))"


def sql_deprecated_in(x: str) -> str:
    return f"regexp_replace({sql_version(x)}, '^(v\\d+\\.\\d+\\.\\d+)\\.0+$', '\\1')"


def sql_file_path(x: str) -> str:
    joined = f"regexp_replace(replace(trim({x}, {_SQL_BLANKS}), '\\', '/'), '/(\\.?/)+', '/', 'g')"
    return f"nullif(regexp_replace({joined}, '^(\\.?/)+', ''), '')"


def sql_content_sha(x: str) -> str:
    return f"nullif(regexp_replace(lower(trim({x}, {_SQL_BLANKS})), '^(sha256:\\s*|0x)', ''), '')"


def sql_symbol_fqn(x: str) -> str:
    return f"nullif(regexp_replace(regexp_replace(trim({x}, {_SQL_BLANKS}), '^\\\\+', ''), '(\\s*\\(\\))+$', ''), '')"

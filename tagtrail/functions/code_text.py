"""PHP source text with what is no code blanked out, for the tasks that look for declarations."""

from __future__ import annotations

import re
from collections.abc import Iterator

_TOKENS = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|(?://|\#(?!\[))[^\n]*?(?=\?>|\n|\Z))
      |(?P<here><<<[ \t]*(?P<q>['"]?)(?P<id>[A-Za-z_]\w*)(?P=q)[ \t]*\n.*?(?:^[ \t]*(?P=id)\b|\Z))
      |(?P<string>'(?:\\.|[^'\\])*(?:'|\Z)|"(?:\\.|[^"\\])*(?:"|\Z)|`(?:\\.|[^`\\])*(?:`|\Z))
      |(?P<markup>\?>.*?(?:<\?(?:php\b|=)|\Z))""",
    re.S | re.M | re.X,
)
_OPENING = re.compile(r"<\?(?:php\b|=)")
_BRACKETS = re.compile(r"[()\[\]{}]")
_NOT_LINE_END = re.compile(r"[^\n]")
_ATTRIBUTE = re.compile(r"#\[")


def blank(text: str) -> str:
    """Spaces in place of all but line ends."""
    return _NOT_LINE_END.sub(" ", text)


def php_pieces(text: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, stop) of comments, strings, heredocs and markup, in order."""
    opening, at = _OPENING.search(text), 0
    if opening and (not text[: opening.start()].strip() or text.lstrip().startswith("<")):
        at = opening.end()
        yield "markup", 0, at
    for m in _TOKENS.finditer(text, at):
        yield next(k for k in ("comment", "string", "markup", "here") if m.group(k) is not None), m.start(), m.end()


def masked(text: str, pieces: Iterator[tuple[str, int, int]]) -> str:
    """The text with comments and the insides of strings blanked; offsets stay."""
    out, at = [], 0
    for kind, a, b in pieces:
        out.append(text[at:a])
        out.append("'" + blank(text[a + 1 : b - 1]) + "'" if kind == "string" and b - a > 1 else blank(text[a:b]))
        at = b
    return "".join([*out, text[at:]])


def closing(code: str, at: int) -> int:
    """The offset of the bracket that closes the one at ``at``; -1 if it is cut off."""
    depth = 0
    for m in _BRACKETS.finditer(code, at):
        depth += 1 if m.group() in "([{" else -1
        if not depth:
            return m.start()
    return -1


def without_attributes(code: str) -> str:
    """Masked code with ``#[...]`` blanked."""
    out, at = [], 0
    while m := _ATTRIBUTE.search(code, at):
        end = closing(code, m.start() + 1)
        stop = len(code) if end < 0 else end + 1
        out += [code[at : m.start()], blank(code[m.start() : stop])]
        at = stop
    return "".join([*out, code[at:]])

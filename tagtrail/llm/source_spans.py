"""Comment spans and function spans of one source text: small helpers for the tasks of doc_pairs.

Both kinds are found apart from each other, on the text with what a string, heredoc or (for
functions) a comment holds blanked out, so offsets stay those of the text. Line ends are read as
``\\n`` first. Languages: php, and for all others the syntax of TypeScript, which takes in
JavaScript; of a Vue component only the script sections count.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from tagtrail.functions.code_text import blank, closing, masked, php_pieces, without_attributes

_SCRIPT = re.compile(
    r"""(?P<comment>/\*.*?(?:\*/|\Z)|//[^\n]*)
      |(?P<string>'(?:\\.|[^'\\\n])*(?:'|$|\Z)|"(?:\\.|[^"\\\n])*(?:"|$|\Z))
      |(?P<template>`)
      |(?P<regex>(?:(?<=[(,=:\[!&|?{};\n+])|(?<=return)|(?<=\A))(?P<gap>\s*)/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)""",
    re.S | re.M | re.X,
)
_SECTION = re.compile(r"<script\b[^>]*>(.*?)(?:</script\s*>|\Z)", re.S | re.I)
_TAGGED = re.compile(r"<(?:script|template|style)\b", re.I)


def _template_end(text: str, at: int) -> int:
    """Behind the template literal that opens before ``at``; what ``${}`` holds may hold others."""
    depth = 0
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif depth == 0 and c == "`":
            return at + 1
        elif depth == 0 and text.startswith("${", at):
            depth, at = 1, at + 1
        elif depth and c == "`":
            at = _template_end(text, at + 1) - 1
        elif depth:
            depth += (c == "{") - (c == "}")
        at += 1
    return len(text)


def _pieces(text: str, language: str):
    """(kind, start, stop) of comments and of stretches that hold no code, in order."""
    if language == "php":
        yield from php_pieces(text)
        return
    at = 0
    while m := _SCRIPT.search(text, at):
        start, at = m.span()
        if m.group("template"):
            at = _template_end(text, at)
            yield "string", start, at
        elif m.group("comment") is not None:
            yield "comment", start, at
        else:
            yield "string", m.end("gap") if m.group("regex") is not None else start, at
        at = max(at, start + 1)


def prepared(content: str, language: str) -> str:
    """The text whose offsets all spans use: one kind of line end; of a Vue component the scripts alone."""
    text = content.replace("\r\n", "\n").replace("\r", "\n")
    if language == "vue" and _TAGGED.search(text):
        kept, at = [], 0
        for m in _SECTION.finditer(text):
            kept += [blank(text[at : m.start(1)]), m.group(1)]
            at = m.end(1)
        text = "".join([*kept, blank(text[at:])])
    return text


def doc_comments(text: str, language: str) -> list[tuple[int, int]]:
    """(start, stop) of the closed comments that open with ``/**``."""
    return [
        (a, b)
        for kind, a, b in _pieces(text, language)
        if kind == "comment" and text.startswith("/**", a) and b - a > 4 and text.endswith("*/", a, b)
    ]


def _code_only(text: str, language: str) -> str:
    """The text with comments and the insides of strings blanked."""
    return masked(text, _pieces(text, language))


_WORD = r"[A-Za-z_$\u0080-\uffff][\w$\u0080-\uffff]*"
_PHP_NAMED = re.compile(rf"(?<![\w$>:\\])function\s*&?\s*({_WORD.replace('$', '')})\s*\(", re.I)


def _end_of_body(code: str, at: int) -> int:
    """Behind the body or the semicolon that follows the parameter list's end."""
    m = re.compile(r"[{;]").search(code, at)
    if not m:
        return len(code)
    if m.group() == ";":
        return m.end()
    end = closing(code, m.start())
    return len(code) if end < 0 else end + 1


def _php_functions(text: str) -> list[tuple[str, int, int, int]]:
    code = without_attributes(_code_only(text, "php"))
    found = []
    for m in _PHP_NAMED.finditer(code):
        reach = _back(code, m.start(), _PHP_WORDS)
        close = closing(code, m.end() - 1)
        found.append((m.group(1), reach, m.start(), len(code) if close < 0 else _end_of_body(code, close + 1)))
    return found


_PHP_WORDS = frozenset("public private protected static abstract final readonly var".split())
_SCRIPT_WORDS = frozenset(
    "export default declare public private protected static abstract readonly override async get set accessor".split()
)


def _word_before(code: str, at: int, more: str = "") -> int:
    """Where the word that ends at ``at`` begins."""
    while at and (code[at - 1].isalnum() or code[at - 1] in "_$" or code[at - 1] in more):
        at -= 1
    return at


def _back(code: str, at: int, words: frozenset[str], nesting: _Nesting | None = None) -> int:
    """Back from ``at`` over white space and modifiers (and, in scripts, decorators and a star)."""
    while True:
        while at and code[at - 1].isspace():
            at -= 1
        if nesting:
            decorated = _word_before(code, at, ".")
            if at and code[at - 1] == ")" and (opener := nesting.match.get(at - 1, -1)) > 0:
                end = len(code[:opener].rstrip()) if code[opener - 1].isspace() else opener
                decorated = _word_before(code, end, ".")
            if 0 < decorated < at and code[decorated - 1] == "@":
                at = decorated - 1
                continue
        begin = _word_before(code, at)
        if begin < at and code[begin:at].lower() in words:
            at = begin
        elif nesting and at and code[at - 1] == "*":
            at -= 1
        else:
            return at


_NOT_NAMES = frozenset(
    "if for while switch catch function return await new typeof delete void in of do else with yield throw case super import "
    "class extends const let var".split()
)
_SCRIPT_NAMED = re.compile(rf"(?<![\w$.])function\b\s*\*?\s*({_WORD})\s*[<(]")
_SCRIPT_MEMBER = re.compile(
    rf"(?:(?<![\w$.])(?P<name>#?{_WORD})|(?P<quoted>'[ \n]+'))\s*\??"
    rf"(?:(?P<call>(?:<[^<>()]*(?:<[^<>]*>[^<>()]*)*>)?\s*\()|(?::|(?::[^=;,(){{}}]+)?=(?![=>]))\s*(?P<value>async\b\s*)?"
    rf"(?P<kind>function\b|\(|{_WORD}\s*=>))"
)
_ARROW = re.compile(r"\s*(?::[^=;{}]*)?=>")
_TYPE_PART = re.compile(rf"\s+|=>|{_WORD}|'[^']*'|.", re.S)
_TYPE_SIGNS = frozenset("keyof typeof readonly infer is extends asserts new unique".split())


def _declared_end(code: str, at: int) -> tuple[str, int, bool]:
    """What follows a parameter list that closes before ``at``: ('body', its brace), ('end', where a declaration
    without a body ends) or ('', 0); and whether a return type stands between."""
    at = re.compile(r"[^\S\n]*").match(code, at).end()
    first = re.compile(r"\s*").match(code, at).end()
    if first == len(code):
        return "end", first, False
    if code[first] in ";{,}":
        return ("body", first, False) if code[first] == "{" else ("end", first + (code[first] == ";"), False)
    if code[first] != ":":
        return ("end", at, False) if first > at else ("", 0, False)
    at, open_, angles = first + 1, True, 0  # open_: the type needs more
    while m := _TYPE_PART.match(code, at):
        part, at = m.group(), m.end()
        if part.isspace():
            following = code[at : at + 2]
            if "\n" in part and not open_ and not angles and following[:1] not in "|&?:[{" and following != "=>" and not code.startswith("extends", at):
                return "end", m.start(), True
        elif part in "([" or (part == "{" and (open_ or angles)):
            end = closing(code, m.start())
            if end < 0:
                return "end", len(code), True
            at, open_ = end + 1, False
        elif part == "{":
            return "body", m.start(), True
        elif part == "<":
            angles, open_ = angles + 1, True
        elif part == ">":
            angles, open_ = max(0, angles - 1), False
        elif part == ";" or (part in ",}])" and not angles):
            return "end", at if part == ";" else m.start(), True
        elif part == "=":
            return "", 0, True
        else:
            open_ = part in ("=>", "|", "&", "?", ":", ",") or part in _TYPE_SIGNS
    return "end", len(code), True


_TYPE_HEAD = re.compile(r"(?<![\w$.])(?:class|interface|enum)\b|\btype\s+[\w$]+[^=]*=\s*\Z")
_OBJECT_HEAD = re.compile(r"[(,=:\[?]\Z|\b(?:return|default)\Z")
_FUNCTION_HEAD = re.compile(r"=>\Z|\)\s*:[^:]*\Z")


class _Nesting:
    """Which bracket encloses a place of a text, and what it holds."""

    def __init__(self, code: str):
        self.code, self.places, self.inside = code, [], []
        self.match: dict[int, int] = {}  # the opening bracket of each closing one
        self.held: dict[int, str] = {}
        open_at: list[int] = []
        for m in _ANY_BRACKET.finditer(code):
            if m.group() in "([{":
                open_at.append(m.start())
            elif open_at:
                self.match[m.start()] = open_at.pop()
            self.places.append(m.start())
            self.inside.append(open_at[-1] if open_at else -1)

    def holder(self, at: int) -> str:
        """'type' (a class or interface), 'object', 'block', 'call', or '' at top level."""
        i = bisect_left(self.places, at) - 1
        opener = self.inside[i] if i >= 0 else -1
        if opener < 0:
            return ""
        if opener not in self.held:
            self.held[opener] = self._kind(opener)
        return self.held[opener]

    def _kind(self, opener: int) -> str:
        if self.code[opener] != "{":
            return "object" if self.code[opener] == "[" else "call"
        head = self._head(opener)
        if _TYPE_HEAD.search(head):
            return "type"
        return "object" if _OBJECT_HEAD.search(head) and not _FUNCTION_HEAD.search(head) else "block"

    def _head(self, opener: int) -> str:
        """What stands before a brace, back to the statement's begin; what parentheses hold is left out."""
        parts: list[str] = []
        upto, i = opener, bisect_left(self.places, opener) - 1
        while True:
            begin = self.places[i] + 1 if i >= 0 else 0
            stop = self.code.rfind(";", begin, upto)
            parts.append(self.code[max(begin, stop + 1) : upto])
            bracket = self.code[begin - 1] if i >= 0 else ""
            pair = self.match.get(begin - 1)
            if stop >= 0 or bracket not in (")", "]") or pair is None:
                return (bracket if stop < 0 and bracket in ("(", "[") else "") + "".join(reversed(parts)).rstrip()
            parts.append("()" if bracket == ")" else "[]")
            upto, i = pair, bisect_left(self.places, pair) - 1


_ANY_BRACKET = re.compile(r"[()\[\]{}]")
_EXPRESSION = re.compile(r"[:=(,?&|!]\Z|\breturn\Z")
_DECLARED = re.compile(r"(?<![\w$.])(?:const|let|var)\Z")
_IN_EXPRESSION = re.compile(r"(?:[=:?&|+(\[.!-]|=>)\Z")
#: Modifiers that may stand before an expression too.
_LOOSE = frozenset("export default async".split())


def _script_functions(text: str) -> list[tuple[str, int, int, int]]:
    code = _code_only(text, "ts")
    nesting = _Nesting(code)
    found = []
    for m in _SCRIPT_NAMED.finditer(code):
        reach = _back(code, m.start(), _SCRIPT_WORDS, nesting)
        if _EXPRESSION.search(code, max(0, reach - 10), reach):
            continue  # an expression; a member's value is found below by the member's name
        bracket = code.find("(", m.end() - 1)
        close = closing(code, bracket) if bracket >= 0 else -1
        found.append((m.group(1), reach, m.start(), len(code) if close < 0 else _end_of_body(code, close + 1)))
    for m in _SCRIPT_MEMBER.finditer(code):
        name, start = m.group("name"), m.start()
        if name is None:  # a key in quotes: its text is blanked in ``code``
            name = text[start + 1 : m.end("quoted") - 1]
            if not name.strip() or nesting.holder(start) not in ("object", "type"):
                continue
        elif name in _NOT_NAMES:
            continue
        reach = _back(code, start, _SCRIPT_WORDS, nesting)
        declared = _DECLARED.search(code, max(0, reach - 10), reach)
        if declared:
            start = declared.start()
            reach = _back(code, start, _SCRIPT_WORDS, nesting)
        if reach and code[reach - 1] not in "{};,":  # then a member begins only on a line of its own
            if _IN_EXPRESSION.search(code, max(0, reach - 2), reach):
                continue
            if "\n" not in code[reach:start] and not (code[reach - 1] == ")" and m.group("kind")):
                continue
        if m.group("call") is not None:
            if declared:
                continue
            end = _method_end(code, m.end() - 1, reach, start, nesting)
        else:
            assigned = "=" in code[m.end("name") if m.group("name") else m.end("quoted") : m.start("kind")]
            holder = nesting.holder(start)
            if not declared and (holder in ("block", "call") or assigned and holder == "object"):
                continue  # an assignment or a label
            end = _value_end(code, m)
        if end:
            found.append((name, reach, start, end))
    return found


def _method_end(code: str, bracket: int, reach: int, start: int, nesting: _Nesting) -> int:
    """The end of a method whose parameters open at ``bracket``; 0 if it is a call."""
    close = closing(code, bracket)
    modifiers = set(re.findall(r"[\w$]+", code[reach:start]))
    if close < 0:
        return len(code) if modifiers or nesting.holder(start) in ("type", "object") else 0
    kind, at, typed = _declared_end(code, close + 1)
    if kind == "body":
        end = closing(code, at)
        return len(code) if end < 0 else end + 1
    holder = nesting.holder(start)
    if kind == "end" and (holder == "type" or (not holder and (modifiers - _LOOSE or typed))):
        return at
    return 0


def _value_end(code: str, m: re.Match) -> int:
    """The end of a function-valued member; 0 if its value is something else."""
    kind = m.group("kind")
    if kind == "function":
        at = code.find("(", m.end())
        close = closing(code, at) if at >= 0 else -1
        return len(code) if close < 0 else _end_of_body(code, close + 1)
    at = m.end()
    if kind == "(":
        close = closing(code, m.end() - 1)
        if close < 0:
            return len(code) if m.group("value") else 0
        arrow = _ARROW.match(code, close + 1)
        if not arrow:
            return 0
        at = arrow.end()
    rest = re.compile(r"\s*").match(code, at).end()
    if rest < len(code) and code[rest] in "{(":
        end = closing(code, rest)
        return len(code) if end < 0 else end + 1
    stop = re.compile(r"[,;\n}]").search(code, rest)
    return stop.start() if stop else len(code)


def functions(text: str, language: str) -> list[tuple[str, int, int, int]]:
    """(name, reach, start, stop) of the named functions and methods.

    Between ``reach`` and ``start`` lie nothing but white space, comments, attributes and modifiers.
    """
    return _php_functions(text) if language == "php" else _script_functions(text)

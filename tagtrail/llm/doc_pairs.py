"""Functions paired with their documentation.

Comment spans and function spans are taken from each source text independently, as two tables.
An as-of interval join brings them together: over the spans of a text in order of place, each
function is given the documentation comment that ends last before it; the pair holds if the
comment lies within the function's reach, that is, if nothing but white space, other comments,
attributes and modifiers stands between, and no statement. The join is one window over both
tables, partitioned by text.

Defined results
    * rows without id or content, and languages other than php, typescript, javascript and vue,
      give nothing; repeated rows give each pair once;
    * texts are taken as they are, however they are named; a function whose body is cut off counts;
    * a comment that is not closed, or stands inside a string or heredoc, documents nothing;
    * an empty table gives no rows; other columns, of whatever name, are dropped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tagtrail.llm import source_spans

LANGUAGES = ("php", "typescript", "javascript", "vue")
#: A description needs so many words besides those of the function's name.
WORDS = 5

_LINE_SIGN = re.compile(r"^[ \t]*\*+(?!/)[ \t]?", re.M)
_FIRST_TAG = re.compile(r"^[ \t]*@", re.M)
_MARKUP = re.compile(r"\{@[^{}]*\}|</?[A-Za-z][^<>\n]*>|&[a-z]+;|&#\d+;")
_PART = re.compile(r"[A-ZÄÖÜ]+(?![a-zäöüß])|[A-ZÄÖÜ]?[^\W\dA-ZÄÖÜ_]+|\d+")
_WORD = re.compile(r"\w+(?:['’]\w+)*")
_CLAUSE = re.compile(r"[.!?;]+(?=\s|\Z)|\n\s*\n")

#: Words that name a description, and words that say it is missing, to come, or elsewhere.
_SUBJECT = (
    "description documentation docs docblock doc document comment comments documented undocumented describe explanation "
    "beschreibung dokumentation kommentar dokumentiert beschreiben doku"
).split()
_ABSENT = (
    "missing inherited inherit inherits todo fixme tbd xxx add added insert provide provided write written follow follows "
    "pending see refer needed required later yet placeholder parent fehlt fehlend folgt ergänzen ergänzt nachreichen "
    "schreiben geerbt siehe noch später hinzufügen einfügen nachtragen"
).split()
#: Words that carry nothing beside those two kinds.
_PLAIN = (
    "a an the this that these some any proper short full long further more no not is are was be been being has have had to of for from in on "
    "at by with and or its it it's here there please just still now lines text about what which who how why does do did will should must can same as "
    "method methods function functions class classes interface interfaces member code arguments parameters "
    "der die das den dem des ein eine einen einer eines dieser diese dieses dieses hier bitte dazu ist sind wird werden muss noch nicht kein keine "
    "zu von für und oder text methode methoden funktion funktionen klasse klassen schnittstelle"
).split()
#: Other words a clause may hold that says no more than that a description is missing.
SPARE = 1
_WHOLE = re.compile(
    r"^\W*(?:todo|fixme|tbd|xxx)\b|^\W*(?:this is )?(?:an? )?auto[- ]?generated\b.*\b(?:stub|method|function|comment|code)\b|^\W*\{?@?inherit(?:ed)?[- ]?doc\}?\W*$"
    r"|^\W*(?:inherited|geerbt|see|siehe|same as)\b.{0,40}\b(?:parent|interface|base|super|elternklasse|basisklasse|class|klasse)\b.{0,40}$"
    r"|^\W*lorem ipsum\b|^\W*(?:no comment|n/?a|(?:placeholder|platzhalter)(?: text| comment| description)?)\W*$",
    re.I | re.S,
)
_SAYS, _LACKS, _ANY = frozenset(_SUBJECT), frozenset(_ABSENT), frozenset([*_SUBJECT, *_ABSENT, *_PLAIN])


def description(comment: str) -> str:
    """What a documentation comment says, without comment signs, markup and what begins with its first ``@`` line."""
    body = _LINE_SIGN.sub("", comment[3:-2] if comment.endswith("*/") else comment[3:])
    tag = _FIRST_TAG.search(body)
    return _MARKUP.sub(" ", body[: tag.start()] if tag else body).strip()


def _says_nothing(clause: str) -> bool:
    words = {w.lower() for w in _WORD.findall(clause)}
    if not words or _WHOLE.search(clause):
        return True
    return not words.isdisjoint(_SAYS) and not words.isdisjoint(_LACKS) and len(words - _ANY) <= SPARE


def is_trivial(text: str, name: str) -> bool:
    """Whether a description says too little about the function of this name."""
    of_name = {p.lower() for p in _PART.findall(name)}
    if sum(w.lower() not in of_name for w in _WORD.findall(text)) < WORDS:
        return True
    return all(_says_nothing(c) for c in _CLAUSE.split(text))


def _comments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        out = []
        for key, language, content in zip(rows["key"], rows["language"], rows["content"], strict=True):
            text = source_spans.prepared(content, language)
            out += [(key, a, b, description(text[a:b])) for a, b in source_spans.doc_comments(text, language)]
        yield pd.DataFrame(out, columns=["key", "start", "stop", "says"])


def _functions(code: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for key, language, content in zip(rows["key"], rows["language"], rows["content"], strict=True):
                text = source_spans.prepared(content, language)
                for name, reach, a, b in source_spans.functions(text, language):
                    out.append((key, name, reach, a, text[a:b] if code else None))
            yield pd.DataFrame(out, columns=["key", "name", "reach", "start", "code"])

    return run


def _trivial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        yield rows[[not is_trivial(t, n) for t, n in zip(rows["says"], rows["name"], strict=True)]]


def pairs(chunks: DataFrame, code: bool = True) -> DataFrame:
    """(point_id, function_name, code, description) of chunks (point_id, language, content)."""
    language = F.lower(F.trim("language"))
    texts = (
        chunks.select("point_id", language.alias("language"), "content")
        .filter(F.col("point_id").isNotNull() & F.col("content").isNotNull() & F.col("language").isin(*LANGUAGES))
        .withColumn("key", F.md5(F.concat_ws("\n", "point_id", "language", "content")))
    )
    keyed = texts.select("key", "language", "content")
    comments = keyed.filter(F.contains("content", F.lit("/**"))).mapInPandas(
        _comments, "key string, start int, stop int, says string"
    )
    found = keyed.mapInPandas(_functions(code), "key string, name string, reach int, start int, code string")
    nothing = F.lit(None)
    events = comments.select(
        "key", F.col("stop").alias("at"), F.struct("start", "stop", "says").alias("comment"),
        nothing.cast("string").alias("name"), nothing.cast("int").alias("reach"), nothing.cast("string").alias("code"),
    ).unionByName(found.select(
        "key", F.col("start").alias("at"), nothing.cast("struct<start:int,stop:int,says:string>").alias("comment"),
        "name", "reach", "code",
    ))
    # a comment that ends where a function begins comes first
    in_order = Window.partitionBy("key").orderBy("at", F.col("name").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    nearest = events.withColumn("comment", F.last("comment", ignorenulls=True).over(in_order))
    held = nearest.filter(F.col("name").isNotNull() & (F.col("comment.start") >= F.col("reach"))).select(
        "key", "name", "code", F.col("comment.says").alias("says")
    )
    good = held.distinct().mapInPandas(_trivial, "key string, name string, code string, says string")
    return (
        texts.select("key", "point_id").distinct().join(good, "key")
        .select("point_id", F.col("name").alias("function_name"), "code", F.col("says").alias("description"))
    )

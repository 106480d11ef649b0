"""Which area and language a path belongs to, and whether it is indexed at all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tagtrail.functions.text import basename

#: Area, path prefixes, path parts; the first rule that fits decides.
AREA_RULES: Sequence[tuple[str, Sequence[str], Sequence[str]]] = (
    ("changes", ("changelog/", "UPGRADE-"), ()),
    ("flow", (), ("src/Core/Content/Flow/", "src/Administration/Resources/app/administration/src/module/sw-flow")),
    (
        "checkout", (),
        (
            "src/Core/Checkout/", "Storefront/Resources/views/storefront/page/checkout",
            "Storefront/Resources/views/storefront/component/checkout",
        ),
    ),
    ("administration", (), ("src/Administration/",)),
    ("storefront", (), ("src/Storefront/",)),
    ("core", (), ("src/Core/",)),
)
OTHER = "other"
CODE_AREAS = ("core", "storefront", "administration", "checkout", "flow")

#: Language by suffix; folders and path parts that are not indexed.
LANGUAGES = {
    "php": "php", "twig": "twig", "vue": "vue", "ts": "ts", "js": "js", "scss": "scss", "css": "css", "xml": "xml",
    "yaml": "yaml", "yml": "yaml", "md": "markdown",
}
SKIPPED_FOLDERS = ("tests", "Test", "vendor", "node_modules")
SKIPPED_PARTS = ("/Resources/public/", "/Resources/dist/", "/Migration/Fixtures/", ".spec.", ".test.", "Migration_")


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def area(path: Column | str, rules: Sequence = AREA_RULES) -> Column:
    """The first rule that fits a path, read without leading dots and slashes."""
    bare = F.regexp_replace(path, r"^[./]+", "")
    norm = F.regexp_replace(bare, r"/(?:\.?/)+", "/")
    out = F.lit(None).cast("string")
    for name, prefixes, parts in reversed(rules):
        fits = _any([norm.startswith(p) for p in prefixes] + [norm.contains(p) for p in parts])
        out = F.when(fits, name).otherwise(F.coalesce(out, F.lit(OTHER)))
    return out


def language(path: Column | str) -> Column:
    """By the last suffix, letter case aside; null without a known one. A leading dot is no suffix."""
    suffix = F.regexp_extract(F.lower(basename(path)), r"^.+\.([^.]+)$", 1)
    known = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return F.try_element_at(known, suffix)


def diff_language(path: Column | str) -> Column:
    """The coarser reading used to compare two versions of a file; letter case counts."""
    col = F.col(path) if isinstance(path, str) else path
    out = F.lit("text")
    groups = (("xml", ("xml",)), ("ts", ("ts", "js")), ("vue", ("vue",)), ("scss", ("scss", "css")), ("twig", ("twig",)), ("php", ("php",)))
    for name, suffixes in groups:
        out = F.when(_any([col.endswith(f".{s}") for s in suffixes]), name).otherwise(out)
    return out


def is_candidate(path: Column | str) -> Column:
    """Whether a file is indexed: a known language, no skipped folder, no skipped part."""
    slashed = F.translate(path, "\\", "/")
    folders = F.split(slashed, "/")
    skipped = F.arrays_overlap(folders, F.array(*map(F.lit, SKIPPED_FOLDERS))) | _any([slashed.contains(p) for p in SKIPPED_PARTS])
    return F.coalesce(language(path).isNotNull() & ~skipped, F.lit(False))

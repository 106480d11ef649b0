"""Release numbers: parsing, order and ranges."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: tags of finished releases.
STABLE_TAG = r"^v6\.[4567]\.\d+\.\d+$"


def version_tuple(version: Column | str) -> Column:
    """``6.5.2.0`` as array<int>; null if a part is no number. Arrays compare part by part."""
    col = F.col(version) if isinstance(version, str) else version
    parts = F.transform(F.split(col, "[.]"), lambda p: F.when(p.rlike(r"^\s*[+-]?\d+\s*$"), F.trim(p).cast("int")))
    return F.when(F.forall(parts, lambda p: p.isNotNull()), parts)


def tag_order(tag: Column | str) -> Column:
    """Sort key of a tag of four numbers; (0, 0, 0, 0) for any other."""
    col = F.col(tag) if isinstance(tag, str) else tag
    numbers = F.transform(F.split(F.substring(col, 2, 1000), "[.]"), lambda p: p.cast("int"))
    return F.when(col.rlike(r"^v\d+\.\d+\.\d+\.\d+$"), numbers).otherwise(F.array(*[F.lit(0)] * 4))


def is_stable(tag: Column | str) -> Column:
    return (F.col(tag) if isinstance(tag, str) else tag).rlike(STABLE_TAG)


def after_up_to(version: Column, low: str, high: str, numeric: bool = True) -> Column:
    """Whether ``low < version <= high``, by numbers or by characters; never for what has no order."""
    if not numeric:
        return (version > low) & (version <= high)
    at = version_tuple(version)
    return F.coalesce((at > version_tuple(F.lit(low))) & (at <= version_tuple(F.lit(high))), F.lit(False))


def parsed(version: str) -> tuple[int, ...]:
    """A version given as an argument, as a tuple; empty if a part is no number."""
    parts = (version or "").split(".")
    return tuple(map(int, parts)) if all(p.strip().lstrip("+-").isdigit() for p in parts) else ()

"""Filter columns. A filter whose argument is empty or null passes everything."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals_ci(col: Column, value: str | None) -> Column:
    """Case-insensitive; null rows don't pass."""
    return F.lit(True) if not value else F.coalesce(F.upper(col) == value.upper(), F.lit(False))


def classified(col: Column, value: str | None, strict: bool) -> Column:
    """Case-insensitive; if lenient, rows without a value pass too."""
    if not value:
        return F.lit(True)
    same = F.coalesce(F.lower(col) == value.lower(), F.lit(False))
    return same if strict else same | (F.coalesce(col, F.lit("")) == "")


def contains_ci(col: Column, needle: str | None) -> Column:
    return F.lit(True) if not needle else F.coalesce(F.contains(F.lower(col), F.lit(needle.lower())), F.lit(False))


def has_tag(tags: Column, tag: str) -> Column:
    """One of the tags is it, whatever its case."""
    return F.coalesce(F.exists(tags, lambda t: F.lower(t) == tag.lower()), F.lit(False))


def tag_contains(tags: Column, needle: str) -> Column:
    return F.coalesce(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(needle.lower()))), F.lit(False))


def min_rating(col: Column, least: int | None) -> Column:
    return F.lit(True) if not least else F.coalesce(col, F.lit(0)) >= least


def in_range(col: Column, low: float | None, high: float | None) -> Column:
    return every([col >= low] * (low is not None) + [col <= high] * (high is not None))


def json_flag(col: Column, path: str) -> Column:
    """A JSON true or 1."""
    return F.coalesce(F.get_json_object(col, path).isin("true", "1"), F.lit(False))


def present(col: Column) -> Column:
    """Neither null nor empty; blanks count as text."""
    return F.coalesce(col != "", F.lit(False))


def present_trimmed(col: Column) -> Column:
    return F.coalesce(F.trim(col) != "", F.lit(False))


def starts_with(col: Column, prefix: str | None) -> Column:
    """Case-sensitive."""
    return F.lit(True) if not prefix else F.coalesce(F.startswith(col, F.lit(prefix)), F.lit(False))


def same(col: Column, value: str | None) -> Column:
    """Case-sensitive equality."""
    return F.lit(True) if not value else F.coalesce(col == value, F.lit(False))


def under(path: Column, root: str) -> Column:
    """The folder root itself, or what lies below it."""
    top = root.rstrip("/")
    return F.coalesce((path == top) | F.startswith(path, F.lit(f"{top}/")), F.lit(False))

"""Array-level set algebra and answer parsing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evalloom.functions.text import trim_ws


def _ratio(a: Column, b: Column) -> Column:
    return F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_full(a: Column, b: Column) -> Column:
    """Two empty sets are alike: 1."""
    return F.coalesce(_ratio(a, b), F.lit(1.0))


def jaccard_empty(a: Column, b: Column) -> Column:
    """Any empty set: 0."""
    return F.coalesce(_ratio(a, b), F.lit(0.0))


def consensus(a: Column, b: Column, most: int) -> Column:
    """Intersection, filled from the rest in sorted order to ``most``, sorted."""
    both = F.array_sort(F.array_intersect(a, b))
    rest = F.array_sort(F.array_except(F.array_union(a, b), both))
    return F.array_sort(F.slice(F.concat(both, rest), 1, most))


def letters(n: Column | int = 5) -> Column:
    return F.slice(F.array(*(F.lit(c) for c in "ABCDEFGH")), F.lit(1), n if isinstance(n, Column) else F.lit(n))


def parse_single(c: Column) -> Column:
    """First letter A to E that stands in the text."""
    return F.nullif(F.regexp_extract(F.upper(c), "[A-E]", 0), F.lit(""))


def parse_multi(c: Column) -> Column:
    """Sorted distinct letters A to E."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.upper(F.coalesce(c, F.lit(""))), F.lit("([A-E])"))))


def choice(c: Column) -> Column:
    return F.nullif(F.upper(trim_ws(c)), F.lit(""))


def choices(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.transform(c, choice), lambda x: x.isNotNull())))


def is_empty_prediction(text: Column, chosen: Column) -> Column:
    return (F.coalesce(trim_ws(text), F.lit("")) == "") & (F.coalesce(F.size(chosen), F.lit(0)) <= 0)


def merge(*lists: Column) -> Column:
    """All entries once, in order; a null list has none."""
    return F.array_distinct(F.filter(F.concat(*(F.coalesce(x, F.array().cast("array<string>")) for x in lists)), lambda x: x.isNotNull()))


def contains_any(c: Column, keys: list[str]) -> Column:
    return F.exists(F.array(*(F.lit(k.lower()) for k in keys)), lambda k: F.contains(F.lower(c), k))

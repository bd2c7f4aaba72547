"""Vector, set and ranking helpers as Column expressions (doubles throughout)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    n = norm(v)
    return F.when(n == 0, v).otherwise(F.transform(v, lambda x: x / n))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 where both are empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when(F.size(a) + F.size(b) == 0, F.lit(0.0)).otherwise(shared / (F.size(a) + F.size(b) - shared))


def coverage(query: Column, terms: Column) -> Column:
    """Share of the distinct query terms that occur; 0 without query terms."""
    return F.when(F.size(query) == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(query, terms)) / F.size(query))


def minmax(value: Column, *partition: str) -> Column:
    """Scaled to 0..1 within the partition, 1 where all values are equal, null stays null."""
    w = Window.partitionBy(*partition)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return F.when(value.isNull(), F.lit(None)).when(high == low, F.lit(1.0)).otherwise((value - low) / (high - low))


def upper_median(values: Column) -> Column:
    """Middle element of the sorted values, the upper one of an even number; for groups that fit into an array.

    ``operators.evaluate.upper_medians`` is for groups of any size.
    """
    s = F.array_sort(F.collect_list(values))
    return F.element_at(s, (F.floor(F.size(s) / 2) + 1).cast("int"))


def ranked(score: Column, ident: str, *partition: str) -> Column:
    """1-based rank by score to nine places, ties by id.

    Sums of the same terms may differ in their last bit with the order of addition;
    rounding the key keeps equal documents tied.
    """
    return F.row_number().over(Window.partitionBy(*partition).orderBy(F.round(score, 9).desc(), F.col(ident).asc()))

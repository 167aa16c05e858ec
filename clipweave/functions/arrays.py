"""Array column functions: vectors, reason codes and sets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column, zeros: bool = True) -> Column:
    """``v`` at length 1; a vector of length 1e-12 or less becomes zeros, or stays as it is."""
    n = norm(v)
    return F.when(n > 1e-12, F.transform(v, lambda x: x / n)).otherwise(F.transform(v, lambda x: F.lit(0.0)) if zeros else v)


def reasons(*cases: tuple[Column, str]) -> Column:
    """The names of the cases that hold, in their order."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in cases]))


def sorted_union(*arrays: Column) -> Column:
    """The sorted distinct values of several arrays; null arrays are empty."""
    empty = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(a, empty) for a in arrays])))


def first_present(*cols: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*[F.when(F.trim(c) != "", c) for c in cols])


def padded(v: Column, n: int) -> Column:
    """``v`` with zeros up to ``n`` values."""
    return F.concat(v, F.array_repeat(F.lit(0.0), F.greatest(F.lit(n) - F.size(v), F.lit(0))))


def peak_normalised(v: Column, peak: float = 0.95) -> Column:
    """``v`` scaled to a largest magnitude of ``peak``; silence stays."""
    top = F.array_max(F.transform(v, lambda x: F.abs(x)))
    return F.when(top > 0, F.transform(v, lambda x: x * peak / top)).otherwise(v)

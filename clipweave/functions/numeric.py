"""Numeric column functions: finiteness, clamping, scaling, rounding and the percentile definitions in use."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """``x`` as a double where it is finite, else null."""
    d = x.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != F.lit(float("inf"))), d)


def clamp(x: Column, low: float, high: float) -> Column:
    """``x`` within [low, high]; null where it isn't finite."""
    v = finite(x)
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


def score_0_100(x: Column) -> Column:
    """A percentage: finite and within [0, 100], to 2 places; else null."""
    v = finite(x)
    return F.when(v.between(0, 100), F.bround(v, 2))


def score_from_fraction(x: Column) -> Column:
    """A fraction within [0, 1] as a percentage to 2 places; else null."""
    v = finite(x)
    return F.when(v.between(0, 1), F.bround(v * 100, 2))


def clamped_percent(x: Column) -> Column:
    """A fraction times 100, clamped to [0, 100], to 2 places; null where it isn't finite."""
    return F.bround(clamp(x.cast("double") * 100, 0, 100), 2)


def autoscaled(x: Column) -> Column:
    """A score that may be a fraction: values up to 1 count as fractions, which is ambiguous for tiny percentages."""
    v = finite(x)
    return F.bround(F.when(v <= 1, v * 100).otherwise(v), 2)


def span_score(x: Column) -> Column:
    """[0, 1] as a percentage to 3 places, (1, 100] as it is, else null."""
    v = finite(x)
    return F.when(v.between(0, 1), F.bround(v * 100, 3)).when((v > 1) & (v <= 100), v)


def rounded(x: Column, places: int) -> Column:
    """A double to so many places, correctly: the exact value of the double decides, and the even neighbour where that lies exactly between two.

    The product with the power of ten is taken with its own error, from factors of 26 bits.
    """
    scale = float(10**places)
    c = 134217729.0 * scale
    s_high = c - (c - scale)

    def one(x: Column) -> Column:
        high = 134217729.0 * x - (134217729.0 * x - x)
        product = x * scale
        error = ((high * s_high - product) + high * (scale - s_high) + (x - high) * s_high) + (x - high) * (scale - s_high)
        below = F.floor(product)
        over = (product - below - 0.5) + error
        return (below + ((over > 0) | ((over == 0) & (F.pmod(below, F.lit(2)) == 1))).cast("int")) / F.lit(scale)

    return F.transform(F.array(x.cast("double")), one)[0]  # x is computed once


def scaled(x: Column, places: int) -> Column:
    """A double to so many places as SQL engines round it: the nearest whole number to its product with the power of ten, as doubles, half away from zero.

    ``F.round`` goes by the shortest decimal instead, so the two differ where that ends in a five but the product falls beside the half.
    """
    scale = float(10**places)
    return F.round(x * F.lit(scale), 0) / F.lit(scale)


def fused(a: Column, b: Column, c: Column) -> Column:
    """a * b + c of doubles, rounded once as a fused multiply-add: the errors of the product (from factors of 26 bits) and of the sum are added last."""

    def one(x: Column) -> Column:
        a, b, c = x["a"], x["b"], x["c"]
        a_high = 134217729.0 * a - (134217729.0 * a - a)
        b_high = 134217729.0 * b - (134217729.0 * b - b)
        product = a * b
        error = ((a_high * b_high - product) + a_high * (b - b_high) + (a - a_high) * b_high) + (a - a_high) * (b - b_high)
        total = product + c
        rest = (product - (total - (total - product))) + (c - (total - product))
        return total + (error + rest)

    return F.transform(F.array(F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"), c.cast("double").alias("c"))), one)[0]  # each is computed once


def to_samples(seconds: Column, rate: Column | float) -> Column:
    """Seconds to a sample index, half to even."""
    return F.bround(seconds * rate, 0).cast("bigint")


def to_seconds(samples: Column, rate: Column | float) -> Column:
    """A sample index to seconds, to 6 places. Where samples / rate lies exactly between two, its double's own error decides, as in correct rounding, and the even one if it has none."""
    s, r = samples.cast("double"), F.lit(1.0) * rate
    halves = s * 2e6 / r
    split = 134217729.0 * (s / r)
    high = split - (split - s / r)  # 26 bits, so that products with the rate are exact
    error = (high * r - s) + (s / r - high) * r
    below = F.floor(halves / 2)
    up = (error > 0) | ((error == 0) & (below % 2 == 1))
    tie = (s * 2e6 % r == 0) & (halves % 2 == 1)
    return F.when(tie, (below + up.cast("int")) / F.lit(1e6)).otherwise(F.bround(s / r, 6))


def rescale_samples(samples: Column, from_rate: Column | float, to_rate: Column | float) -> Column:
    """A sample index at another rate, half to even."""
    return F.bround(samples.cast("double") * (F.lit(1.0) * to_rate / from_rate), 0).cast("bigint")


def duration_seconds(samples: Column, rate: Column, seconds: Column) -> Column:
    """samples / rate where both are valid, else the stated seconds, else null."""
    return F.coalesce(F.when((samples >= 0) & (rate > 0), samples / rate), finite(seconds))


def nearest_rank(values: Column, q: float) -> Column:
    """Of an array, the value at index round(q * (n - 1)), half to even; null if empty."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(ordered, F.bround(F.lit(float(q)) * (F.size(ordered) - 1), 0).cast("int"))


def upper_median(values: Column) -> Column:
    """Of an array, the sorted value at index n // 2."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def lower_rank(values: Column, q: float) -> Column:
    """Of an array, the sorted value at index max(0, int(q * n) - 1)."""
    ordered = F.array_sort(F.filter(values, lambda v: v.isNotNull()))
    return F.get(ordered, F.greatest(F.lit(0), F.floor(F.lit(float(q)) * F.size(ordered)).cast("int") - 1))


def format_compact(seconds: Column) -> Column:
    """Seconds as 1h 2m, 3m 4s or 5s."""
    s = F.bround(seconds, 0).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).when(m > 0, F.format_string("%dm %ds", m, s % 60)).otherwise(F.format_string("%ds", s))

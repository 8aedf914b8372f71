"""Numeric column helpers that follow one missing-value rule.

NaN and infinities become NULL on entry; NULL never satisfies a predicate.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """NaN and +-infinity to NULL."""
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(INF)), c)


def to_double(c: Column) -> Column:
    """Lenient numeric cast: text that is not a finite number becomes NULL."""
    return finite(c.try_cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL when b is zero or either side is missing."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def change(new: Column, old: Column) -> Column:
    """new / old - 1 with the zero-base guard of :func:`ratio`."""
    return ratio(new, old) - F.lit(1.0)


def clip(c: Column, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value; NULL stays NULL (least/greatest alone would skip it)."""
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def is_true(c: Column) -> Column:
    """NULL-safe boolean: unknown counts as false, also under negation."""
    return F.coalesce(c, F.lit(False))


def positive(c: Column) -> Column:
    """The value when it is strictly positive, else NULL."""
    c = finite(c.cast("double"))
    return F.when(c > 0, c)


def share(cond: Column) -> Column:
    """Aggregate: fraction of rows where cond holds; unknown counts as not holding."""
    return F.avg(F.when(cond, 1.0).otherwise(0.0))


def compound(r: Column) -> Column:
    """Aggregate: prod(1 + r) - 1."""
    return F.product(F.lit(1.0) + r) - F.lit(1.0)


def half_even(c: Column, digits: int) -> Column:
    """Round half to even on the scaled binary value, the rule of array libraries."""
    scale = F.lit(10.0 ** digits)
    return F.rint(c.cast("double") * scale) / scale

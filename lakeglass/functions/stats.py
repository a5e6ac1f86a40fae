"""Statistics that Spark has no single function for, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean_number(c: Column) -> Column:
    """A column as double; text that is no number, NaN and infinities become null."""
    d = c.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def share(part: Column, whole: Column) -> Column:
    """Per cent of a whole; null where the whole is null or zero."""
    return F.try_divide(part.cast("double"), whole.cast("double")) * 100


def percent(part: Column, whole: Column) -> Column:
    """Per cent to two places, 0 where the whole is zero."""
    return F.coalesce(F.round(share(part, whole), 2), F.lit(0.0))


def change(now: Column, before: Column) -> Column:
    """Per cent change; null where the base is null or zero."""
    return F.try_divide(now - before, before) * 100


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation over the rows where both are present, as an aggregate; null where one of them does not vary."""
    both = a.isNotNull() & b.isNotNull()
    x, y = F.when(both, a.cast("double")), F.when(both, b.cast("double"))
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def bin_of(value: Column, low: Column, high: Column, bins: int) -> Column:
    """The number (from 1) of the equal-width bin, closed on the right, that holds a value; all in bin 1 where low = high."""
    width = (high - low) / bins
    k = F.coalesce(F.ceil(F.try_divide(value - low, width)), F.lit(1))
    return F.when(value.isNotNull(), F.greatest(F.lit(1), F.least(F.lit(bins), k)).cast("int"))


def quintile(rank: Column, n: Column, parts: int = 5) -> Column:
    """The class (1..parts) of the row with the given rank (from 1) among n, cut at 1 + (n - 1) k / parts."""
    cut = F.ceil(F.try_divide((rank - 1).cast("double") * parts, (n - 1).cast("double")))
    return F.greatest(F.lit(1), F.coalesce(cut, F.lit(1))).cast("int")


def fences(q1: Column, q3: Column, threshold: float) -> tuple[Column, Column]:
    return q1 - (q3 - q1) * threshold, q3 + (q3 - q1) * threshold


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))
